"""Whole jobs: what small fixtures and invariants don't show."""

import numpy as np
import pandas as pd
import pytest

from tidemill.config import Options
from tidemill.operators import cluster, embed, modality
from tidemill.plans import registry


def test_dip_with_counts():
    rng = np.random.default_rng(3)
    for _ in range(20):
        v, n = rng.integers(0, 30, 25).astype(float), rng.integers(1, 9, 25)
        assert modality.dip(v, n) == modality.dip(np.repeat(v, n))


def test_dip_query_counts_every_value(spark, tmp_path):
    rng = np.random.default_rng(4)
    two = np.concatenate((rng.normal(25, 8, 9000), rng.normal(75, 8, 9000)))  # fills the grid of one decimal
    one = rng.normal(50, 12, 5000).round(2)
    rows = pd.DataFrame({"event_type": ["two"] * len(two) + ["one"] * len(one), "value": np.concatenate((two, one))})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_type: r for r in registry.QUERIES["o80_dip"](spark, str(tmp_path)).collect()}
    assert got["two"].dip == pytest.approx(modality.dip(two)) and got["two"].p == 0
    assert got["one"].dip == pytest.approx(modality.dip(one)) and got["one"].p == modality.p_value(modality.dip(one), 5000)


def test_kernels_need_no_square_of_memory():
    import tracemalloc

    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(0, 1, (2000, 2)), rng.normal(60, 1, (2000, 2))))  # 128 MB a matrix
    tracemalloc.start()
    z = cluster.linkage(x)
    i, j = cluster.mutual_pairs(x, 9)
    embed.tsne(x, perplexity=5, iterations=2)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert len(set(cluster.cut(z, 2)[:2000])) == 1 and len(set(cluster.cut(z, 2))) == 2
    labels = cluster.components_of(4000, i, j)
    assert not set(labels[:2000]) & set(labels[2000:])


def test_blockwise_kernels_are_the_dense_ones():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (300, 2)).astype(float)
    near = cluster.mutual_neighbours(x, 9)
    assert (near == near.T).all() and cluster.components_of(300, *cluster.mutual_pairs(x, 9)).tolist() == cluster.components(near).tolist()
    x = rng.normal(size=(120, 6))
    y = embed.tsne(x, perplexity=8, iterations=1, seed=3)
    p = embed.affinities((x - x.mean(0)) / (x - x.mean(0)).max(), 8)
    a = np.random.default_rng(3).normal(size=(120, 2)) * 1e-4
    q = 1 / (1 + ((a[:, None] - a) ** 2).sum(2))
    np.fill_diagonal(q, 0)
    grad = ((p * 12 - q / q.sum()) * q)[:, :, None] * (a[:, None] - a)
    grad = grad.sum(1)
    b = a - 200 * 1.2 * grad
    assert y == pytest.approx(b - b.mean(0), abs=1e-9)


def test_registered_screens_do_the_default_job(monkeypatch):
    o = registry._FULL
    assert o == Options(kmer=2, seed=1)
    seen = {}
    monkeypatch.setattr(registry.embed, "tsne", lambda x, **k: seen.update(k) or x[:, :2])
    monkeypatch.setattr(registry.modality, "multimodal", lambda x, **k: seen.update(k) or True)
    group = pd.DataFrame({"label": 1, "pid": range(40), "vec": list(np.random.default_rng(9).normal(size=(40, 3)))})
    registry._embedded(group), registry._modes(group)
    assert not {"iterations", "samples"} & set(seen)


def test_merges_cuts_and_axes_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    merges, cuts, axes = (registry.QUERIES[q](spark, sf).toPandas() for q in ("o88_ward", "o89_cut", "o78_pca_axes"))
    x = np.stack(rows["embedding"]).astype(float)
    assert axes.sort_values("dim").variance.to_numpy() == pytest.approx(np.linalg.eigvalsh(np.cov(x.T, bias=True)), abs=1e-9)
    for label, group in rows.groupby("label"):
        x, ids = np.stack(group["embedding"]).astype(float), group["vec_id"].to_numpy()
        parts = {k: [k] for k in range(len(x))}

        def height(a, b):
            a, b = parts[a], parts[b]
            return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))

        for m in merges[merges.label == label].sort_values("step").itertuples():
            if len(parts) == 3:
                own = cuts[cuts.label == label].groupby("cluster").pid.apply(frozenset)
                assert set(own) == {frozenset(ids[p].tolist()) for p in parts.values()}
            if m.step % 8 == 0 or len(parts) < 5:
                assert m.height == pytest.approx(min(height(a, b) for a in parts for b in parts if a < b), abs=1e-6)
            assert m.height == pytest.approx(height(m.a, m.b), abs=1e-6)
            parts[len(x) + m.step] = parts.pop(m.a) + parts.pop(m.b)
            assert m.size == len(parts[len(x) + m.step])
        assert len(parts) == 1


def test_cells_repel_like_all_pairs():
    rng = np.random.default_rng(10)
    y = np.concatenate((rng.normal(0, 3, (900, 2)), rng.normal(60, 5, (700, 2)), np.zeros((150, 2))))
    order, starts = embed.cells(y)
    assert sorted(order) == list(range(len(y))) and starts[0] == 0 and np.diff(np.append(starts, len(y))).max() <= 2 * embed._CELL
    want, total = embed._all_pairs(y)
    for theta, least in ((1e-9, 1e-5), (0.5, 5e-3), (1.0, 5e-2)):
        push, own = embed.repulsion(y, order, starts, theta)
        assert np.linalg.norm(push - want) < least * np.linalg.norm(want) and own == pytest.approx(total, rel=least)
    x = np.concatenate((rng.normal(0, 0.1, (200, 8)), rng.normal(3, 0.1, (200, 8))))
    a, b = (embed.tsne(x, perplexity=20, iterations=300, seed=2, theta=t) for t in (0, 0.5))
    assert embed.divergence(x, b, 20) < 1.05 * embed.divergence(x, a, 20) + 0.02


def test_hulls_by_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(30):
        x = np.sort(rng.choice(1000, 40, replace=False)).astype(float)
        y = np.cumsum(rng.integers(1, 5, 40)).astype(float)
        for sign in (1, -1):
            got = modality._hull(x, y, 0, 39, sign)
            chord = np.interp(x, x[got], y[got])
            assert got == sorted(got) and (sign * (y - chord) >= -1e-9).all()
            slope = np.diff(y[got]) / np.diff(x[got])
            assert (sign * np.diff(slope) > 0).all()
