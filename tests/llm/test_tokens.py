import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemill.llm import packing, token_output, tokens

DOCS = "doc_id long, text string, extra string"


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens.default_tokenizer(), slots=1 << 12)


def plain(enc, text, fresh=Tokenizer.from_file(tokens.default_tokenizer())):
    """By a tokenizer of its own, as the library has it."""
    return fresh.encode(text or "", add_special_tokens=False).ids


def test_encoder_matches_the_library(enc):
    hard = ["", None, " ", "  a", "a  b", "\n\nA", " \nA", "\t\tfoo", "'s 'll don't", "x''s 90's '' s", "é's ÿ'll 'über", "a×b ÷ c", "１２ ¼½ 3²", "🙂 🙂a", "<|endoftext|> x", "a b<|endoftext|>", "<|endoftext|><|endoftext|>\n", "<|endoftext |>", "a\x85b \x85", "x\x1c y", "a\r\n b\n", "ǅ ʰ"]
    rng = random.Random(1)
    letters = [*"abétlLd1 2.\n\t!-", "'s", " '", "  ", "ß"]
    texts = hard + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [" ".join(rng.choice("abcdef") * rng.randint(1, 9) for _ in range(30_000))]
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(texts)] == [plain(enc, t) for t in texts]
    many = [" ".join(f"w{rng.random()}" for _ in range(3000))]  # more units than the table holds
    assert enc.encode(many)[0].tolist() == plain(enc, many[0])


def test_files_round_trip(spark, tmp_path, enc):
    rows = [(5, "five words are in here", "x"), (1, None, None), (3, "", "x"), (None, "no id", "x"), (9, "long " * 30_000, "x"), (5, "another of the same id", "x"), (7, "<|endoftext|> é\n\n", "x")]
    path = str(tmp_path / "out")
    manifest = token_output.write_shards(spark.createDataFrame(rows, DOCS), path)
    got = token_output.read_shards(manifest, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    left = {(r[0], tuple(plain(enc, r[1]) + [0])): r for r in rows}
    start = 0
    for g in got:
        w = left.pop((g.doc_id, tuple(g.ids)))
        ids = plain(enc, w[1]) + [0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids) == (w[0], start, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not left
    m = max(manifest.collect(), key=lambda r: r.n_docs)
    for k in range(m.n_docs - 1, -1, -1):
        doc, ids = token_output.read_record(path, m.path, k)
        assert ids[-1] == 0
    empty = token_output.write_shards(spark.createDataFrame([], DOCS), str(tmp_path / "none"))
    assert token_output.read_shards(empty, str(tmp_path / "none")).count() == 0


def test_segments(spark, tmp_path, enc):
    """A repeated id spreads over shards, a shard over segments; a shuffled read finds each record by the index."""
    rows = [(4, f"text {i} " * (i % 7), "x") for i in range(200)] + [(4, "same", "x")] * 3
    path = str(tmp_path / "out")
    manifest = token_output.write_shards(spark.createDataFrame(rows, "doc_id long, text string, th string"), path)
    segments = []
    for shard in {r.path for r in manifest.collect()}:
        index = np.fromfile(f"{shard}.idx", token_output.INDEX)
        at = list(range(0, len(index), 7)) + [len(index)]
        segments += [(int(shard.split("shard-")[1][:6]), shard, a, int(index["offset"][a]), b - a, int(index["n"][a:b].sum())) for a, b in zip(at, at[1:])]
        for k in (len(index) - 1, 0, len(index) // 2):
            assert len(token_output.read_record(path, shard, k)[1]) == index["n"][k]
    assert manifest.select("path").distinct().count() > 1
    a = token_output.read_shards(manifest, path).orderBy("start").collect()
    b = token_output.read_shards(spark.createDataFrame(segments, token_output._MANIFEST), path).orderBy("start").collect()
    assert a == b and len(a) == 203 and [r.start for r in a] == np.concatenate(([0], np.cumsum([r.n_tokens for r in a])))[:-1].tolist()


def test_damage_is_found():
    rec = token_output.frame(b"payload")
    assert bytes(token_output.unframe(rec, 0)[0]) == b"payload"
    for k in range(len(rec)):
        with pytest.raises(ValueError):
            token_output.unframe(rec[:k] + bytes([rec[k] ^ 1]) + rec[k + 1 :], 0) if k > 7 else token_output.unframe(bytes([rec[0] ^ 1]) + rec[1:], 0)


def test_cut():
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)] and packing.cut(1, 2048) == [(0, 1)]


def test_local_search_empties_bins():
    lengths = [6, 3, 3, 4, 4, 4, 7, 5]  # in 10s: 36 in all
    bins = packing.improve(packing.best_fit(lengths, 10), lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(8)) and all(sum(lengths[i] for i in b) <= 10 for b in bins) and len(bins) == 4
    start = [[0], [1, 2], [3, 4], [5], [6], [7]]
    assert len(packing.improve(start, lengths, 10)) == 4
    rng = np.random.default_rng(0)
    for n in (1, 2, 50, 400):
        own = rng.integers(1, 1200, n).tolist()
        first = packing.best_fit(own, 2048)
        last = packing.improve(first, own, 2048)
        assert sorted(i for b in last for i in b) == list(range(n)) and len(last) <= len(first) and max(sum(own[i] for i in b) for b in last) <= 2048
    halves = [1025] * 300  # nothing fits together: the search ends
    assert len(packing.improve(packing.best_fit(halves, 2048), halves, 2048)) == 300


def decreasing(lengths, capacity=2048):
    """Plain best fit, longest first, as the figure to reach."""
    return packing.best_fit(sorted(lengths, reverse=True), capacity)


def laid_out(got):
    """Sequences lie gapless from 0 and hold no more than fits; their fills."""
    o = got.sort_values(["sequence_id", "offset"])
    assert (o.groupby("sequence_id").length.cumsum() - o.length == o.offset).all()
    fill = o.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048
    return fill


def test_packing(spark, enc, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 60)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "of", "no."]) for _ in range(rng.randint(0, 1500))), "x") for i in range(200)] + [(500, "long " * 9000, "x"), (501, None, None), (502, "", "x"), (7, "twice", "x"), (7, "twice", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, deal_ string")
    got = packing.pack(packing.pieces(docs)).toPandas()
    assert sorted(got.columns) == sorted("doc_id piece start length ids_crc32 sequence_id offset".split())
    lengths = [n for _, t, _ in rows for _, n in packing.cut(len(plain(enc, t)) + 1, 2048)]
    assert sorted(got.length) == sorted(lengths) and len(laid_out(got)) <= len(decreasing(lengths)) + 2  # little is lost by groups of 60
    ids = np.array(plain(enc, rows[200][1]) + [0], "<u4")
    for r in got[got.doc_id == 500].itertuples():
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert packing.pack(packing.pieces(spark.createDataFrame([], DOCS))).count() == 0


def packed(spark, lengths):
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    got = packing.pack(spark.createDataFrame(rows, packing._PIECE)).toPandas()
    assert sorted(zip(got.doc_id, got.length)) == list(enumerate(lengths))
    return got


def test_groups_cost_no_sequences(spark, monkeypatch):
    """What the search finds over groups is no more than best fit, longest first, of all pieces at once."""
    monkeypatch.setattr(packing, "GROUP", 150)
    rng = np.random.default_rng(6)
    for own in (rng.permutation([675] * 600 + [23] * 40 + [1000] * 100), rng.integers(1, 1200, 900), rng.integers(600, 801, 900)):
        got = packed(spark, own.tolist())
        assert len(laid_out(got)) <= len(decreasing(own.tolist()))


def test_the_search_empties_bins(spark, monkeypatch):
    """Best fit in the order of arrival alone takes more sequences than the search leaves."""
    own = np.random.default_rng(2).integers(200, 1200, 1500).tolist()
    searched = len(laid_out(packed(spark, own)))
    monkeypatch.setattr(packing, "improve", lambda bins, lengths, capacity: bins)
    assert searched < len(packing.best_fit(own, 2048)) and searched <= -(-sum(own) // 2048) + 1


def test_long_pieces_stay_in_groups(spark, monkeypatch):
    """Pieces of which no two fit together never meet in one group."""
    monkeypatch.setattr(packing, "GROUP", 500)
    seen = []
    first = packing.common.staged
    monkeypatch.setattr(packing.common, "staged", lambda df, name: (lambda out: (name == "pieces" or seen.append(name), out)[1])(first(df, name)))
    got = packed(spark, np.random.default_rng(1).integers(1100, 1150, 3000).tolist())
    assert got.sequence_id.nunique() == 3000 and seen == ["packed", "searched1"]
    rows = spark.createDataFrame([(i, 0, 0, 1100 + i % 50, 0, i, 0, 1100 + i % 50) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long")
    assert packing._emptiest(rows) == 1107


def test_local_search_goes_on_after_stuck_bins():
    own = np.random.default_rng(0).integers(600, 801, 1000).tolist()
    first = packing.best_fit(own, 2048)
    last = packing.improve(first, own, 2048)
    assert sorted(i for b in last for i in b) == list(range(1000)) and max(sum(own[i] for i in b) for b in last) <= 2048
    assert len(last) <= 0.97 * len(first)
    again = packing._Bins([b for b in last if sum(own[i] for i in b) < 2048], own, 2048)
    assert not any(again.step(k) for k in range(len(again.items)))


def test_pairs_follow_the_swaps():
    """The pairs that a bin holds, kept in place, are those of its items after any steps."""
    own = np.random.default_rng(4).integers(100, 900, 300).tolist()
    found = packing._Bins(packing.best_fit(own, 2048), own, 2048)
    for low in np.argsort(found.fill, kind="stable").tolist():
        while 0 < found.fill[low] < 2048 and (s := found.step(low)):
            before = int((found.fill**2).sum())
            found.swap(low, *s)
            assert int((found.fill**2).sum()) > before
        for k, items in enumerate(found.items):
            held = found.two[:, found.at[k].start : found.at[k].stop]
            assert sorted(map(sorted, held.T.tolist())) == sorted([a, b] for i, a in enumerate(sorted(items)) for b in sorted(items)[i + 1 :])
            assert (found.two_bin[found.at[k].start : found.at[k].stop] == k).all() and found.fill[k] == sum(own[i] for i in items)
    assert (found.two_bin[: found.used] < len(found.items)).sum() == sum(map(len, found.at))


def test_groups_reach_the_bound(spark, monkeypatch):
    """Full bins that go on let the last groups reach as few sequences as the total needs."""
    monkeypatch.setattr(packing, "GROUP", 1000)
    own = np.random.default_rng(5).permutation(np.concatenate((np.random.default_rng(6).integers(1, 600, 2200), np.random.default_rng(7).integers(600, 1500, 800)))).tolist()
    assert len(laid_out(packed(spark, own))) == -(-sum(own) // 2048)
