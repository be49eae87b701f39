"""Language of texts: a bidirectional gated recurrent network over bytes.

Whole texts are cut into windows of `WINDOW` bytes that run through the network side by side, each with
`LAP` bytes more of the text before and after it, so that the states of either direction know what
comes before they count; every position gets language probabilities, and a text's are the mean over
all its positions. The network is trained on the driver, in numpy, by backpropagation through time
over a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, quality, wordhash

#: Bytes of a window that count, of its overlap on either side, and of all; null bytes stand before and after a text.
WINDOW, LAP = 64, 8
SPAN = WINDOW + 2 * LAP
HIDDEN = 8
#: Texts of each language that windows are taken from, at most: SALTS times EACH.
SALTS, EACH = 64, 10
#: Windows taken from a text, at most.
CUTS = 4
_AT_ONCE = 4096


def _counts(size: np.ndarray) -> np.ndarray:
    """(SPAN, n): the positions of windows that count, of each the first `size` after the overlap."""
    at = np.arange(SPAN)[:, None] - LAP
    return (at >= 0) & (at < size)


def _cell(x: np.ndarray, h: np.ndarray, w: dict[str, np.ndarray], d: str) -> tuple[np.ndarray, ...]:
    u = h @ w["u" + d]
    pre = w["x" + d][x]
    k = h.shape[1]
    gates = 0.5 * np.tanh(0.5 * (pre[:, : 2 * k] + u[:, : 2 * k])) + 0.5
    z, r = gates[:, :k], gates[:, k:]
    inner = u[:, 2 * k :] + w["c" + d]
    n = np.tanh(pre[:, 2 * k :] + r * inner)
    return n + z * (h - n), z, r, n, inner


class Network:
    """w: per direction f and b the input table x (256, 3H), the recurrent matrix u (H, 3H) and c (H); out (2H, L), off (L)."""

    def __init__(self, langs: list[str], w: dict[str, np.ndarray]):
        self.langs, self.w = langs, w

    @classmethod
    def new(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Network:
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
            w["u" + d] = rng.normal(0, 0.4 / np.sqrt(hidden), (hidden, 3 * hidden))
            w["c" + d] = np.zeros(hidden)
        w["out"], w["off"] = rng.normal(0, 0.3, (2 * hidden, len(langs))), np.zeros(len(langs))
        return cls(langs, {k: v.astype(np.float32) for k, v in w.items()})

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(WINDOW, L, N) probabilities for windows x of (SPAN, N) bytes, at the positions after the overlap.

        Both directions go side by side, each from its overlap to the last position that counts. In place
        of a state h there is g = (1 - h) / 2, and of new contents n there is s = (1 - n) / 2: s is a
        logistic function as the gates are, and h' = n + z (h - n) says g' = s + z (g - s).
        """
        w, n = self.w, x.shape[1]
        k = w["cf"].shape[0]
        scale = np.array([-1, -1, 2], np.float32)[:, None, None]
        table, u = (np.stack([np.stack(np.split(w[a + d], 3, 1)) * scale for d in "fb"], 1) for a in "xu")  # (3, 2, 256 or H, H) by gate and direction
        rest = u.sum(2, keepdims=True)
        table[:2] += rest[:2]
        inner = np.repeat(rest[2] + 2 * np.stack((w["cf"], w["cb"]))[:, None], n, 1)  # in full, since numpy repeats short rows slowly
        table, first = table.reshape(-1, k), 256 * np.arange(6).reshape(3, 2, 1)
        u *= -2
        out = -2 * np.stack((w["out"][:k].T, w["out"][k:].T))
        logits = np.empty((WINDOW, len(self.langs), n), np.float32)
        logits[:] = (w["off"] + w["out"].sum(0))[:, None]
        g, s, pre, rec = np.full((2, n, k), 0.5, np.float32), np.empty((2, n, k), np.float32), np.empty((3, 2, n, k), np.float32), np.empty((3, 2, n, k), np.float32)
        own, at = np.empty((2, len(self.langs), n), np.float32), np.empty((3, 2, n), np.intp)
        gates = rec[:2]
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is the 0 meant
            for t in range(LAP + WINDOW):
                np.add(x[[t, SPAN - 1 - t]], first, out=at)
                np.take(table, at, axis=0, out=pre, mode="clip")  # all are there: "clip" only spares a copy
                np.matmul(g, u, out=rec)
                gates += pre[:2]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.add(rec[2], inner, out=s)
                s *= gates[1]
                s += pre[2]
                np.exp(s, out=s)
                s += 1
                np.reciprocal(s, out=s)
                g -= s
                g *= gates[0]
                g += s
                if t >= LAP:
                    np.matmul(out, g.transpose(0, 2, 1), out=own)
                    logits[t - LAP] += own[0]
                    logits[LAP + WINDOW - 1 - t] += own[1]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions of mask (T, N) and its gradients, by backpropagation through time."""
        w, (steps, n) = self.w, x.shape
        k = w["cf"].shape[0]
        kept, hs = {}, {}
        for d, order in (("f", list(range(steps))), ("b", list(range(steps - 1, -1, -1)))):
            h, kept[d], hs[d] = np.zeros((n, k), np.float32), [None] * steps, np.empty((steps, n, k), np.float32)
            for t in order:
                new, z, r, m, inner = _cell(x[t], h, w, d)
                kept[d][t] = (h, z, r, m, inner)
                hs[d][t] = h = new
        both = np.concatenate((hs["f"], hs["b"]), 2)
        logits = both @ w["out"] + w["off"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        total = max(mask.sum(), 1)
        loss = -float((np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (steps, n, 1)), 2)[..., 0] + 1e-9) * mask).sum() / total)
        dl = p
        dl[:, np.arange(n), y] -= 1
        dl *= mask[:, :, None] / total
        g = {a: np.zeros_like(v) for a, v in w.items()}
        g["off"] = dl.sum((0, 1))
        g["out"] = both.reshape(-1, 2 * k).T @ dl.reshape(-1, dl.shape[2])
        dboth = dl @ w["out"].T
        for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            dh = np.zeros((n, k), np.float32)
            pres = np.empty((steps, n, 3 * k), np.float32)
            for t in order:
                h, z, r, m, inner = kept[d][t]
                dh = dh + (dboth[t][:, :k] if d == "f" else dboth[t][:, k:])
                dm = dh * (1 - z) * (1 - m * m)
                dz = dh * (h - m) * z * (1 - z)
                dr = dm * inner * r * (1 - r)
                du = np.concatenate((dz, dr, dm * r), 1)
                pres[t] = np.concatenate((dz, dr, dm), 1)
                g["c" + d] += (dm * r).sum(0)
                g["u" + d] += h.T @ du
                dh = dh * z + du @ w["u" + d].T
            np.add.at(g["x" + d], x.reshape(-1), pres.reshape(-1, 3 * k))
        return loss, g

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, L): mean probabilities over all positions of each text; zeros for an empty one."""
        out = np.zeros((len(texts), len(self.langs)))
        for first, part in wordhash.batched(texts, most=_AT_ONCE * WINDOW, rows=_AT_ONCE):
            size = np.fromiter(map(len, part), np.int64, len(part))
            rows = -(-size // WINDOW)
            of = np.repeat(np.arange(len(part)), rows)
            if not len(of):
                continue
            begin = np.concatenate(([0], np.cumsum(rows)))
            first_byte = begin[:-1] * WINDOW + 2 * LAP * np.arange(len(part)) + LAP  # texts stand apart, so that none overlaps another
            data = np.zeros(len(of) * WINDOW + 2 * LAP * len(part), np.uint8)
            for t, at in zip(part, first_byte):
                data[at : at + len(t)] = np.frombuffer(t, np.uint8)
            nth = np.arange(len(of)) - begin[of]
            left = np.minimum(size[of] - nth * WINDOW, WINDOW)
            start = first_byte[of] + nth * WINDOW - LAP
            sums = np.empty((len(of), len(self.langs)))
            for own in np.array_split(np.arange(len(of)), -(-len(of) // _AT_ONCE)):
                p = self.positions(data[start[own] + np.arange(SPAN)[:, None]])
                p *= (np.arange(WINDOW)[:, None] < left[own])[:, None]
                sums[own] = p.sum(0).T
            for j in range(len(self.langs)):
                out[first : first + len(part), j] = np.bincount(of, sums[:, j], minlength=len(part)) / np.maximum(size, 1)
        return out


def fit(windows: np.ndarray, y: np.ndarray, sizes: np.ndarray, langs: list[str], steps: int = 500, batch: int = 192, rate: float = 0.02, hidden: int = HIDDEN, seed: int = 11) -> Network:
    """Adam over batches that draw every language alike; windows (n, SPAN), of which `sizes` bytes after the overlap count."""
    rng = np.random.default_rng(seed)
    net = Network.new(langs, hidden, rng)
    rows = [np.flatnonzero(y == j) for j in range(len(langs))]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    for i in range(1, steps + 1):
        pick = np.concatenate([rng.choice(r, -(-batch // len(langs))) for r in rows])
        x = np.ascontiguousarray(windows[pick].T)
        _, g = net.step(x, y[pick], _counts(sizes[pick]).astype(np.float32))
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        now = rate * min(1.0, 1.5 - i / steps)
        for k, a in g.items():
            a = a * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            net.w[k] = (net.w[k] - now * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return net


def _cuts(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Up to CUTS windows of each text, spread over all of it, with their overlaps."""
    for pdf in rows:
        out = []
        for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
            data = text.encode()
            n = max(1, min(CUTS, len(data) // WINDOW))
            around = bytes(LAP) + data + bytes(LAP)
            for i in range(n):
                at = i * (len(data) - WINDOW) // max(n - 1, 1) if len(data) > WINDOW else 0
                out.append((doc, i, lang, min(len(data) - at, WINDOW), around[at : at + SPAN]))
        yield pd.DataFrame(out, columns=["doc_id", "i", "lang", "size", "data"])


def train(docs: DataFrame, each: int = EACH) -> Network | None:
    """Learn from text and non-null lang outside the held-out fold (crc32(doc_id) mod 4 is 2); None without any.

    SALTS * each ids of a language are drawn by hash, and of their windows, where ids repeat, four times
    as many at most as these ids can have. Null ids and texts without a letter don't count; other columns, whatever
    their names, are not read.
    """
    from pyspark.sql import Window

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~quality.held_out(F.col("doc_id"), 4, 2) & F.col("doc_id").isNotNull())
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), F.xxhash64("doc_id", F.lit(5)).alias("o"))
    ids = ids.withColumn("k", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("o", "doc_id"))).where(F.col("k") <= each).select("doc_id").distinct()
    chosen = [r.doc_id for r in ids.collect()]  # SALTS * each rows of a language at most
    if not chosen:
        return None
    few = docs.sparkSession.createDataFrame([(x,) for x in chosen], "doc_id long")
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(F.broadcast(few), "doc_id")
    got = own.mapInPandas(_cuts, "doc_id long, i int, lang string, size int, data binary").orderBy("doc_id", "lang", "i", "data").limit(4 * CUTS * len(chosen)).collect()
    langs = sorted({r.lang for r in got})
    data = np.zeros((len(got), SPAN), np.uint8)
    for i, r in enumerate(got):
        data[i, : len(r.data)] = np.frombuffer(r.data, np.uint8)
    return fit(data, np.array([langs.index(r.lang) for r in got]), np.array([r.size for r in got]), langs)


def with_language(docs: DataFrame, net: Network | None, lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the most probable language and its mean probability; `und` and 0 if text is null or has no letter.

    A text of any length is read whole. Ties go to the language that sorts first; repeated rows get the
    same answer; empty tables stay empty. All other columns pass through; those named `lang` and `score` are replaced.
    """
    def said(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in parts:
            p = net.pooled([t.encode() if t else b"" for t in text])
            best = p.argmax(1) if len(p) else np.empty(0, int)
            yield pd.DataFrame({"l": pd.Series([net.langs[j] for j in best], dtype=object), "s": np.clip(p.max(1), 0, 1) if len(p) else np.empty(0)})

    if net is None:
        return docs.withColumns({lang: F.lit("und"), score: F.lit(0.0)})
    udf = F.pandas_udf(said, "l string, s double")
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    said_ = common.free(docs, "said")
    out = docs.withColumn(said_, udf("text"))
    return out.withColumns({lang: F.when(known, F.col(f"{said_}.l")).otherwise("und"), score: F.when(known, F.col(f"{said_}.s")).otherwise(0.0)}).drop(said_)


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Language of every text of `documents`."""
    docs = common.table(spark, sf_dir, "documents")
    net = train(docs.select("doc_id", "text", "lang"))
    return with_language(docs.select("doc_id", "text"), net, "lang_pred", "score").select(
        F.col("doc_id").cast("long").alias("doc_id"), quality.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score"
    )
