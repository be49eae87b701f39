"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through vectors of low rank; the sum over pairs is half of the
square of the sums less the sum of the squares, so a text is scored in time linear in its features.
The machine is fitted on the driver from at most `most` labelled rows; scoring needs no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

BUCKETS = 2048
RANK = 8
#: Labelled rows that the machine is fitted on, at most; those of the smallest hash.
SAMPLE = 6000

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\v\f", "line": b"\n", "stop": b".,;:?'\"()-", "loud": b"!", "bar": b"|", "sign": b"#$%&*+/<=>@[\\]^_`{}~"}
_TABLE = np.zeros(256, np.int8)
for _i, _chars in enumerate(_CLASSES.values(), 1):
    _TABLE[np.frombuffer(_chars, np.uint8)] = _i
STATS = 6 + len(_CLASSES)


def features(texts: list[bytes], n_chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the texts in turn, in parts: hashed words as (rows, BUCKETS) of unit length, and statistics (rows, STATS)."""
    for first, part in wordhash.batched(texts, most=1 << 19, rows=256):
        n = len(part)
        of, start, end, h = wordhash.words(part)
        words = np.bincount(of, minlength=n).astype(np.float64)
        bag = np.bincount(of * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
        distinct = (bag > 0).sum(1)
        bag = np.log1p(bag.astype(np.float32))
        bag /= np.maximum(np.sqrt((bag * bag).sum(1, keepdims=True)), 1e-9)
        size = np.fromiter(map(len, part), np.int64, n)
        data = _TABLE[np.frombuffer(b" ".join(part) + b" ", np.uint8)]
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        shares = [np.add.reduceat(data == k, begin, dtype=np.int64) / (size + 1) for k in range(1, len(_CLASSES) + 1)]
        length = np.bincount(of, end - start, minlength=n)
        stats = [np.log1p(size), np.log1p(words), length / np.maximum(words, 1), distinct / np.maximum(words, 1), np.log1p(size / (1 + shares[3] * (size + 1))), np.log1p(np.maximum(n_chars[first : first + n], 0))]
        yield bag, np.stack(stats + shares, 1)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def join(self, bag: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.concatenate((bag, np.clip((stats - self.mean) / self.std, -4, 4) * 0.25), 1).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.linear + 0.5 * (((x @ self.factors) ** 2).sum(1) - ((x * x) @ (self.factors * self.factors)).sum(1))

    def score(self, bag: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.join(bag, stats)).astype(np.float64), -30, 30)))


def fit(bag: np.ndarray, stats: np.ndarray, y: np.ndarray, epochs: int = 20, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Logistic loss by Adam. Without both labels the machine returns their prior, 0.5 without any row."""
    rng = np.random.default_rng(seed)
    width = BUCKETS + STATS
    m = Machine(0.0, np.zeros(width, np.float32), np.zeros((width, RANK), np.float32), np.zeros(STATS), np.ones(STATS))
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        m.bias = float(np.log(p / (1 - p)))
        return m
    m.mean, m.std = stats.mean(0), stats.std(0) + 1e-6
    x = m.join(bag, stats)
    m.factors = rng.normal(0, 0.05, (width, RANK)).astype(np.float32)
    state = {k: [0.0, 0.0] for k in ("bias", "linear", "factors")}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            rows = order[at : at + 256]
            xb = x[rows]
            s = xb @ m.factors
            g = (1 / (1 + np.exp(-np.clip(m.logits(xb), -30, 30))) - y[rows]).astype(np.float32) / len(rows)
            grads = {"bias": g.sum(), "linear": xb.T @ g + decay * m.linear, "factors": xb.T @ (g[:, None] * s) - ((xb * xb).T @ g)[:, None] * m.factors + decay * m.factors}
            step += 1
            for k, grad in grads.items():
                a = state[k]
                a[0], a[1] = 0.9 * a[0] + 0.1 * grad, 0.99 * a[1] + 0.01 * grad * grad
                setattr(m, k, getattr(m, k) - rate * (a[0] / (1 - 0.9**step)) / (np.sqrt(a[1] / (1 - 0.99**step)) + 1e-7))
    m.bias = float(m.bias)
    return m


def held_out(doc_id: Column, fold: int = 3, at: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == at, F.lit(False))


def _sparse(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        texts = [t.encode() if t else b"" for t in pdf["text"]]
        out, at = [], 0
        for bag, stats in features(texts, pdf["n_chars"].to_numpy(np.float64)):
            for b, s in zip(bag, stats):
                k = np.flatnonzero(b)
                out.append((int(pdf["o"].iloc[at]), int(pdf["y"].iloc[at]), k.astype("<u2").tobytes(), b[k].astype("<f4").tobytes(), s.astype("<f8").tobytes()))
                at += 1
        yield pd.DataFrame(out, columns=["o", "y", "k", "v", "s"])


def _inputs(docs: DataFrame) -> list[Column]:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return [F.col("text"), F.coalesce(chars, F.length("text").cast("double"), F.lit(0.0)).alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Machine:
    """Fit on rows of up to `most` ids of docs with one non-null label outside the held-out fold, twice as many rows at most.

    Contradicting labels don't count, nor do null ids; null texts are empty, repeated rows count as
    often as they are there, those of the smallest hash first. Other columns, whatever their names, are not read.
    """
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
        .where("y = z").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("y").cast("int").alias("y"))
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs)).join(F.broadcast(known), "doc_id")  # at most `most` rows
    rows = rows.select("text", "n_chars", "y", F.xxhash64("doc_id", "text", "n_chars").alias("o"))
    got = rows.mapInPandas(_sparse, "o long, y int, k binary, v binary, s binary").orderBy("o", "y").limit(2 * most).collect()
    bag = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        bag[i, np.frombuffer(r.k, "<u2")] = np.frombuffer(r.v, "<f4")
    stats = np.array([np.frombuffer(r.s, "<f8") for r in got]).reshape(len(got), STATS)
    return fit(bag, stats, np.array([r.y for r in got], np.float32))


def with_score(docs: DataFrame, machine: Machine, name: str = "quality_score") -> DataFrame:
    """docs and a column `name`, 0 to 1; null text is scored as the empty one, null n_chars as the text's length.

    Rows are scored one by one, whole texts of any length: repeated rows get the same score, an empty
    table stays empty. All other columns pass through; one that is named `name` is replaced.
    """
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        common.trim()
        for text, n_chars in parts:
            got = [machine.score(*x) for x in features([t.encode() if t else b"" for t in text], n_chars.to_numpy(np.float64))]
            yield pd.Series(np.concatenate(got) if got else np.empty(0))

    udf = F.pandas_udf(scored, "double")
    return docs.withColumn(name, udf(*_inputs(docs)))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every text of `documents`, learnt from `labels`."""
    docs = common.table(spark, sf_dir, "documents")
    machine = train(docs, common.table(spark, sf_dir, "labels"))
    return with_score(docs.select("doc_id", "text", "n_chars"), machine, "score").select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
