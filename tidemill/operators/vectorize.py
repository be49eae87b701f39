"""Sliding windows over sequences and their k-mer compositions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import sequence as S
from tidemill.session import cut_lineage, free

_CODE = np.full(256, 4, np.int64)
_CODE[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3, 0, 1, 2, 3]


@lru_cache(maxsize=16)
def dimensions(k: int) -> tuple[np.ndarray, int]:
    """Dimension of each k-mer code (base 4, A C G T), and their number."""
    codes = np.arange(4**k)
    digits = (codes[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3
    turned = ((3 - digits[:, ::-1]) << (2 * np.arange(k - 1, -1, -1))).sum(1)
    _, dim = np.unique(np.minimum(codes, turned), return_inverse=True)
    return dim, int(dim.max()) + 1


def windows(df: DataFrame, width: int, step: int, seq: str = "seq") -> DataFrame:
    """df without its sequence, a row per window: win, win_from, win_to (half open). Trailing partial windows are dropped; a sequence shorter than the width gives one short window."""
    n = F.length(seq)
    out = df.withColumn("win", F.explode(F.sequence(F.lit(0), S.window_count(n, width, step) - 1)))
    return out.withColumns({"win_from": F.col("win") * step, "win_to": F.least(n, F.col("win") * step + width)}).drop(seq)


def compose(seq: str, k: int, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): canonical k-mer counts of each window; k-mers with another letter than ACGT aren't counted."""
    dim, d = dimensions(k)
    n = (len(seq) - width) // step + 1 if len(seq) >= width else 1
    starts = np.arange(n) * step
    ends = np.minimum(starts + width, len(seq))
    code = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    m = len(code) - k + 1
    out = np.zeros((n, d), np.int64)
    if m <= 0:
        return starts, ends, out
    value, good = np.zeros(m, np.int64), np.ones(m, bool)
    for i in range(k):
        part = code[i : i + m]
        value, good = value * 4 + part, good & (part < 4)
    at = np.flatnonzero(good)
    which = dim[value[at]]
    # a k-mer at p lies in the windows that start in (p + k - width, p]
    first = np.maximum(-(-(at + k - width) // step), 0)
    last = np.minimum(at // step, n - 1)
    for j in range(int((last - first).max(initial=-1)) + 1):
        w = first + j
        inside = (w <= last) & (at + k <= ends[np.minimum(w, n - 1)])
        np.add.at(out, (w[inside], which[inside]), 1)
    return starts, ends, out


def kmer_totals(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, n): how often all sequences hold each word of k letters ACGT, zeros included. Each task sends a count per word."""
    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(4**k, np.int64)
        for pdf in parts:
            for text in pdf["seq"]:
                code = _CODE[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
                m = len(code) - k + 1
                if m > 0:
                    value, good = np.zeros(m, np.int64), np.ones(m, bool)
                    for i in range(k):
                        value, good = value * 4 + code[i : i + m], good & (code[i : i + m] < 4)
                    total += np.bincount(value[good], minlength=4**k)
        yield pd.DataFrame({"code": np.arange(4**k), "n": total})

    counts = df.where(F.col(seq).isNotNull()).select(F.col(seq).alias("seq")).mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    words = S.all_kmers(df.sparkSession, k, "code")
    return words.join(counts, "code", "left").select("kmer", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _rows(keys: list[str], k: int, width: int | str, step: int | str, normalize: bool, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        out = []
        for row in pdf.itertuples(index=False):
            starts, ends, counts = compose(row.seq, k, *(int(getattr(row, x)) if isinstance(x, str) else x for x in (width, step)))
            vec = counts / np.maximum(counts.sum(1, keepdims=True), 1) if normalize else counts.astype(float)
            key = [getattr(row, c) for c in keys]
            out += [(*key, i, int(a), int(b), v) for i, (a, b, v) in enumerate(zip(starts, ends, vec))]
        yield pd.DataFrame(out, columns=[*keys, "win", "win_from", "win_to", "vec"])


def vectorize(df: DataFrame, k: int = 4, width: int | str = 1000, step: int | str = 500, normalize: bool = True, seq: str = "seq") -> DataFrame:
    """A row per window with vec, its composition over canonical k-mers in lexicographic order; rows sum to 1, or 0 without any k-mer.

    Width and step may name columns. One pass without an exchange; a window's k-mers never leave the task.
    """
    keys = [c for c in df.columns if c != seq]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + ["win int", "win_from int", "win_to int", "vec array<double>"])
    rows = df.where(F.col(seq).isNotNull()).select(*keys, S.to_dna5(F.col(seq)).alias("seq"))
    return rows.mapInPandas(partial(_rows, keys, k, width, step, normalize), schema)


def number_within(points: DataFrame, keys: list[str], order: list[str], name: str = "pid", total: str | None = None) -> DataFrame:
    """points with `name`, from 0 in the given order within rows alike in `keys`, and the number of these as `total`.

    Rows are dealt into ranges of keys and order and written once in that order, so a key of any size is
    ranked by many tasks: a row's rank is its place among its key's rows in its range, and what the ranges
    before hold of the key, which is a row per key and range.
    """
    at, part, first, base = (free(points, x) for x in ("at", "part", "first", "base"))
    kept = cut_lineage(points.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(at, F.monotonically_increasing_id()))
    kept = kept.withColumn(part, F.shiftright(at, 33).cast("int"))
    own = Window.partitionBy(*keys)
    held = kept.groupBy(part, *keys).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(own.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col(first)
    extra = [F.sum("n_").over(own).alias(total)] if total else []
    bases = held.select(part, *[F.col(k).alias(f"{k}_key") for k in keys], before.alias(base), *extra)
    same = [kept[part] == bases[part], *[kept[k].eqNullSafe(bases[f"{k}_key"]) for k in keys]]
    return kept.join(bases, same).select(*[kept[c] for c in points.columns], (F.col(base) + F.col(at)).alias(name), *([total] if total else []))


def number_points(points: DataFrame, *order: str) -> DataFrame:
    """points with pid, from 0 in the given order; rows alike in all of it are numbered in any order.

    Rows are dealt into ranges of the order, sorted there and written once with their place in the
    range; the ranges' sizes, a number each, make the places into numbers. No task sees all rows.
    """
    at, part = free(points, "at"), free(points, "part")
    ranged = points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    kept = cut_lineage(ranged)  # one copy: a second run of the exchange may cut the ranges elsewhere
    place = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(tuple(r) for r in kept.groupBy(F.shiftright(at, 33).cast("int").alias(part)).count().collect())
    base, total = [], 0
    for p, n in sizes:
        base.append((p, total))
        total += n
    bases = points.sparkSession.createDataFrame(base, f"{part} int, pid long")
    out = kept.withColumn(part, F.shiftright(at, 33).cast("int")).join(F.broadcast(bases), part)  # a row per range
    return out.withColumn("pid", F.col("pid") + place).select(*points.columns, "pid")
