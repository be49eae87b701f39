"""N-gram Jaccard join by vertical partitioning.

The order of all n-grams is the order of their hashes, cut into fragments of even ranges. Texts are
cut along it: a fragment's task gets the part of every text that falls into its range, as packed
bytes, counts in how many texts each n-gram occurs and drops those of one text, which no pair can
share. N-grams that very many texts hold would fill their fragment; a first pass over all texts, which
sends one occurrence in RATE, drawn by a hash of n-gram and id, finds them. They need no counting, since
all are last in order, and go past the fragments. Where there are more fragments than what a task holds
could fill with more than a few n-grams each, two exchanges lead to them, and likewise back to the texts.
A text that keeps less than the threshold of its n-grams has
no partner and goes. The rest are ordered rarest first; only the head of a text that a partner must
touch (prefix filter) proposes candidates, and sizes and places in the order sieve them. Candidates
are counted fragment by fragment, and the partial overlaps are summed per pair.

Texts of the same words are one class from the start. What is asked for is components, so links are
first proposed to one hub per n-gram, which joins groups of near copies without their pairs; then the
components that an n-gram still holds are joined with each other, never a component with itself, so no
pair of texts in one component is made and no link between components is lost.

An n-gram is known by 64 bits of its hash, of which the fragment's number holds the first eight or
more. A text is known by 128 bits of its words' hash: 64 of them are its key, and where the first pass
finds two texts of one key, the other 64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, wordhash

SHINGLE = 5
PERCENT = 75
#: Shingles of a fragment, about, and of what a task holds before it sends them.
FRAGMENT, FLUSH = 1_500_000, 400_000
#: Of so many occurrences of shingles the first pass sends one.
RATE = 4096
#: Texts with a shingle from which on it goes past the fragments; with so many parts of all shingles, or more, at the least.
HOT, SHARE = FRAGMENT // 8, 1_000_000
#: Ways that one exchange deals shingles out, as a power of 2 (8 or more), bytes that a task of a second one deals at once, and its most partitions.
WAYS, DEALT, PARTS = 12, 32 << 20, 1 << 16
#: Bits of a text's first key.
KEY = 64
#: Parts of the order in which overlaps are counted, as a power of 2.
PIECES = 3
EARLIER = 128
#: Texts of one component and shingle that meet those of another component at once.
TOGETHER = 64
#: Bytes of a hash that are sent; the fragment gives the rest.
_SHORT = 7
_MOST = 65535
_SENT = "frag long, bucket int, blob binary"
_SETS = "key long, n int, piece int, skip int, part array<long>"


def _narrow(h: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")[:, None].view(np.uint8)[:, :width]).tobytes()


def _wide(data: bytes | memoryview, width: int, top: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8")[:, 0].astype(np.uint64) | np.uint64(top)


def _blob(of: np.ndarray, keys: np.ndarray, h: np.ndarray, df: np.ndarray | None = None) -> bytes:
    """Shingles h of texts `of`, in runs of 255 at most: per run the text's key and a byte for its length; with `df` also in how many texts they occur."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(of) != 0)))
    nth = np.arange(len(of)) - np.repeat(first, np.diff(np.concatenate((first, [len(of)]))))
    first = np.flatnonzero(nth % 255 == 0)
    count = np.diff(np.concatenate((first, [len(of)])))
    return b"".join((np.array([len(first)], "<u8").tobytes(), keys[of[first]].astype("<u8").tobytes(), count.astype(np.uint8).tobytes(), _narrow(h, _SHORT), b"" if df is None else np.minimum(df, _MOST).astype("<u2").tobytes()))


def _unblob(blob: bytes, top: int, with_df: bool = False) -> tuple[np.ndarray, ...]:
    """(keys, lengths, shingles) of the runs, and df on demand."""
    k = int(np.frombuffer(blob, "<u8", 1)[0])
    keys, count = np.frombuffer(blob, "<u8", k, 8), np.frombuffer(blob, np.uint8, k, 8 + 8 * k).astype(np.int64)
    at, total = 8 + 9 * k, int(count.sum())
    h = _wide(memoryview(blob)[at : at + _SHORT * total], _SHORT, top)
    return (keys, count, h, np.frombuffer(blob, "<u2", total, at + _SHORT * total)) if with_df else (keys, count, h)


def _past(keys: np.ndarray, n: np.ndarray, count: np.ndarray, h: np.ndarray) -> bytes:
    """What goes past the fragments: keys of texts, sizes of their sets, how many hot shingles each has, and these."""
    return b"".join((np.array([len(keys)], "<u8").tobytes(), keys.astype("<u8").tobytes(), n.astype("<u4").tobytes(), count.astype("<u4").tobytes(), h.astype("<u8").tobytes()))


def _unpast(blob: bytes) -> tuple[np.ndarray, ...]:
    k = int(np.frombuffer(blob, "<u8", 1)[0])
    return np.frombuffer(blob, "<u8", k, 8), np.frombuffer(blob, "<u4", k, 8 + 8 * k).astype(np.int64), np.frombuffer(blob, "<u4", k, 8 + 12 * k).astype(np.int64), np.frombuffer(blob, "<u8", -1, 8 + 16 * k)


def _top(frag: int, bits: int) -> int:
    """The first eight bits of the hashes of a fragment."""
    return (frag >> (bits - 8)) << 56


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values."""
    edge = np.flatnonzero(np.diff(x)) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(x)])) if len(x) else []


def _identity(text: bytes, key_bits: int = KEY) -> tuple[int, int]:
    """A text's key and the 64 bits that tell texts of one key apart."""
    both = blake2b(b" ".join(text.lower().split()), digest_size=16).digest()
    return int.from_bytes(both[:8], "little") >> (64 - key_bits), int.from_bytes(both[8:], "little")


def _first_pass(rate: int, key_bits: int, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch: h, n of the shingles drawn; key, other of its texts; and without either the number n of all its shingles."""
    common.trim()
    for pdf in parts:
        ids = wordhash.mix(pdf["doc_id"].to_numpy(np.int64).view(np.uint64))
        for first, part in wordhash.batched((t.encode() if t else b"" for t in pdf["text"]), 1 << 19):
            own = wordhash.sets(part, SHINGLE)
            h = np.concatenate(own)
            drawn = wordhash.mix(h ^ np.repeat(ids[first : first + len(part)], [len(x) for x in own])) % np.uint64(rate) == 0
            found, n = np.unique(h[drawn], return_counts=True)
            keys = np.array(sorted({_identity(t, key_bits) for t, x in zip(part, own) if len(x)}), np.uint64).reshape(-1, 2).view(np.int64)
            kind = np.repeat([0, 1, 2], [len(found), len(keys), 1])
            padded = lambda x, k: np.pad(x, (np.searchsorted(kind, k), len(kind) - np.searchsorted(kind, k, "right")))
            yield pd.DataFrame({
                "h": pd.arrays.IntegerArray(padded(found.view(np.int64), 0), kind != 0), "n": padded(n, 0) + padded(np.array([len(h)]), 2),
                "key": pd.arrays.IntegerArray(padded(keys[:, 0], 1), kind != 1), "other": padded(keys[:, 1], 1),
            })


def _cut(bits: int, buckets: int, key_bits: int, hot_bc, clashing: frozenset[int], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text's shingles cut along the fragments.

    Texts' ids, keys and sizes, and the hot shingles, go past them: under numbers below 0, one for each
    time that a task sends, so that they are never gathered there. What is asked for by text (its size
    and hot shingles) is dealt out by its key.
    """
    from pyspark import TaskContext

    common.trim()
    hot = hot_bc.value
    held: dict[int, np.ndarray] = {}
    docs: list[tuple[int, bool, int, int]] = []
    size, turn = 0, -1 - (TaskContext.get().partitionId() << 24)

    def send() -> pd.DataFrame:
        ids, gone, keys, ns = (np.array(x, kind) for x, kind in zip(zip(*docs), (np.int64, np.uint8, np.uint64, np.int64)))
        out = [(turn, -1, b"".join((np.array([len(ids)], "<u8").tobytes(), ids.astype("<i8").tobytes(), keys.astype("<u8").tobytes(), ns.astype("<i8").tobytes(), gone.tobytes())))]
        own = {k: s for k, s in held.items() if len(s)}
        if own:
            keys = np.array(list(own), np.uint64)
            n = np.fromiter(map(len, own.values()), np.int64, len(own))
            h, of = np.concatenate(list(own.values())), np.repeat(np.arange(len(own)), n)
            is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
            bucket = (keys % np.uint64(buckets)).astype(np.int64)
            hot_h, hot_of = h[is_hot], of[is_hot]
            many = np.bincount(hot_of, minlength=len(keys))
            order = np.argsort(bucket, kind="stable")
            for lo, hi in _cuts(bucket[order]):
                t = order[lo:hi]
                out.append((turn, int(bucket[t[0]]), _past(keys[t], n[t], many[t], np.concatenate([hot_h[a:b] for a, b in zip(*(np.searchsorted(hot_of, t + k) for k in (0, 1)))]) if len(hot_h) else hot_h)))
            h, of = h[~is_hot], of[~is_hot]
            frag = (h >> np.uint64(64 - bits)).astype(np.uint32)
            order = np.argsort(frag.astype(np.uint16) if bits <= 16 else frag, kind="stable")
            frag, h, of = frag[order], h[order], of[order]
            out += [(int(frag[lo]), -1, _blob(of[lo:hi], keys, h[lo:hi])) for lo, hi in _cuts(frag)]
        return pd.DataFrame(out, columns=["frag", "bucket", "blob"])

    for pdf in parts:
        texts = (t.encode() if t else b"" for t in pdf["text"])
        ids, gone = pdf["doc_id"].tolist(), pdf["gone"].tolist()
        for first, part in wordhash.batched(texts, 1 << 19):
            for i, (text, s) in enumerate(zip(part, wordhash.sets(part, SHINGLE)), first):
                key, other = _identity(text, key_bits)
                key = other if key in clashing else key
                docs.append((ids[i], gone[i], key, len(s)))
                if key not in held:
                    held[key] = s
                    size += len(s)
            if size >= FLUSH:
                yield send()
                held, docs, size, turn = {}, [], 0, turn - 1
    if docs:
        yield send()


def _regrouped(cut: Callable[[list[tuple[int, bytes]]], pd.DataFrame], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed rows, which come in order, cut anew about DEALT bytes at a time. What is below 0 passes through."""
    common.trim()
    held, size = [], 0
    for pdf in parts:
        past = pdf["frag"] < 0
        if past.any():
            yield pdf[past]
        for frag, blob in zip(pdf["frag"][~past], pdf["blob"][~past]):
            held.append((int(frag), blob))
            size += len(blob)
            if size >= DEALT:
                yield cut(held)
                held, size = [], 0
    if held:
        yield cut(held)


def _texts_of(got: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts in what _unblob gave, and each shingle's text among them."""
    return np.unique(np.repeat(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])), return_inverse=True)


def _finer(bits: int, to: int, held: list[tuple[int, bytes]]) -> pd.DataFrame:
    """Fragments of `to` bits from those of `bits`. A text that several tasks sent is whole in each part and becomes one."""
    got = [_unblob(b, _top(f, bits)) for f, b in held]
    (keys, of), h = _texts_of(got), np.concatenate([g[2] for g in got])
    frag = (h >> np.uint64(64 - to)).astype(np.int64)
    order = np.lexsort((h, of, frag))
    frag, of, h = frag[order], of[order], h[order]
    keep = np.concatenate(([True], (np.diff(h) != 0) | (np.diff(of) != 0)))
    frag, of, h = frag[keep], of[keep], h[keep]
    return pd.DataFrame([(int(frag[lo]), -1, _blob(of[lo:hi], keys, h[lo:hi])) for lo, hi in _cuts(frag)], columns=["frag", "bucket", "blob"])


def _dealt(bits: int, buckets: int, held: list[tuple[int, bytes]]) -> pd.DataFrame:
    """Counted shingles of few buckets dealt out to all; a row has those of one bucket whose first eight bits are the same."""
    got = [_unblob(b, _top(f, bits), True) for f, b in held]
    (keys, of), h, df = _texts_of(got), np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
    bucket, top = (keys % np.uint64(buckets)).astype(np.int64)[of], (h >> np.uint64(56)).astype(np.int64)
    order = np.lexsort((of, top, bucket))
    of, h, df, bucket, top = of[order], h[order], df[order], bucket[order], top[order]
    return pd.DataFrame([(int(top[lo]) << (bits - 8), int(bucket[lo]), _blob(of[lo:hi], keys, h[lo:hi], df[lo:hi])) for lo, hi in _cuts(bucket << 8 | top)], columns=["frag", "bucket", "blob"])


def _spread(df: DataFrame, by: str, parts: int) -> DataFrame:
    """Packed rows over `parts` tasks, those of one number over several, in order of the numbers."""
    return df.repartition(parts, by, F.pmod(F.xxhash64("blob"), F.lit(max(1, parts >> WAYS)))).sortWithinPartitions(by)


def _count(bits: int, buckets: int, group: pd.DataFrame) -> pd.DataFrame:
    """A fragment: drop shingles of one text, deal the rest out by text. What is below 0 passes through."""
    frag = int(group["frag"].iloc[0])
    if frag < 0:
        return group
    got = [_unblob(b, _top(frag, bits)) for b in group["blob"]]
    sent = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    keys, count, h = (np.concatenate(x) for x in zip(*got))
    del got
    keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
    once = sent == sent[first][at]  # a class sent several times counts once
    h, of = h[np.repeat(once, count)], np.repeat(at[once], count[once])
    order = np.argsort(h, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(h[order]) != 0)))
    many = np.diff(np.concatenate((edge, [len(h)])))
    df = np.empty(len(h), np.int64)
    df[order] = np.repeat(many, many)
    keep = df > 1
    h, df, of = h[keep], df[keep], of[keep]
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((of, bucket[of]))
    h, df, of = h[order], df[order], of[order]
    out = [(frag, int(bucket[of[lo]]), _blob(of[lo:hi], keys, h[lo:hi], df[lo:hi])) for lo, hi in _cuts(bucket[of])]
    return pd.DataFrame(out, columns=["frag", "bucket", "blob"])


def least_shared(n: np.ndarray) -> np.ndarray:
    return -(-PERCENT * n // 100)


def _gather(bits: int, group: pd.DataFrame) -> pd.DataFrame:
    """A bucket of texts: drop those that can't have a partner; rows of the prefix (piece -1) and of the pieces."""
    known = [_unpast(b) for f, b in zip(group["frag"], group["blob"]) if f < 0]
    got = [_unblob(b, _top(int(f), bits), True) for f, b in zip(group["frag"], group["blob"]) if f >= 0]
    keys, at = np.unique(np.concatenate([g[0] for g in known]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    n[at] = np.concatenate([g[1] for g in known])
    of = np.concatenate((np.repeat(at, np.concatenate([g[2] for g in known])), *(np.repeat(np.searchsorted(keys, g[0]), g[1]) for g in got)))
    h, df = np.concatenate([g[3] for g in known] + [g[2] for g in got]), np.concatenate([np.full(len(g[3]), _MOST, np.uint16) for g in known] + [g[3] for g in got])
    del known, got
    if not len(h):
        return pd.DataFrame(columns=["key", "n", "piece", "skip", "part"])
    order = np.lexsort((h, df, of))
    h, of = h[order], of[order]
    keep = np.concatenate(([True], (np.diff(h) != 0) | (np.diff(of) != 0)))  # what went past the fragments may come from several tasks
    h, of = h[keep], of[keep]
    shared = np.bincount(of, minlength=len(keys)).astype(np.int64)
    lo = np.searchsorted(of, np.arange(len(keys) + 1))
    out = []
    for k in np.flatnonzero(shared >= least_shared(n)):
        own = h[lo[k] : lo[k + 1]]
        key, single = int(keys[k].astype(np.int64)), int(n[k] - shared[k])
        out.append((key, int(n[k]), -1, single, own[: int(n[k] - least_shared(n[k]) + 1 - single)].view(np.int64)))
        own = np.sort(own)
        piece = (own >> np.uint64(64 - PIECES)).astype(np.int64)
        cuts = np.searchsorted(piece, np.arange((1 << PIECES) + 1))
        out += [(key, int(n[k]), p, single, own[cuts[p] : cuts[p + 1]].view(np.int64)) for p in range(1 << PIECES) if cuts[p] < cuts[p + 1]]
    return pd.DataFrame(out, columns=["key", "n", "piece", "skip", "part"])


def _classes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for blob in pdf["blob"]:
            k = int(np.frombuffer(blob, "<u8", 1)[0])
            ids, keys, n = np.frombuffer(blob, "<i8", 3 * k, 8).reshape(3, k)
            yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(ids.copy(), np.frombuffer(blob, np.uint8, k, 8 + 24 * k) > 0), "key": keys, "n": n})


def _alike(a: Column, b: Column) -> Column:
    """Sizes that leave room for the threshold."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose overlaps, counted piece by piece and summed, reach the threshold."""
    parts = sets.where("piece >= 0")
    # merge joins at every size: the pairs grow with the input
    left = pairs.hint("merge").join(parts.select(F.col("key").alias("a"), F.col("n").alias("na"), "piece", F.col("part").alias("pa")), "a")
    both = left.hint("merge").join(parts.select(F.col("key").alias("b"), F.col("n").alias("nb"), "piece", F.col("part").alias("pb")), ["b", "piece"])
    total = both.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o")).groupBy("a", "b").agg(F.sum("o").alias("o"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return total.where(100 * F.col("o") >= PERCENT * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(key, comp): the smallest key of each key's component; keys without an edge are left out.

    Labels fall to the least among the neighbours' and their own, then to their label's label, until none falls.
    """
    e = common.staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "edges")
    labels = common.staged(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")), "labels")
    before = None
    while before != (now := labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]):
        before = now
        around = e.join(labels.withColumnRenamed("u", "v"), "v").select("u", "c").union(labels)
        fell = common.staged(around.groupBy("u").agg(F.min("c").alias("c")), "fell")
        labels = common.staged(fell.join(fell.select(F.col("u").alias("c"), F.col("c").alias("d")), "c").select("u", F.col("d").alias("c")), "labels")
    return labels.select(F.col("u").alias("key"), F.col("c").alias("comp"))


def _apart(tokens: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Tokens with comp, of those shingles whose texts lie in more than one component."""
    t = tokens.drop("comp")
    t = t.withColumn("comp", F.col("key")) if comps is None else t.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    t = t.select("t", "key", "n", "pos", "comp")
    mixed = t.groupBy("t").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("t")
    return common.staged(t.join(mixed, "t"), "apart")


def _with_earlier(apart: DataFrame) -> DataFrame:
    """Tokens with earlier: up to EARLIER tokens that come before it in its text. A pair is proposed at its first
    shared token; where a text has more tokens a pair may come up again, and is then made distinct."""
    rows = apart.groupBy("key", "n", "comp").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("all"))
    each = rows.select("key", "n", "comp", "all", F.posexplode("all").alias("k", "x"))
    before = F.transform(F.slice("all", F.greatest(F.col("k") - EARLIER + 1, F.lit(1)), F.least(F.col("k"), F.lit(EARLIER))), lambda s: s["t"])
    return each.select("key", "n", "comp", F.col("x.t").alias("t"), F.col("x.pos").alias("pos"), before.alias("earlier"))


def _between(apart: DataFrame) -> DataFrame:
    """(a, b): pairs of texts of different components that share a token and that sizes and places leave able to link."""
    own = _with_earlier(apart)
    nth = F.row_number().over(Window.partitionBy("t", "comp").orderBy("key")) - 1
    groups = own.withColumn("part", F.floor(nth / TOGETHER)).groupBy("t", "comp", "part").agg(F.collect_list(F.struct("key", "n", "pos", "earlier")).alias("m"))
    groups = common.staged(groups, "groups")
    x, y = (groups.select("t", F.col("comp").alias(f"c{k}"), F.col("m").alias(f"m{k}")) for k in "xy")

    def able(p: Column, q: Column) -> Column:
        # the first shared shingle leaves at most the rest of either; what both need is known from their sizes
        room = F.least(p["n"] - p["pos"], q["n"] - q["pos"])
        return _alike(p["n"], q["n"]) & ((100 + PERCENT) * room >= PERCENT * (p["n"] + q["n"])) & ~F.arrays_overlap(p["earlier"], q["earlier"])

    pair = lambda p, q: F.struct(F.least(p["key"], q["key"]).alias("a"), F.greatest(p["key"], q["key"]).alias("b"))
    some = F.exists("mx", lambda p: F.exists("my", lambda q: able(p, q)))
    pairs = F.flatten(F.transform("mx", lambda p: F.transform(F.filter("my", lambda q: able(p, q)), lambda q: pair(p, q))))
    met = x.withColumnRenamed("t", "tx").join(y.hint("merge"), (F.col("tx") == F.col("t")) & (F.col("cx") < F.col("cy")) & some)
    return met.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def near_duplicates(docs: DataFrame, rate: int = RATE, hot: int = HOT, key_bits: int = KEY) -> DataFrame:
    """doc_id, n_shingles, component_id per row.

    A set has the distinct runs of 5 words (fewer words: all of them as one; none: empty, linked
    with nothing). Texts link at a Jaccard similarity of 0.75 or more; a text of any length is taken
    whole, null text has no words. Rows alike come out alike. A null doc_id stays null and is nobody's
    smallest id: a component without any other has a null component_id. An empty table gives no rows;
    other columns, whatever their names, are not read. What `rate`, `hot` and `key_bits` are
    changes the work, not the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("gone"), "text")
    seen = common.staged(rows.select("doc_id", "text").mapInPandas(partial(_first_pass, rate, key_bits), "h long, n long, key long, other long"), "seen")
    total = seen.where("h is null").agg(F.sum("n")).first()[0] or 0
    every = seen.where("h is not null").groupBy("h").agg((F.sum("n") * rate).alias("n")).where(F.col("n") >= max(hot, total // SHARE))
    found = np.sort(np.array([r.h for r in every.collect()], np.int64).view(np.uint64))  # about SHARE numbers at most
    # of n texts about n * n / 2 ** 65 pairs have one key: some dozens at 5e10 texts
    twice = seen.where("key is not null").groupBy("key").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x < y")
    clashing = frozenset(r.key % (1 << 64) for r in twice.select("key").collect())
    bits = max(8, int(np.ceil(np.log2(max(total / FRAGMENT, 1)))))
    buckets, parts = max(8, (1 << bits) // 2), min((1 << bits) // 2, PARTS)
    sent = rows.mapInPandas(partial(_cut, min(bits, WAYS), buckets, key_bits, spark.sparkContext.broadcast(found), clashing), _SENT)
    if bits > WAYS:
        sent = _spread(sent, "frag", parts).mapInPandas(partial(_regrouped, partial(_finer, WAYS, bits)), _SENT)
    few = min(buckets, 1 << WAYS)
    counted = common.staged(sent.repartition(max(common.width(spark), parts), "frag").groupBy("frag").applyInPandas(lambda g: _count(bits, few, g), _SENT), "fragments")
    classes = common.staged(counted.where("frag < 0 and bucket < 0").mapInPandas(_classes, "doc_id long, key long, n long"), "classes")
    dealt = counted.where("bucket >= 0")
    if buckets > few:
        dealt = _spread(dealt, "bucket", parts).mapInPandas(partial(_regrouped, partial(_dealt, bits, buckets)), _SENT)
    sets = common.staged(dealt.groupBy("bucket").applyInPandas(lambda g: _gather(bits, g), _SETS), "sets")
    common.drop(seen, counted)
    tokens = sets.where("piece = -1").select("key", "n", "skip", F.posexplode("part").alias("p", "t")).select("t", "key", "n", (F.col("skip") + F.col("p")).alias("pos"))
    apart, comps = _apart(tokens, None), None
    if not apart.isEmpty():
        # a shingle's hub is the text where it comes first in the order: the one with the fewest rare shingles, at a group's centre
        hubs = common.staged(apart.groupBy("t").agg(F.min(F.struct("pos", "key", "n")).alias("h")), "hubs")
        star = apart.join(hubs.hint("merge"), "t").where((F.col("key") != F.col("h.key")) & _alike(F.col("n"), F.col("h.n")))
        star = common.staged(star.select(F.least("key", "h.key").alias("a"), F.greatest("key", "h.key").alias("b")).distinct(), "star")
        comps = components(linked(star, sets))
        apart = _apart(apart, comps)
    if not apart.isEmpty():
        pairs = common.staged(_between(apart).join(star, ["a", "b"], "left_anti"), "pairs")
        comps = components(linked(pairs, sets).union(comps.where("key != comp").select(F.col("comp").alias("a"), F.col("key").alias("b"))))
    classes = classes.withColumn("comp", F.col("key")) if comps is None else classes.join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    classes = common.staged(classes.select("doc_id", "n", "comp"), "members")
    least = common.staged(classes.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")  # a table, so that a large component's rows can be split in the join
    out = classes.join(least.hint("merge"), "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


#: All pairs of texts that share a shingle, and all that links reach: for small tables.
ORACLE_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT DISTINCT md5(array_to_string(w, ' ')) AS k, w FROM d WHERE len(w) > 0),
s AS (SELECT k, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM t),
e AS (SELECT k, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT k AS a, k AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
i AS (SELECT md5(array_to_string(w, ' ')) AS k, min(doc_id) AS least FROM d WHERE len(w) > 0 GROUP BY 1),
c AS (SELECT r.a AS k, min(i.least) AS component_id FROM r JOIN i ON i.k = r.b GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, doc_id) AS component_id
FROM d LEFT JOIN s ON s.k = md5(array_to_string(w, ' ')) LEFT JOIN c ON c.k = md5(array_to_string(w, ' '))"""


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Near copies among the whole `documents`."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))
