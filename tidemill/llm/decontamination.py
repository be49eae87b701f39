"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact check.

Lengths of items are rounded down to eight steps per octave, so that their number hardly grows with
that of the items. For each such length, every window of that many words of every text gets a 64-bit
SimHash of its word shingles. It is held against a fingerprint of each item of that step, that of as
many of its first shingles; where they are near, the item-sized window that begins there is a
candidate. A window's sums of signed bits are the difference of two running sums, taken
modulo 256 where the window is short enough for that, so a fingerprint costs a few bytes' work. The
items' fingerprints lie in an index of four tables, one for each block of 16 bits: a block's bucket
names the items that differ from it in at most ERRORS bits. Of two fingerprints within RADIUS bits,
some block differs in at most ERRORS of them, so a look into each table by the window's block finds
all items within the radius; nothing else sieves the windows. Of a text shorter than an item, the
fingerprint of all its shingles is held against those of whole items. A candidate counts if the weighted
Jaccard similarity of its shingles, as a multiset, with the item's is high enough. Texts are taken
one by one, without an exchange. Items go to the executors in chunks of at most CHUNK shingles; a
larger benchmark takes a scan per chunk. Chunks follow the items' lengths, so that the fingerprints of
a length are made in few of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

SHINGLE = 5
LEAST = 0.75
BLOCKS, WIDTH, ERRORS = 4, 16, 3
RADIUS = BLOCKS * (ERRORS + 1) - 1
CHUNK = 200_000
#: Items of a length up to which a window that some bucket names is held against all of them.
_FEW = 16
#: Windows whose fingerprints are made at once, so that their sums stay in the cache.
_AT_ONCE = 1 << 13
#: Bit patterns of at most ERRORS bits.
_MASKS = np.array([sum(1 << b for b in bits) for n in range(ERRORS + 1) for bits in combinations(range(WIDTH), n)], np.int64)


def simhash(total: np.ndarray) -> np.ndarray:
    """Fingerprints of (n, 64) sums of signed bits."""
    return np.packbits((total > 0).ravel(), bitorder="little").view("<u8")


def _between(total: np.ndarray, lo: int, hi: int, n: int) -> np.ndarray:
    """simhash() of the windows of n rows from lo to hi, from running sums: of bytes the sign bits alone are taken, eight at once."""
    if total.dtype != np.int8:
        return simhash(total[lo + n : hi + n] - total[lo:hi])
    less = (total[lo:hi] - total[lo + n : hi + n]).view(np.uint64)
    less &= np.uint64(0x8080808080808080)
    return np.packbits(less.view(np.uint8).ravel(), bitorder="little").view("<u8")


def signs(h: np.ndarray) -> np.ndarray:
    """(n, 64): 1 where a bit of the hash is set, else -1."""
    return np.unpackbits(np.ascontiguousarray(h.astype("<u8"))[:, None].view(np.uint8), axis=1, bitorder="little").view(np.int8) * 2 - 1


def running(x: np.ndarray, kind: type) -> np.ndarray:
    """(n + 1, 64) running sums of the rows of x, modulo what `kind` holds; sixteen rows at a time, as whole rows add fast."""
    n = len(x)
    out = np.zeros((-(-(n + 1) // 16), 16, x.shape[1]), kind)
    out.reshape(-1, x.shape[1])[1 : n + 1] = x
    for k in range(1, 16):
        out[:, k] += out[:, k - 1]
    out[1:] += np.cumsum(out[:-1, 15], axis=0, dtype=kind)[:, None]
    return out.reshape(-1, x.shape[1])[: n + 1]


class Index:
    """Fingerprints in buckets: per block and value of it, the places of the fingerprints that are at most ERRORS bits away."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.starts, self.places, self.some = [], [], np.zeros(1 << WIDTH, np.uint8)  # bit b: the bucket of block b isn't empty
        for b, block in enumerate(self._blocks(prints).T):
            near = (block.astype(np.int64)[:, None] ^ _MASKS).ravel()
            self.some[near] |= 1 << b
            if len(prints) > _FEW:
                order = np.argsort(near, kind="stable")
                self.starts.append(np.searchsorted(near[order], np.arange((1 << WIDTH) + 1)).astype(np.int32))
                self.places.append((order // len(_MASKS)).astype(np.int32))

    @staticmethod
    def _blocks(prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints)[:, None].view("<u2")

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in fp, place of the item, bits apart) of all pairs within RADIUS, by item and place."""
        blocks = [b.astype(np.intp) for b in self._blocks(fp).T]
        if len(self.prints) <= _FEW:  # whatever some bucket names is held against all of them
            hit = self.some.take(blocks[0]) & 1
            for b, block in enumerate(blocks[1:], 1):
                hit |= self.some.take(block) & (1 << b)
            w = np.flatnonzero(hit)
            item, at = np.nonzero(np.bitwise_count(self.prints[:, None] ^ fp[w]) <= RADIUS)
            w = w[at]
        else:
            got = []
            for b, (block, start, places) in enumerate(zip(blocks, self.starts, self.places)):
                w = np.flatnonzero(self.some.take(block) & (1 << b))
                first, n = start[block[w]].astype(np.int64), (start[block[w] + 1] - start[block[w]]).astype(np.int64)
                item = places[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
                w = np.repeat(w, n)
                close = np.bitwise_count(fp[w] ^ self.prints[item]) <= RADIUS
                got.append(item[close] * len(fp) + w[close])
            item, w = np.divmod(np.unique(np.concatenate(got)), max(len(fp), 1))
        return w, item, np.bitwise_count(fp[w] ^ self.prints[item])


def _shingled(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each shingle of k words, in order."""
    of, _, _, h = wordhash.words(texts)
    at, s = wordhash.shingles(of, h, k)
    return of[at], s


def step(n: int) -> int:
    """n rounded down to eight steps per octave."""
    low = max(n.bit_length() - 4, 0)
    return n >> low << low


def _print(s: np.ndarray) -> np.ndarray:
    """The fingerprint of a run of shingles."""
    return simhash(signs(s).sum(0, dtype=np.int32)[None])


class Group:
    """The beginnings of items whose lengths round to the same step, of shingles of k words, in an index."""

    def __init__(self, k: int, shingles: int, items: list[tuple[int, np.ndarray]]):
        """items: (place in Items, its shingles in order)."""
        self.k, self.shingles = k, shingles
        self.item, self.n = np.array([place for place, _ in items], np.int64), np.array([len(s) for _, s in items], np.int64)
        self.index = Index(np.concatenate([_print(s[:shingles]) for _, s in items]))


class Items:
    """Items with their shingles, the groups of their beginnings, and an index of whole items for texts shorter than they."""

    def __init__(self, rows: list[tuple[int, str]]):
        """rows: (item_id, text). An item of fewer than SHINGLE words is one shingle; one without words can't be found."""
        #: item_id, k, number of shingles, their counts, fingerprint of them all
        self.items: list[tuple[int, int, int, Counter, np.uint64]] = []
        groups: dict[tuple[int, int], list] = {}
        texts = [t.encode() for _, t in rows]
        for k in range(1, SHINGLE + 1):
            of, s = _shingled(texts, k) if texts else (np.empty(0, int),) * 2
            cut = np.searchsorted(of, np.arange(len(rows) + 1))
            for i, n in enumerate(np.diff(cut).tolist()):
                if n == 1 or n and k == SHINGLE:
                    own = s[cut[i] : cut[i + 1]]
                    groups.setdefault((k, step(n)), []).append((len(self.items), own))
                    self.items.append((rows[i][0], k, n, Counter(own.tolist()), _print(own)[0]))
        self.groups = [Group(k, n, own) for (k, n), own in sorted(groups.items())]
        self.longer = np.array([i for i, x in enumerate(self.items) if x[1] == SHINGLE and x[2] > 1], np.int64)
        self.n = np.array([x[2] for x in self.items], np.int64)
        self.whole = Index(np.array([self.items[i][4] for i in self.longer], np.uint64)) if len(self.longer) else None


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: sum of the lesser counts over that of the greater."""
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class _Windows:
    """The shingles of a list of texts, and the fingerprints of their windows."""

    def __init__(self, texts: list[bytes], k: int):
        self.text, self.s = _shingled(texts, k)
        self.cut = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.signs, self.sums = signs(self.s), {}

    def _running(self, n: int) -> np.ndarray:
        """Running sums of the signs, exact for windows of n shingles: differences of them fit into the kind of number."""
        kind = np.int8 if n < 128 else np.int32
        if kind not in self.sums:
            self.sums[kind] = running(self.signs, kind)
        return self.sums[kind]

    def near(self, group: Group, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """(first shingle, shingles, place of the item) of the item-sized windows, first from lo to hi, whose beginning is near that of the item."""
        hi = min(hi, len(self.s) - group.shingles + 1)
        if lo < hi:
            at, of, _ = group.index.near(_between(self._running(group.shingles), lo, hi, group.shingles))
            first, n = at + lo, group.n[of]
            whole = self.text[first] == self.text[np.minimum(first + n, len(self.s)) - 1]
            whole &= first + n <= len(self.s)
            yield from zip(first[whole].tolist(), n[whole].tolist(), group.item[of[whole]].tolist())

    def near_short(self, items: Items, least: float) -> Iterator[tuple[int, int, int]]:
        """The same of texts that have fewer shingles than an item, each one window if it has enough."""
        own = np.diff(self.cut)
        held = np.flatnonzero(own > 0)
        if items.whole is not None and len(held):
            total = self._running(int(own.max()))
            at, of, _ = items.whole.near(simhash(total[self.cut[held + 1]] - total[self.cut[held]]))
            item, text = items.longer[of], held[at]
            fits = (own[text] < items.n[item]) & (own[text] >= least * items.n[item])
            yield from zip(self.cut[text[fits]].tolist(), own[text[fits]].tolist(), item[fits].tolist())

    def apart(self, first: int, n: int, whole: np.uint64) -> int:
        """Bits between the fingerprints of a window and of a whole item."""
        return int(np.bitwise_count(_print(self.s[first : first + n])[0] ^ whole))


def _candidates(items: Items, windows: dict[int, _Windows], least: float) -> Iterator[tuple]:
    """(windows, first shingle, shingles, place of the item); all groups on a stretch of text in turn, while its sums are in the cache."""
    for lo in range(0, max((len(w.s) for w in windows.values()), default=0), _AT_ONCE):
        for group in items.groups:
            w = windows[group.k]
            yield from ((w, *x) for x in w.near(group, lo, lo + _AT_ONCE))
    if SHINGLE in windows:
        yield from ((windows[SHINGLE], *x) for x in windows[SHINGLE].near_short(items, least))


def search(texts: list[bytes], items: Items, least: float) -> list[list[tuple]]:
    """Per text: (item_id, first word, words, similarity, bits apart) of the best window of each item found, ties to the first."""
    out: list[list[tuple]] = []
    for _, part in wordhash.batched(texts, 1 << 19):
        best: list[dict] = [{} for _ in part]
        windows = {k: _Windows(part, k) for k in {group.k for group in items.groups}}
        for w, at, n, i in _candidates(items, windows, least):
            item, k, _, counts, whole = items.items[i]
            sim = similarity(Counter(w.s[at : at + n].tolist()), counts)
            text = int(w.text[at])
            place = at - int(w.cut[text])
            if sim >= least and (item not in best[text] or (-sim, place) < best[text][item][0]):
                best[text][item] = ((-sim, place), (item, place, n + k - 1, sim, w.apart(at, n, whole)))
        out += [[b[item][1] for item in sorted(b)] for b in best]
    return out


def chunks(benchmark: DataFrame, most: int = CHUNK) -> Iterator[Items]:
    """The items in chunks of at most `most` words (a longer item is a chunk); read through the driver chunk by chunk."""
    held, size = [], 0
    for r in benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy(F.size(F.split("text", r"\s+")), "item_id", "text").toLocalIterator():
        n = len(r.text.encode().split())
        if held and size + n > most:
            yield Items(held)
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield Items(held)


def _rows(items_bc, least: float, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        found = search([t.encode() for t in pdf["text"]], items_bc.value, least)
        rows = [(d, *m) for d, own in zip(pdf["doc_id"].array, found) for m in own]
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "n_words", "similarity", "bits_apart"]).astype({"doc_id": "Int64"})


_FOUND = "doc_id long, item_id long, first_word int, n_words int, similarity double, bits_apart int"


def find_benchmark(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """A row per text and item whose best window reaches `least`: doc_id, item_id, the window, its similarity and bits apart.

    Null and empty texts hold nothing, a null doc_id stays null; a text of any length is searched
    whole, one shorter than an item as one window. Repeated rows are found once each; ties go to the
    earliest window; an empty table or benchmark gives no rows. Items without words or with a null
    id or text aren't looked for, those alike in id and text count once. Other columns, whatever
    their names, are not read.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in chunks(benchmark):
        part = rows.mapInPandas(partial(_rows, spark.sparkContext.broadcast(items), least), _FOUND)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], _FOUND) if out is None else out


def _clean(items_bc, least: float):
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([not own for own in search([t.encode() if t else b"" for t in text], items_bc.value, least)], dtype=bool)

    return clean


def without_benchmark(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; null and empty texts stay, and so do all rows of an empty benchmark."""
    spark = docs.sparkSession
    for items in chunks(benchmark):
        # kept where it stands: moved below a join it would meet the text's expression, which it can't evaluate
        clean = F.pandas_udf(_clean(spark.sparkContext.broadcast(items), least), "boolean").asNondeterministic()
        docs = docs.where(clean("text"))
    return docs


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Passages of `benchmark` in `documents`."""
    return find_benchmark(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
