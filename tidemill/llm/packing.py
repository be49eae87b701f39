"""Packing of documents into sequences of a fixed number of tokens.

A longer document is cut into full pieces, the rest coming first; full pieces are sequences of
their own. The other pieces are dealt into groups of bounded size. A group's pieces go, in the order
in which they come, each into the fullest bin with room; then a local search empties bins by moves
and swaps of one or two pieces for one or two into bins at least as full, each raising the sum of
squared fills, until no such step is left; where that leaves more bins than the total needs, it starts
again from longest first. Bins that aren't exactly full are dealt into new groups, the emptiest of all
into one, and searched again as long as that makes the sequences fewer than before. Some full bins,
of a group's pieces in all, go with them, as their pieces fill what the others can't.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

CAPACITY = 2048
#: Pieces of a group, about.
GROUP = 4000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)] if n else []


def _pieces(tokenizer: str, capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = tokens.encoder(tokenizer)
    names = [x.split()[0] for x in _PIECE.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        out = []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
            ids = np.concatenate((ids, enc.end)).astype("<u4")
            out += [(doc, i, at, n, zlib.crc32(ids[at : at + n])) for i, (at, n) in enumerate(cut(len(ids), capacity))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; no exchange.

    Null text is empty: its end token alone. A text of any length gives as many pieces as it needs, a
    null doc_id stays null, repeated rows give their pieces once each, an empty table none; other
    columns, whatever their names, are not read.
    """
    run = partial(_pieces, tokenizer or tokens.default_tokenizer(), capacity)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECE)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: each piece, in the order given, into the fullest bin with room. Rooms are bits of one integer."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i, n in enumerate(lengths):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            own = by_room.setdefault(room - n, [])
            if not own:
                rooms |= 1 << (room - n)
            own.append(b)
    return bins


class _Bins:
    """Bins of items, as arrays over items and bins, so that one bin is compared with all others at once."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.items, self.n = [list(b) for b in bins], np.asarray(lengths, np.int64)
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
        self.capacity, self.own = capacity, np.array([i for b in bins for i in b], np.int64)
        self.bin = np.zeros(len(lengths), np.int64)
        for k, b in enumerate(bins):
            self.bin[b] = k
        self.two = np.zeros((2, 0), np.int64)
        self.two_n = self.two_bin = np.zeros(0, np.int64)
        self.used = 0
        self.at = [range(0)] * len(bins)
        for k in range(len(bins)):
            self._pair(k)

    def _pair(self, k: int) -> None:
        """Put the pairs within bin k (items, sum, bin) behind the others; the places that it had are of the bin past the last, which has no room."""
        own = np.asarray(self.items[k], np.int64)
        i, j = np.triu_indices(len(own), 1)
        self.two_bin[self.at[k].start : self.at[k].stop] = len(self.items)
        self.at[k] = range(0)
        if self.used + len(i) > len(self.two_n):
            self._close(len(i))
        self.at[k] = range(self.used, self.used + len(i))
        here = slice(self.used, self.used + len(i))
        self.two[:, here] = own[i], own[j]
        self.two_n[here], self.two_bin[here] = self.n[own[i]] + self.n[own[j]], k
        self.used += len(i)

    def _close(self, more: int) -> None:
        """Close the gaps between pairs, and leave as much room again and for `more`, so that this is seldom."""
        kept = np.flatnonzero(self.two_bin[: self.used] < len(self.items))
        size = 2 * (len(kept) + more) + 64
        two, self.two = self.two, np.zeros((2, size), np.int64)
        n, self.two_n = self.two_n, np.zeros(size, np.int64)
        of, self.two_bin = self.two_bin, np.full(size, len(self.items), np.int64)
        self.used = len(kept)
        self.two[:, : self.used], self.two_n[: self.used], self.two_bin[: self.used] = two[:, kept], n[kept], of[kept]
        first = np.searchsorted(kept, [r.start for r in self.at]).tolist()
        self.at = [range(a, a + len(r)) for a, r in zip(first, self.at)]

    def step(self, low: int) -> tuple[int, list[int], list[int]] | None:
        """(bin, items to it, items from it) of the step out of `low` that raises a bin at least as full the most, within its room."""
        # a bin of no room, one emptier than low, low itself and the bin past the last take nothing
        room = np.append(np.where(self.fill >= self.fill[low], self.capacity - self.fill, 0), 0)
        room[low] = 0
        top, best, gain = int(room.max(initial=0)), None, 0
        mine = {int(self.n[i]): [i] for i in self.items[low]}
        for k in self.at[low]:
            mine.setdefault(int(self.two_n[k]), self.two[:, k].tolist())
        item_room, item_n, two_n, two_room = room[self.bin[self.own]], self.n[self.own], self.two_n[: self.used], room[self.two_bin[: self.used]]
        for x, give in mine.items():
            if gain < x <= top:  # a move
                best, gain = (int(room.argmax()), give, []), x
            g = np.where(x - two_n <= two_room, x - two_n, 0)  # one or two for two
            if len(g) and g[k := int(g.argmax())] > gain:
                best, gain = (int(self.two_bin[k]), give, self.two[:, k].tolist()), int(g[k])
            g = np.where(x - item_n <= item_room, x - item_n, 0)  # one or two for one
            if g[k := int(g.argmax())] > gain:
                best, gain = (int(self.bin[self.own[k]]), give, [int(self.own[k])]), int(g[k])
        return best

    def swap(self, low: int, high: int, give: list[int], take: list[int]) -> None:
        for a, b, moved in ((low, high, give), (high, low, take)):
            for i in moved:
                self.items[a].remove(i)
                self.items[b].append(i)
                self.fill[a] -= self.n[i]
                self.fill[b] += self.n[i]
                self.bin[i] = b
        self._pair(low)
        self._pair(high)


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search on the bins with room: each, the emptiest first, gives to all at least as full until it is empty or no step helps.

    Ends as soon as there are as few bins as the total allows, or when a whole pass over all bins with
    room finds no step; a bin that got stuck stays a partner of the others and is tried again in the
    next pass. Each step raises the sum of squared fills, so there is an end.
    """
    least = -(-sum(lengths) // capacity)
    if len(bins) <= least:
        return bins
    fills = [sum(lengths[i] for i in b) for b in bins]
    done = [b for b, n in zip(bins, fills) if n == capacity]
    found = _Bins([b for b, n in zip(bins, fills) if n < capacity], lengths, capacity)
    left, moved = len(bins), True
    while moved and left > least:
        moved = False
        for low in np.argsort(found.fill, kind="stable").tolist():
            while 0 < found.fill[low] < capacity and (s := found.step(low)):
                found.swap(low, *s)
                moved = True
                left -= not found.items[low]
            if left <= least:
                break
    return done + [b for b in found.items if b]


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"
_NAMES = [x.split()[0] for x in _PLACED.split(", ")]
#: Bins of a group, at most, by which sequences are numbered.
_BINS = 1 << 32


def _laid(group: pd.DataFrame, bins: list[list[int]], ids: np.ndarray, capacity: int, spare: int) -> pd.DataFrame:
    """The rows of a group in the order of their bins, with sequence_id, offset and whether their bin goes on: it has room, or is among the first full ones of `spare` pieces at most."""
    order = np.array([i for b in bins for i in b], np.int64)
    n = group["length"].to_numpy()[order]
    size = np.fromiter(map(len, bins), np.int64, len(bins))
    ends = np.cumsum(n)
    last = ends[np.cumsum(size) - 1]
    fill = np.diff(np.concatenate(([0], last)))
    full = fill == capacity
    goes = ~full | (np.cumsum(size * full) <= spare)
    return group.iloc[order].assign(sequence_id=np.repeat(ids, size), offset=ends - n - np.repeat(last - fill, size), open=np.repeat(goes, size))[_NAMES]


def _better(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """The bins improved; if they are more than the total needs, those of a search from longest first where it finds fewer."""
    bins = improve(bins, lengths, capacity)
    if len(bins) > -(-sum(lengths) // capacity):
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        other = improve([[order[i] for i in b] for b in best_fit([lengths[i] for i in order], capacity)], lengths, capacity)
        bins = min(bins, other, key=len)
    return bins


def _first(capacity: int, spare: int, group: pd.DataFrame) -> pd.DataFrame:
    """Bins of a group's pieces: best fit in the order in which they are dealt, then the search."""
    group = group.sort_values(["deal_", "doc_id", "piece", "start", "length", "ids_crc32"], kind="stable", ignore_index=True)
    lengths = group["length"].tolist()
    bins = _better(best_fit(lengths, capacity), lengths, capacity)
    return _laid(group, bins, int(group["grp"].iloc[0]) * _BINS + np.arange(len(bins)), capacity, spare)


def _search(capacity: int, spare: int, group: pd.DataFrame) -> pd.DataFrame:
    """Improve the bins of a group; those that are left keep the first of the group's ids."""
    group = group.sort_values(["sequence_id", "offset"], kind="stable", ignore_index=True)
    ids, lengths = group["sequence_id"].unique(), group["length"].tolist()
    bins = _better([x.tolist() for x in group.groupby("sequence_id").indices.values()], lengths, capacity)
    return _laid(group, bins, ids[: len(bins)], capacity, spare)


def _sequences(rows: DataFrame) -> tuple[int, int]:
    """(pieces, sequences) of placed rows."""
    return tuple(rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1))).first())


def _emptiest(rows: DataFrame) -> int:
    """The greatest fill such that the bins up to it hold GROUP pieces at most; -1 if there is none. A row per fill comes to the driver."""
    held, most = 0, -1
    for fill, n in sorted(tuple(r) for r in rows.groupBy("fill").count().collect()):
        held += n
        if held > GROUP:
            break
        most = fill
    return most


def _by_group(dealt: DataFrame, groups: int) -> DataFrame:
    """Groups are few bytes but long work, so their partitions are asked for by number and not merged."""
    parallel = dealt.sparkSession.sparkContext.defaultParallelism
    return dealt.repartition(max(common.width(dealt.sparkSession), groups // 4, min(groups, 4 * parallel)), "grp")


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces() with sequence_id and offset; pieces of a sequence lie gapless from 0.

    Rows alike are packed one by one, an empty table gives none, ties are settled by the hash by which
    pieces are dealt, then by doc_id and piece.
    """
    # dealt by place, so that rows alike are spread too
    found = common.staged(found.withColumn("deal_", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    # full pieces are sequences of their own
    whole = found.where(F.col("length") == capacity).drop("deal_")
    out = whole.select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = found.where(F.col("length") < capacity)
    n, total = part.agg(F.count(F.lit(1)), F.sum("length")).first()
    if not n:
        return out
    least, groups = -(-total // capacity), -(-n // GROUP)
    dealt = part.withColumn("grp", F.pmod("deal_", F.lit(groups)))
    first = partial(_first, capacity, GROUP // groups)
    rows = common.staged(_by_group(dealt, groups).groupBy("grp").applyInPandas(lambda g: first(g), _PLACED), "packed")
    sequences, level = _sequences(rows)[1], 0
    fewer = 1
    while fewer and sequences > least:
        out = out.unionByName(rows.where("not open").drop("open"))
        rows = rows.where("open").drop("open").withColumn("fill", F.sum("length").over(Window.partitionBy("sequence_id")))
        n, before = _sequences(rows)
        groups, level = -(-n // GROUP), level + 1
        # the emptiest bins of all groups meet in one, with as many full ones as it takes; the others are dealt anew
        full, most = F.col("fill") == capacity, _emptiest(rows.where(F.col("fill") < capacity))
        held, spare = rows.agg(F.count(F.when(F.col("fill") <= most, 1)), F.count(F.when(full, 1))).first()
        taken = full & (F.pmod(F.xxhash64("sequence_id", F.lit(-level)), F.lit(max(spare, 1))) < GROUP - held)
        spread = 1 + F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups))
        dealt = rows.withColumn("grp", F.when((F.col("fill") <= most) | taken | (F.lit(groups) == 1), 0).otherwise(spread)).drop("fill")
        search = partial(_search, capacity, GROUP // groups)
        rows = common.staged(_by_group(dealt, groups).groupBy("grp").applyInPandas(lambda g: search(g), _PLACED), f"searched{level}")
        fewer = before - _sequences(rows)[1]
        sequences -= fewer
    return out.unionByName(rows.drop("open"))


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens from all `documents`."""
    return pack(pieces(common.table(spark, sf_dir, "documents")))
