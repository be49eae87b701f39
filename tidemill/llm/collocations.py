"""Collocations: phrases whose words stand together more often than their parts account for.

Places of a shard's words are kept as a compressed bitmap per word: those bytes of eight places that hold
the word at all. A phrase's bitmap marks where its last word stands; shifted by one and met (AND) with
the bitmaps of the words in the same bytes, it gives those of all phrases longer by a word, whose
popcounts are their frequencies. Phrases are extended depth-first, a batch of prefixes at a time. A free
place lies between pieces, so that no shift leads from one piece to the next.

Popcounts are summed over shards by ranges of a 64-bit key of language and words. A task sends a packed
fragment per range; where there are more than 2 ** FAN ranges, they are cut in several exchanges, so that
fragments stay long at any size. Phrases of one key are told apart by their words. Three words are only
counted where both their pairs may be frequent, as a filter of fixed size says (2 ** FILTER bits, of which
each range makes its own slice); it lets some rare ones pass, and their counts decide.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.vectorize import number_within

from . import common, wordhash
from .wordhash import mix

LEAST, LONGEST, FIRST, ABSORBED = 10, 3, 2000, 50
#: Bytes of text whose bitmaps are in memory at once; entries of prefixes that are extended at once.
SHARD, BATCH = 4 << 20, 1 << 17
#: Bits of the filter, as a power of 2; phrases of a range, about; ranges that one exchange deals out, as a power of 2.
FILTER, RANGE, FAN = 27, 1_500_000, 10

_SENT = "range long, blob binary"
_SUMMED = "range long, size int, lang string, phrase string, f long, slice binary"
_KIND = np.zeros(256, np.uint8)  # 0 part of a word, 1 between words, 2 between pieces
_KIND[[9, 32]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURN = mix(np.arange(2001, 2065, dtype=np.uint64)) | np.uint64(1)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(wordhash._BYTE[data] * wordhash._power(wordhash._BASE, len(data)), out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * wordhash._power(wordhash._INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def _alike(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each run has the bytes of the run whose number is in `other`."""
    size = end - start
    same = size == size[other]
    left = np.flatnonzero(same & (other != np.arange(len(other))))
    for k in range(int(size[left].max(initial=0))):
        left = left[size[left] > k]
        differ = data[start[left] + k] != data[start[other[left]] + k]
        same[left[differ]] = False
        left = left[~differ]
    return same


def _numbered(keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each run, first run of each number): runs are alike if key, bytes and kind are."""
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    other = first[number]
    odd = np.flatnonzero(~(_alike(data, start, end, other) & (kind == kind[other])))
    more: dict[tuple[bytes, int], int] = {}
    extra = []
    for i in odd:
        own = more.setdefault((data[start[i] : end[i]].tobytes(), int(kind[i])), len(first) + len(more))
        if own == len(first) + len(extra):
            extra.append(i)
        number[i] = own
    return number, np.concatenate((first, np.array(extra, first.dtype)))


#: Bytes whose places are in memory at once.
_STEP = 1 << 20


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of these runs, one after another."""
    upto = np.cumsum(end - start)
    out = np.empty(int(upto[-1]) if len(upto) else 0, np.uint8)
    cuts = np.unique(np.append(np.searchsorted(upto, np.arange(_STEP, len(out), _STEP)), [0, len(upto)]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        size, first = end[a:b] - start[a:b], int(upto[a] - (end[a] - start[a]))
        place = np.cumsum(size) - size
        out[first : upto[b - 1]] = data[np.repeat(start[a:b] - place, size) + np.arange(int(size.sum()))]
    return out


class Shard:
    """The distinct words of some texts and the bitmaps of their places; `langs` holds each text's language as a number below len(salts)."""

    def __init__(self, texts: list[bytes], langs: np.ndarray, salts: np.ndarray) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = _KIND[self.data]
        gap = np.ones(len(kind) + 1, bool)
        gap[1:] = kind > 0
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[0::2], edge[1::2]
        lang = langs[np.searchsorted(np.cumsum(sizes + 1), start, "right")]
        hashes = _hashes(self.data, start, end)
        word, first = _numbered(mix(hashes + salts[lang]), self.data, start, end, lang)
        self.start, self.end, self.lang, self.hash, self.salt = start[first], end[first], lang[first], hashes[first], salts[lang[first]]
        self.n = np.bincount(word, minlength=len(first))
        breaks = np.concatenate(([0], np.cumsum(kind == 2)))
        place = np.arange(len(start))
        place[1:] += np.cumsum(breaks[start[1:]] > breaks[start[:-1]])
        order = np.argsort(word, kind="stable")
        word, place = word[order], place[order]
        new = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (place[1:] >> 3 != place[:-1] >> 3)))[: len(word)])
        # entries of the bitmaps by word and byte, and by byte
        self.word, self.byte = word[new], place[new] >> 3
        self.bits = np.bitwise_or.reduceat((1 << (place & 7)).astype(np.uint8), new) if len(new) else np.empty(0, np.uint8)
        across = np.argsort(self.byte, kind="stable")
        self._word, self._bits = self.word[across], self.bits[across]
        self._at = np.searchsorted(self.byte[across], np.arange(int(self.byte.max(initial=-1)) + 3))

    def longer(self, node: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(node, word, byte, bits) of all phrases that are a word longer than these nodes' ones: shift, then AND with what stands there."""
        low, carry = bits << np.uint8(1), bits >> np.uint8(7)
        a, b = np.flatnonzero(low), np.flatnonzero(carry)
        node, byte, bits = np.concatenate((node[a], node[b])), np.concatenate((byte[a], byte[b] + 1)), np.concatenate((low[a], carry[b]))
        first = self._at[byte]
        count = self._at[byte + 1] - first
        of = np.repeat(np.arange(len(node)), count)
        entry = np.arange(len(of)) + np.repeat(first - (np.cumsum(count) - count), count)
        met = bits[of] & self._bits[entry]
        hit = np.flatnonzero(met)
        of = of[hit]
        return node[of], self._word[entry[hit]], byte[of], met[hit]

    def key(self, phrases: np.ndarray) -> np.ndarray:
        """64 bits of language and words; phrases: a row of word numbers each."""
        return mix(mix((self.hash[phrases] * _TURN[: phrases.shape[1]]).sum(1, dtype=np.uint64)) + self.salt[phrases[:, 0]] + np.uint64(phrases.shape[1]))

    def phrases(self, longest: int, may: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, popcounts) of all phrases of 2 to `longest` words, depth-first; with `may` (a filter) only those of 3 words or more whose pairs pass it."""
        ends = np.flatnonzero(np.concatenate((self.word[1:] != self.word[:-1], [True])))[: len(self.word)] + 1
        at = 0
        while at < len(self.word):
            upto = ends[max(np.searchsorted(ends, at + BATCH, "right") - 1, np.searchsorted(ends, at, "right"))]
            own = self.word[at:upto]
            words, node = np.unique(own, return_inverse=True)
            yield from self._below(words[:, None], node, self.byte[at:upto], self.bits[at:upto], longest, may)
            at = upto

    def _below(self, prefixes: np.ndarray, node: np.ndarray, byte: np.ndarray, bits: np.ndarray, longest: int, may: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        node, word, byte, bits = self.longer(node, byte, bits)
        if not len(node):
            return
        pair = node * len(self.start) + word
        order = np.argsort(pair, kind="stable")
        pair, byte, bits = pair[order], byte[order], bits[order]
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        first = np.flatnonzero(new)
        found = np.column_stack((prefixes[pair[first] // len(self.start)], pair[first] % len(self.start)))
        passes = np.ones(len(first), bool)
        if may is not None:
            passes = _passes(may, self.key(found[:, -2:]))
        if may is None or found.shape[1] > 2:
            yield found[passes], np.add.reduceat(np.bitwise_count(bits), first, dtype=np.int64)[passes]
        if found.shape[1] < longest:
            number = np.cumsum(new) - 1
            on = passes[number]
            yield from self._below(found, number[on], byte[on], bits[on], longest, may)


def _passes(may: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys >> np.uint64(64 - (len(may).bit_length() - 1 + 3))
    return (may[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _thin(x: np.ndarray) -> bytes:
    """Bytes of the same weight together, which packs well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _thick(data: memoryview, n: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind)[:, 0] if n else np.empty(0, kind)


class Counts:
    """Phrases with their counts: keys, counts, numbers of words, languages by number, bytes and their ends."""

    def __init__(self, keys, counts, size, lang, data, ends, langs: list[str]) -> None:
        self.keys, self.counts, self.size, self.lang, self.data, self.ends, self.langs = keys, counts, size, lang, data, ends, langs

    def starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends

    def taken(self, rows: np.ndarray) -> Counts:
        start, end = self.starts()[rows], self.ends[rows]
        return Counts(self.keys[rows], self.counts[rows], self.size[rows], self.lang[rows], _gathered(self.data, start, end), np.cumsum(end - start), self.langs)

    @staticmethod
    def joined(parts: list[Counts]) -> Counts:
        names: dict[str, int] = {}
        lang = [np.array([names.setdefault(x, len(names)) for x in p.langs], np.int64)[p.lang] if len(p.lang) else p.lang for p in parts]
        before = np.cumsum([0, *[len(p.data) for p in parts]])
        ends = [p.ends + b for p, b in zip(parts, before)]
        return Counts(*[np.concatenate([getattr(p, k) for p in parts]) for k in ("keys", "counts", "size")], np.concatenate(lang), np.concatenate([p.data for p in parts]), np.concatenate(ends), list(names))

    def summed(self) -> Counts:
        """A row for each phrase, by key."""
        number, first = _numbered(self.keys, self.data, self.starts(), self.ends, self.lang << 8 | self.size)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, number, self.counts)
        own = self.taken(first)
        own.counts = total
        return own if len(first) < 2 or (own.keys[1:] >= own.keys[:-1]).all() else own.taken(np.argsort(own.keys, kind="stable"))

    def fragments(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """(range, packed rows); the rows are sorted by key, whose first `bits` are the range."""
        pack = zstandard.ZstdCompressor(level=1).compress
        ranges = (self.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.keys), np.int64)
        cut = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1], [True]))) if len(ranges) else []
        start = self.starts()
        for a, b in zip(cut[:-1], cut[1:]):
            text = self.data[start[a] : self.ends[b - 1]].tobytes()
            steps = np.diff(self.keys[a:b], prepend=np.uint64(0))
            head = json.dumps([int(b - a), len(text), self.langs]).encode()
            yield int(ranges[a]), pack(len(head).to_bytes(4, "little") + head + _thin(steps) + _thin(self.counts[a:b]) + _thin((self.ends[a:b] - start[a:b]).astype("<u4")) + _thin(self.size[a:b].astype("<u1")) + _thin(self.lang[a:b].astype("<u4")) + text)

    @staticmethod
    def unpacked(blob: bytes) -> Counts:
        raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
        at = 4 + int.from_bytes(raw[:4], "little")
        n, size, langs = json.loads(bytes(raw[4:at]))
        out = []
        for kind in ("<u8", "<i8", "<u4", "<u1", "<u4"):
            upto = at + n * np.dtype(kind).itemsize
            out.append(_thick(raw[at:upto], n, kind))
            at = upto
        keys, counts, lens, words, lang = out
        return Counts(np.cumsum(keys, dtype=np.uint64), counts, words.astype(np.int64), lang.astype(np.int64), np.frombuffer(raw[at : at + size], np.uint8), np.cumsum(lens, dtype=np.int64), langs)


def _counts(shard: Shard, found: Iterable[tuple[np.ndarray, np.ndarray]], langs: list[str]) -> Counts:
    """Phrases of a shard, by key, each once."""
    out = []
    for words, counts in found:
        k = words.shape[1]
        # words and the spaces between them, as runs of one buffer
        start, end = np.empty((len(words), 2 * k - 1), np.int64), np.empty((len(words), 2 * k - 1), np.int64)
        start[:, ::2], end[:, ::2] = shard.start[words], shard.end[words]
        start[:, 1::2], end[:, 1::2] = len(shard.data), len(shard.data) + 1
        out.append((shard.key(words), counts, np.full(len(words), k), shard.lang[words[:, 0]], start, end))
    data = np.append(shard.data, np.uint8(32))
    parts = [Counts(key, counts, size, lang, _gathered(data, start.ravel(), end.ravel()), np.cumsum((end - start).sum(1)), langs) for key, counts, size, lang, start, end in out]
    both = Counts.joined(parts)
    return both.taken(np.argsort(both.keys, kind="stable"))


def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _shards(pairs: Iterator[tuple[bytes, str]]) -> Iterator[tuple[Shard, list[str]]]:
    held: list[bytes] = []
    lang: list[int] = []
    names: dict[str, int] = {}
    size = 0

    def made() -> tuple[Shard, list[str]]:
        return Shard(held, np.array(lang), np.array([_salt(x) for x in names], np.uint64)), list(names)

    for text, name in pairs:
        held.append(text)
        lang.append(names.setdefault(name, len(names)))
        size += len(text)
        if size >= SHARD:
            yield made()
            held, lang, names, size = [], [], {}, 0
    if held:
        yield made()


def _send(bits: int, may, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fragments of words and pairs, or, with a filter, of longer phrases."""
    common.trim()
    pairs = ((t.encode(), n) for pdf in parts for t, n in zip(pdf["text"], pdf["lang"]))
    for shard, langs in _shards(pairs):
        if not len(shard.start):
            continue
        if may is None:
            one = [(np.arange(len(shard.start))[:, None], shard.n)]
            found = [*one, *shard.phrases(2)]
        else:
            found = list(shard.phrases(LONGEST, may.value))
        if found:
            rows = list(_counts(shard, found, langs).fragments(bits))
            yield pd.DataFrame({"range": [r for r, _ in rows], "blob": [b for _, b in rows]})


def _recut(bits: int, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fragments of coarse ranges summed up and cut finer."""
    held: list[Counts] = []

    def sent() -> pd.DataFrame:
        rows = list(Counts.joined(held).summed().fragments(bits))
        return pd.DataFrame({"range": [r for r, _ in rows], "blob": [b for _, b in rows]})

    for pdf in parts:
        for blob in pdf["blob"]:
            held.append(Counts.unpacked(blob))
            if sum(len(h.keys) for h in held) >= RANGE:
                yield sent()
                held = []
    if held:
        yield sent()


def _sum(bits: int, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a range: frequent phrases, occurrences of single words by language (size -1), and the range's slice of the filter (size 0)."""
    common.trim()
    own = Counts.joined([Counts.unpacked(b) for b in pdf["blob"]]).summed()
    number = int(pdf["range"].iloc[0])
    rows = []
    for i, lang in enumerate(own.langs):
        if n := int(own.counts[(own.lang == i) & (own.size == 1)].sum()):
            rows.append((number, -1, lang, None, n, None))
    own = own.taken(np.flatnonzero(own.counts >= LEAST))
    width = FILTER - bits
    pairs = own.keys[own.size == 2]
    if len(pairs):
        bit = (pairs >> np.uint64(64 - FILTER)) & np.uint64((1 << width) - 1)
        flags = np.zeros(max(8, 1 << width), np.uint8)
        flags[bit.astype(np.int64)] = 1
        rows.append((number, 0, None, None, 0, zstandard.ZstdCompressor().compress(np.packbits(flags, bitorder="little").tobytes())))
    text, start = own.data.tobytes(), own.starts()
    rows += [(number, int(s), own.langs[g], text[a:b].decode(errors="replace"), int(c), None) for s, g, a, b, c in zip(own.size, own.lang, start, own.ends, own.counts)]
    return pd.DataFrame(rows, columns=["range", "size", "lang", "phrase", "f", "slice"])


def _summed(rows: DataFrame, bits: int, may=None) -> DataFrame:
    """Phrases with their counts over all shards, from LEAST on, and what _sum adds."""
    at = min(bits, FAN)
    sent = rows.mapInPandas(partial(_send, at, may), _SENT)
    while at < bits:
        at = min(bits, at + FAN)
        dealt = sent.repartition(common.width(rows.sparkSession), "range", F.pmod(F.xxhash64("blob"), F.lit(common.width(rows.sparkSession))))
        sent = dealt.mapInPandas(partial(_recut, at), _SENT)
    return common.staged(sent.groupBy("range").applyInPandas(partial(_sum, bits), _SUMMED), "phrases")


def _filter(found: DataFrame, bits: int) -> np.ndarray:
    """The filter of frequent pairs: 2 ** FILTER bits whatever the input, put together from the ranges' slices."""
    may = np.zeros(1 << (FILTER - 3), np.uint8)
    each = len(may) >> bits
    for r in found.where("size = 0").select("range", "slice").toLocalIterator():
        own = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.slice), np.uint8)
        may[r.range * each : r.range * each + len(own)] = own
    return may


def frequencies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of the phrases of 1 to LONGEST words that occur LEAST times or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(FILTER - 3, max(0, (size // 6 // RANGE).bit_length()))  # words and pairs of a text, at 6 bytes a word
    short = _summed(rows, bits)
    may = spark.sparkContext.broadcast(_filter(short, bits))
    long = _summed(rows, bits, may)
    may.unpersist()
    keep = ["lang", "size", "phrase", "f"]
    return short.where("size > 0").select(*keep).union(long.where("size > 0").select(*keep)), short.where("size = -1").groupBy("lang").agg(F.sum("f").alias("n"))


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of all candidates: the cut of the lowest score, of those the first."""
    words = F.split("phrase", " ")
    cands = found.where("size > 1").withColumnRenamed("f", "a")
    cuts = cands.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({"left_": F.array_join(F.slice(words, 1, F.col("k")), " "), "right_": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    for side, name in (("left_", "l"), ("right_", "r")):
        part = found.select(F.col("lang").alias("lang_"), F.col("phrase").alias("part_"), F.col("f").alias(name))
        cuts = cuts.join(part.hint("merge"), (cuts["lang"] == part["lang_"]) & (cuts[side] == part["part_"])).drop("lang_", "part_")
    # decimals of 38 digits: exact until a phrase occurs 1e15 times
    cuts = cuts.withColumns({c: F.col(c).cast("decimal(15,0)") for c in "alr"}).withColumn("score", F.expr("CAST(CAST(a * a AS DECIMAL(31,0)) * CAST(1000000 AS DECIMAL(7,0)) AS DECIMAL(38,0)) div CAST(l * r AS DECIMAL(38,0))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "size")).alias("x"))
    return best.select("lang", "phrase", "x.size", *[F.col(f"x.{c}").cast("long").alias(c) for c in ("a", "l", "r", "score")])


def undropped(cands: DataFrame) -> DataFrame:
    """Candidates without those that a longer one holds and that occur at least ABSORBED in 100 times within it."""
    words = F.split("phrase", " ")
    inner = cands.where("size > 2").select(
        F.col("lang").alias("lang_"), F.col("a").alias("longer"),
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))).alias("inner_"),
    ).groupBy("lang_", "inner_").agg(F.max("longer").alias("longer"))
    both = cands.join(inner.hint("merge"), (cands["lang"] == inner["lang_"]) & (cands["phrase"] == inner["inner_"]), "left")
    return both.where(f"longer IS NULL OR 100 * longer < {ABSORBED} * a").drop("lang_", "inner_", "longer")


def collocations(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `first` best phrases of each language, by score, a and phrase.

    Null text counts as empty, null lang as `und`; texts of any length are taken whole, repeated rows each
    count; ids and further columns are not read; without words there are no rows. A text that is longer than
    a shard makes one of its own size.
    """
    found, totals = frequencies(docs)
    left = undropped(common.staged(scored(found), "candidates"))
    # ranked over ranges of the order, so that no task gets a language whole
    left = left.withColumns({"score_": -F.col("score"), "a_": -F.col("a")})
    top = number_within(left, ["lang"], ["score_", "a_", "phrase"], "rank").where(F.col("rank") < first).withColumn("rank", F.col("rank") + 1)
    totals = totals.withColumnRenamed("lang", "lang_")
    return top.join(totals.hint("merge"), top["lang"] == totals["lang_"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of each language of `documents`."""
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, s AS size, array_to_string(w[i:i+s-1], ' ') AS phrase FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(s))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k+1:size], ' ') AS y FROM c, (VALUES (1), (2)) v(k) WHERE k < size),
s AS (SELECT k.*, l.f AS l, r.f AS r, (1000000::HUGEINT * k.a * k.a) // (l.f::HUGEINT * r.f) AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.x JOIN f r ON r.lang = k.lang AND r.phrase = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL),
u AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase) ASC) AS rank FROM u)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""
