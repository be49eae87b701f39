"""Line dedup: the suffix array over line ids shows repeated runs of lines, and later copies are deleted.

The corpus is a sequence of line ids, one part per text; lines of white space alone are passed over.
Prefix doubling ranks the suffixes by their first 1, 2, 4, ... lines, until none are alike: a rank is
the place of a pair of ranks among the sorted distinct pairs. A suffix whose prefix occurs once has
its place, so it drops out and a round takes only suffixes that are still tied.

Suffixes alike in their first d lines are an interval of the suffix array with a common prefix of d
lines. Each suffix is led down to its deepest interval that has a suffix which lies earlier in the
corpus, in order of doc_id, then the text's hash, then line: from an interval it goes on to the one of
2^k lines more, k falling, if that has an earlier suffix than itself. What it shares with an earlier
one is then known exactly: the common prefix is a maximal repeated run, and if it has `min_words` words
or more it is deleted. An interval needs of each part of it that goes deeper only the earliest suffix,
so a suffix that is led on leaves nothing behind but that one, and groups are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
_KEY = ["doc_id", "th"]
_CUT = "doc_id long, th long, cut array<struct<first:int,last:int>>"
_LINE = "doc_id long, th long, j int, i int, words int, a long, b long"


def _lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Non-blank lines: j their number among these, i among all; their words, at most 2^31, and a hash of 128 bits."""
    for pdf in parts:
        for at in range(0, len(pdf), 512):
            doc, th, j, i, words, sums = [], [], [], [], [], []
            for d, h, text in zip(pdf["doc_id"][at : at + 512], pdf["th"][at : at + 512], pdf["text"][at : at + 512]):
                n = 0
                for k, line in enumerate(text.split("\n")):
                    if own := line.split():
                        doc.append(d)
                        th.append(h)
                        j.append(n)
                        i.append(k)
                        words.append(len(own))
                        sums.append(blake2b(line.strip().encode(), digest_size=16).digest())
                        n += 1
            two = np.frombuffer(b"".join(sums), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"doc_id": doc, "th": th, "j": j, "i": i, "words": words, "a": two[:, 0], "b": two[:, 1]})


def _able(min_words: int, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The suffixes that have min_words words before the first line that occurs once; no others can matter."""
    for pdf in parts:
        out = []
        for doc, th, lines in zip(pdf["doc_id"], pdf["th"], pdf["lines"]):
            j = np.array([x["j"] for x in lines])
            sums = np.concatenate(([0], np.cumsum([x["words"] for x in lines], dtype=np.int64)))
            last = np.flatnonzero(np.concatenate((np.diff(j) != 1, [True])))
            end = sums[last[np.searchsorted(last, np.arange(len(j)))] + 1]
            out += [(doc, th, int(x)) for x in j[end - sums[:-1] >= min_words]]
        yield pd.DataFrame(out, columns=["doc_id", "th", "j"])


def _ranges(min_words: int, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Deleted ranges of line numbers of a text, in order and apart: its runs of min_words words."""
    for pdf in parts:
        out = []
        for doc, th, lines, runs in zip(pdf["doc_id"], pdf["th"], pdf["lines"], pdf["runs"]):
            at = {x["j"]: n for n, x in enumerate(lines)}
            sums = np.concatenate(([0], np.cumsum([x["words"] for x in lines], dtype=np.int64)))
            own: list[dict] = []
            for j, d in sorted((r["j"], r["d"]) for r in runs):
                a = at[j]
                if sums[a + d] - sums[a] < min_words:
                    continue
                first, last = lines[a]["i"], lines[a + d - 1]["i"]
                if own and first <= own[-1]["last"] + 1:
                    own[-1]["last"] = max(own[-1]["last"], last)
                else:
                    own.append({"first": first, "last": last})
            if own:
                out.append((doc, th, own))
        yield pd.DataFrame(out, columns=["doc_id", "th", "cut"])


def _ranked(found: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """The distinct keys that occur more than once, and r, their rank in ascending order (with gaps)."""
    twice = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return twice.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("r", F.monotonically_increasing_id())


def suffix_ranks(own: DataFrame, parts: int) -> list[DataFrame]:
    """(doc_id, th, j, r) per depth 1, 2, 4, ...: the ranks of the suffixes whose first lines, so many, occur more than once.

    `own` has the ranks of single lines; the list ends where no two suffixes are tied.
    """
    out = [own.select(*_KEY, "j", "r")]
    while True:
        half = 1 << (len(out) - 1)
        last = out[-1]
        pairs = last.withColumnRenamed("r", "x").join(last.select(*_KEY, (F.col("j") - half).alias("j"), F.col("r").alias("y")), [*_KEY, "j"])
        known = common.staged(_ranked(pairs, ["x", "y"], parts), "rank")
        if known.isEmpty():
            common.drop(known)
            return out
        out.append(common.staged(pairs.join(known.hint("merge"), ["x", "y"]).select(*_KEY, "j", "r"), "ranks"))
        common.drop(known)


def _deeper(state: DataFrame, ranks: DataFrame, step: int) -> DataFrame:
    """Lead the suffixes of each interval (c, d) on to its parts of d + step lines.

    A part's earliest suffix stays where it is, and stands in the part for what is earlier; so does one
    that stood so before (not `real`). The others go on; those that only stood for others end there.
    """
    place = F.struct(*_KEY, "j", "real")
    at = state.withColumn("e", F.col("j") + F.col("d")).join(ranks.select(*_KEY, F.col("j").alias("e"), "r").hint("merge"), [*_KEY, "e"], "left").drop("e")
    inside = at.where("r is not null")
    parts = inside.groupBy("c", "d", "r").agg(F.min(place).alias("first"), F.sum(F.col("real").cast("int")).alias("n"))
    parts = common.staged(parts.where(F.col("n") > F.col("first.real").cast("int")).drop("n"), "parts")  # a table, so that a hot part's rows can be split in the join
    deep = (F.col("d") + step).alias("d")
    name = F.struct("first.doc_id", "first.th", "first.j").alias("c")
    row = lambda d, c, real: F.struct("doc_id", "th", "j", d, c, real.alias("real"))
    same = row(F.col("d"), F.col("c"), F.col("real"))
    first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("j") == F.col("first.j"))
    rows = F.when(F.col("first").isNull(), F.array(same)).when(first, F.array(same, row(deep, name, F.lit(False)))).when(F.col("real"), F.array(row(deep, name, F.lit(True))))
    led = inside.join(parts.hint("merge"), ["c", "d", "r"], "left").select(F.explode(rows).alias("x")).select("x.*")
    out = common.staged(led.unionByName(at.where("r is null").drop("r")), "state")
    common.drop(parts)
    return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), cut: the ranges of line numbers to delete, for texts that have any.

    Rows alike in doc_id and text count as one. Null text has no lines; a null doc_id comes first.
    """
    parts = common.width(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    lines = common.staged(rows.mapInPandas(_lines, _LINE), "lines")
    known = common.staged(_ranked(lines, ["a", "b"], parts), "rank")
    own = common.staged(lines.join(known.hint("merge"), ["a", "b"]).groupBy(*_KEY, "j").agg(*(F.first(x).alias(x) for x in ("i", "words", "r"))), "repeated")
    common.drop(lines, known)
    per_text = common.staged(own.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("j", "i", "words"))).alias("lines")), "texts")
    ranks = suffix_ranks(own, parts)
    able = per_text.mapInPandas(partial(_able, min_words), "doc_id long, th long, j int")
    state = able.withColumns({"d": F.lit(0), "c": F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("th"), F.lit(0).alias("j")), "real": F.lit(True)})
    for k in reversed(range(len(ranks))):
        before, state = state, _deeper(state, ranks[k], 1 << k)
        if k < len(ranks) - 1:
            common.drop(before)
    runs = state.where("real and d > 0").groupBy(*_KEY).agg(F.collect_list(F.struct("j", "d")).alias("runs"))
    return common.staged(per_text.join(runs.hint("merge"), _KEY).mapInPandas(partial(_ranges, min_words), _CUT), "cut")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "n_removed") -> DataFrame:
    """docs with later copies of repeated line runs cut from `text`, and `removed`, the number of lines cut.

    A line's text is compared without white space at its ends; a text of any length is taken whole.
    Null and empty texts stay as they are; a text whose lines are all cut becomes empty. A null doc_id
    comes first; rows alike in doc_id and text are one text and are cut alike; of runs that are alike the
    first in order of doc_id and the text's hash stays. An empty table stays empty. All other columns,
    whatever their names, pass through, n_chars too; a column `removed` is replaced.
    """
    d, t, c = (common.free(docs, x) for x in ("cut_doc", "cut_text", "cut_lines"))
    cuts = repeated_runs(docs, min_words).select(F.col("doc_id").alias(d), F.col("th").alias(t), F.col("cut").alias(c))
    id_ = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63)))
    # always a merge join: the cuts grow with the input, so they aren't broadcast while they happen to be few
    out = docs.join(cuts.hint("merge"), (id_ == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(t)), "left")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.transform(F.filter(lines, lambda s: ~F.exists(c, lambda r: s["i"].between(r["first"], r["last"]))), lambda s: s["x"])
    n = F.aggregate(c, F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
    return out.withColumns({"text": F.when(F.col(c).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")), removed: F.coalesce(n, F.lit(0))}).drop(d, t, c)


#: White space as in str.split().
_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The shortest runs from each line and to each line cover what longer ones do; ids are taken to be distinct.
ORACLE_SQL = f"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, i, regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS x FROM l),
n AS (SELECT doc_id, i, x, row_number() OVER o AS j, len(regexp_split_to_array(x, '{_SPACE}+')) AS w, sum(len(regexp_split_to_array(x, '{_SPACE}+'))) OVER o AS upto FROM t WHERE x <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT s.doc_id, s.j AS s, e.j AS e FROM n s JOIN n e ON s.doc_id = e.doc_id AND e.j >= s.j AND e.upto - s.upto + s.w >= {MIN_WORDS}),
r AS (SELECT doc_id, s, min(e) AS e FROM p GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM p GROUP BY doc_id, e),
k AS (SELECT r.doc_id, s, e, min(i) AS lo, max(i) AS hi, md5(string_agg(x, chr(10) ORDER BY j)) AS k FROM r JOIN n ON n.doc_id = r.doc_id AND j BETWEEN s AND e GROUP BY r.doc_id, s, e),
c AS (SELECT DISTINCT l.doc_id, l.i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM k) q JOIN l ON l.doc_id = q.doc_id AND l.i BETWEEN lo AND hi WHERE nth > 1),
o AS (SELECT l.doc_id, count(c.i) AS n, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '') AS text FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(o.n, 0) AS INT) AS n_removed, o.text FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id"""


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every text of `documents` without later copies of line runs of 50 words or more."""
    return dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_removed", "text")
