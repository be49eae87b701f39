"""How filters of a corpus interact: what each removes, in whatever order they are applied.

The orders of the filters form a trie whose nodes with the same filters applied, in any order, have the
same survivors. The trie is walked depth-first; a state (a set of applied filters) is visited once, as a
persisted DataFrame of survivors made from its parent's, and shared by all orders that pass it. What a
further filter removes from a state is counted on its survivors, one edge of the trie; every step of
every order is such an edge. With five filters there are 32 states and 80 edges instead of 600 steps.

Verdicts of filters depend on no order, so each text is read once and leaves a narrow row of verdicts.
The persisted frames descend from the written copy of these rows: a lost executor's part is made again.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def verdicts(docs: DataFrame, filters: Mapping[str, Column], part: Column, marks: DataFrame | None = None) -> DataFrame:
    """One narrow row per document: part, a boolean per filter that it fails, and quality and toxic of `marks`.

    `filters` are conditions over the columns of docs and its text's `words_`; those named in `repeated`
    come from duplicates(). Of several marks of a document, the greatest of each kind counts.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce(part, F.lit("")).alias("part"), *[F.coalesce(c, F.lit(False)).alias(f) for f, c in filters.items()])
    if marks is None:
        return rows.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    own = marks.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("mark_")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    both = rows.join(own.hint("merge"), rows["doc_id"] == own["mark_"], "left")  # both sides grow with the input
    return both.select("doc_id", "part", *filters, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def later_copies(docs: DataFrame, digest: str, flag: str) -> DataFrame:
    """docs with `flag`: whether a row of a smaller doc_id has the same digest. Null ids are neither earlier nor later.

    The least id of each digest is summed up before the exchange; only digests with several ids go on to
    the join, so a group of copies costs a row per copy, and a hot one is split by the skew join.
    """
    first = docs.where("doc_id IS NOT NULL").groupBy(F.col(digest).alias("digest_")).agg(F.min("doc_id").alias("first_"), F.max("doc_id").alias("last_")).where("first_ < last_").drop("last_")
    both = docs.join(first.hint("merge"), docs[digest] == first["digest_"], "left")
    return both.withColumn(flag, F.coalesce(F.col("doc_id") > F.col("first_"), F.lit(False))).drop("digest_", "first_")


def _edges(survivors: DataFrame, state: int, names: list[str]) -> DataFrame:
    """What each filter not yet in `state` removes from its survivors: a row per part and filter, in one pass."""
    sums = []
    for i, f in enumerate(names):
        if not state >> i & 1:
            fails = F.col(f).cast("long")
            sums.append(F.struct(F.lit(f).alias("filter"), F.sum(1 - fails).alias("kept"), F.sum(fails).alias("removed"), *[F.sum(F.when(F.col(m), fails).otherwise(0)).alias(f"{m}_lost") for m in ("good", "toxic")]).alias(f"edge_{f}"))
    summed = survivors.groupBy("part").agg(*sums)
    return summed.select("part", F.lit(state).alias("state"), F.explode(F.array(*[F.col(f"edge_{names[i]}") for i in range(len(names)) if not state >> i & 1])).alias("e")).select("part", "state", "e.*")


def edges(rows: DataFrame, names: list[str]) -> DataFrame:
    """(part, state, filter, kept, removed, good_lost, toxic_lost) of every edge of the trie; a state is the bits of its filters.

    Rows of a part that a state leaves empty are missing: they count as zeros.
    """
    spark, path = rows.sparkSession, common.new_path(rows.sparkSession, "edges")
    seen: set[int] = set()

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        if state == (1 << len(names)) - 1:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # few parts: one task writes what a state leaves to count
            _edges(survivors, state, names).coalesce(1).write.mode("append").parquet(path)
            for i, f in enumerate(names):
                if not (state >> i & 1 or state | 1 << i in seen):
                    visit(state | 1 << i, survivors.where(~F.col(f)))
        finally:
            survivors.unpersist()

    visit(0, rows)
    return spark.read.schema("part string, state int, filter string, kept long, removed long, good_lost long, toxic_lost long").parquet(path)


def audit(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (see op13_filter_audit).

    rows: part, a boolean per name, good, toxic. An empty table has no parts and no rows; repeated rows count each.
    """
    rows = common.staged(rows, "verdicts")
    found = edges(rows, names)
    spark, n = rows.sparkSession, len(names)
    steps = []
    for order in permutations(range(n)):
        state = 0
        for k, i in enumerate(order):
            steps.append(("".join(names[j] for j in order), k + 1, state, names[i], i))
            state |= 1 << i
    plan = spark.createDataFrame(steps, "filter_order string, step int, state int, filter string, bit int")  # orders times filters, whatever the input
    full = (1 << n) - 1
    # each edge lies on as many orders as its state and the rest can be arranged in
    arranged = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("state").cast("int") + 1)
    whole = found.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"),
        F.coalesce(F.sum(F.when(F.bit_count("state") == n - 1, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(arranged * F.col("removed")).alias("shapley"),
    )
    every = whole.join(F.broadcast(plan), "filter")
    # parts times orders times steps: as many rows as the result, a row for each on either side
    own = found.withColumnsRenamed({"part": "part_", "state": "state_", "filter": "filter_"})
    both = every.join(own.hint("merge"), (every["part"] == own["part_"]) & (every["state"] == own["state_"]) & (every["filter"] == own["filter_"]), "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "removed", "good_lost", "toxic_lost", "unique_fails", "shapley")}
    return both.select("part", "filter_order", "step", zero["kept"], zero["removed"], (F.col("fails") - F.coalesce("removed", F.lit(0))).cast("long").alias("redundant"), *[zero[c] for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")])


_WORD = r"[^\x20\x09-\x0D]+"
NAMES = list("ABCDE")


def five(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdicts of the five filters of the contract over whole texts (null: empty).

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * [A-Z] > 3 * code points; D: holds one of
    #$%&*|; E: the text of a smaller doc_id. Texts are alike if their SHA-256 is. Very long texts are read whole,
    each by itself; rows without an id are judged, but have no copies and no labels; other columns aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # what is used several times is a column of its own
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang_"), text.alias("text_"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words_"))
    n, u = F.size("words_"), F.size(F.array_distinct("words_"))
    flags = read.select(
        "doc_id", "lang_", F.unhex(F.sha2("text_", 256)).alias("digest"), (n < 200).alias("A"), (100 * u < 50 * n).alias("B"),
        (100 * (F.length("text_") - F.length(F.regexp_replace("text_", "[A-Z]+", ""))) > 3 * F.length("text_")).alias("C"),
        F.col("text_").rlike(r"[#$%&*|]").alias("D"),
    )
    flags = later_copies(common.staged(flags, "flags"), "digest", "E")
    return verdicts(flags, {f: F.col(f) for f in NAMES}, F.col("lang_"), labels)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Per part (lang; null: empty), order of the five filters and step: what that step keeps and removes of `documents`.

    redundant: documents that fail its filter and were removed earlier; unique_fails: that fail it alone;
    shapley: what its filter removes, summed over all orders.
    """
    return audit(five(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")), NAMES)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
  (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END) AS mask FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM v GROUP BY part, mask),
f AS (SELECT substr('ABCDE', i, 1) AS f, 1 << (i - 1) AS b FROM range(1, 6) r(i)),
o AS (SELECT [a.b, b.b, c.b, d.b, e.b] AS bits, a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k-1]), 0)::INT AS before FROM o, range(1, 6) r(k)),
a AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN x ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM a"""
