"""Quality rules as a ledger: every rule is evaluated once, its failure is a bit, its measurements are kept.

A ledger row is (doc_id, measurements, failed): `failed` has the bit of each rule that the text fails.
Policies are versions of a set of rules with the number of failures that they forgive; applying one, or
another version later, is a bit operation on the ledger and reads no text. Ablations (what a policy would
keep without one of its rules) come from counts by masks, which are summed before any exchange.

DataFrame functions only. Ratios are compared as whole numbers, so no rounding decides.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Measurements of a text, in the order of the ledger's columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letter_words", "n_upper", "n_digits", "n_marks", "n_chars")


@dataclass(frozen=True)
class Rule:
    """A failure condition over measurements, in SQL that Spark and others read alike."""

    name: str
    fails: str


#: Bit k of a ledger is rule k: rules are only ever added at the end, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("few_distinct", "100 * n_distinct < 20 * n_words"),
    Rule("few_letter_words", "100 * n_letter_words < 70 * n_words"),
    Rule("capitals", "100 * n_upper > 40 * n_chars"),
    Rule("digits", "100 * n_digits > 30 * n_chars"),
    Rule("marks", "100 * n_marks > 30 * n_words"),
)
_BIT = {r.name: 1 << k for k, r in enumerate(RULES)}


def bits(names: Iterable[str]) -> int:
    """The mask of rules by name."""
    return sum(_BIT[n] for n in set(names))


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails no rule of `always` and at most `forgiven` of `counted`."""

    version: str
    always: int
    counted: int = 0
    forgiven: int = 0

    def keeps(self, failed: Column) -> Column:
        few = F.bit_count(failed.bitwiseAND(F.lit(self.counted))) <= self.forgiven
        return (failed.bitwiseAND(F.lit(self.always)) == 0) & few


BASE = bits(("few_words", "repeated_words"))
#: Versions in order; the last is the one in force.
POLICIES = (
    Policy("1", BASE),
    Policy("2", BASE | bits(("symbols", "short_words", "long_words"))),
    Policy("3", BASE | bits(("symbols", "short_words", "long_words", "few_distinct", "few_letter_words", "marks")), bits(("duplicate_lines", "capitals", "digits")), 1),
)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` of docs and the measurements of its whole texts, as columns of long.

    Null text measures like an empty one. Of a text in memory there are its words and a row of five
    values per window, so the longest text of a task bounds its memory. Rows alike are each measured;
    other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # in steps: what a lambda reads or what is used twice is a column
    rows = docs.select(*keep, text.alias("text_"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words_"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines_"))
    n = F.size("words_")
    word = lambda i: F.get("words_", i)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(word(i), word(i + 1), word(i + 2)).alias("h"), word(i).alias("a"), word(i + 1).alias("b"), word(i + 2).alias("c"), i.alias("i"))))
    # equal windows stand together, by hash first and then by their words, each group by place
    rows = rows.withColumn("sorted_", F.sort_array(F.coalesce(windows, F.array().cast("array<struct<h:bigint,a:string,b:string,c:string,i:int>>"))))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    twice = F.filter(F.transform("sorted_", lambda x, i: F.when(same(x, F.get("sorted_", i - 1)) | same(x, F.get("sorted_", i + 1)), x["i"])), lambda i: i.isNotNull())
    rows = rows.withColumn("twice_", F.sort_array(twice)).drop("sorted_")
    covered = F.aggregate("twice_", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")))["n"]

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace("text_", pattern, ""))

    n_chars = F.length("text_")
    found = {
        "n_words": n, "word_chars": left(r"[\x20\x09-\x0D]+"), "n_symbols": n_chars - left(r"[#*$%&|<>]+"), "n_dup_lines": F.size("lines_") - F.size(F.array_distinct("lines_")), "n_repeat_words": covered,
        "n_lines": F.size("lines_"), "n_distinct": F.size(F.array_distinct("words_")), "n_letter_words": F.size(F.filter("words_", lambda w: w.rlike(r"\p{L}"))),
        "n_upper": n_chars - left(r"\p{Lu}+"), "n_digits": n_chars - left("[0-9]+"), "n_marks": n_chars - left("[!?]+"), "n_chars": n_chars,
    }
    return rows.select(*keep, *[found[m].cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed long): every rule evaluated once on each row of docs; no exchange.

    A null doc_id stays null, rows of the same id each get their own; an empty table stays empty.
    """
    failed = "CAST(" + " + ".join(f"CASE WHEN {r.fails} THEN {_BIT[r.name]} ELSE 0 END" for r in RULES) + " AS BIGINT)"
    return measured(docs, "doc_id").withColumn("failed", F.expr(failed))


def ablations(book: DataFrame, policies: Iterable[Policy] = POLICIES) -> DataFrame:
    """(policy, rule, failed, sole, kept, kept_without) of each rule of each policy, over a ledger.

    failed: documents that fail the rule; sole: that the policy loses by it alone; kept and kept_without: what
    the policy keeps with all its rules and without that one. Documents are counted by mask first, of which
    there are at most 2 ** rules; an empty ledger has rows of zeros.
    """
    masks = book.groupBy("failed").agg(F.count("*").alias("n"))
    out = None
    for p in policies:
        names = [r.name for r in RULES if (p.always | p.counted) & _BIT[r.name]]
        less = {r: Policy(p.version, p.always & ~_BIT[r], p.counted & ~_BIT[r], p.forgiven) for r in names}
        sums = [F.struct(*[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (
            ("failed", F.col("failed").bitwiseAND(F.lit(_BIT[r])) != 0), ("sole", ~p.keeps(F.col("failed")) & less[r].keeps(F.col("failed"))), ("kept", p.keeps(F.col("failed"))), ("kept_without", less[r].keeps(F.col("failed"))))], F.lit(r).alias("rule")) for r in names]
        rows = masks.agg(F.array(*sums).alias("x")).select(F.lit(p.version).alias("policy"), F.explode("x").alias("x")).select("policy", "x.rule", "x.failed", "x.sole", "x.kept", "x.kept_without")
        out = rows if out is None else out.union(rows)
    return out


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of `documents` under the policy in force: measurements, failure bits, and what each version keeps."""
    book = ledger(common.table(spark, sf_dir, "documents"))
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return book.select(
        F.col("doc_id").cast("long").alias("doc_id"), *MEASURES[:5], base.alias("base_failed"), POLICIES[-1].keeps(F.col("failed")).alias("kept"),
        "failed", *MEASURES[5:], *[p.keeps(F.col("failed")).alias(f"kept_by_{p.version}") for p in POLICIES],
    )


def quality_rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of each policy removes of `documents`, alone and at all."""
    return ablations(ledger(common.table(spark, sf_dir, "documents")))


def _sql_keeps(p: Policy) -> str:
    return f"(failed & {p.always} = 0 AND bit_count(failed & {p.counted}) <= {p.forgiven})"


_LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
p AS (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
c AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i+1], w[i+2]) AS c FROM p),
k AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest([i, i+1, i+2]) AS j FROM c WHERE c > 1) GROUP BY row),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
 length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits, length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks, length(t) AS n_chars FROM d LEFT JOIN k USING (row)),
b AS (SELECT *, (""" + " + ".join(f"CASE WHEN {r.fails} THEN {_BIT[r.name]} ELSE 0 END" for r in RULES) + ")::BIGINT AS failed FROM m)"
ORACLE_SQL = _LEDGER + f"""
SELECT doc_id, {', '.join(MEASURES)}, failed & {BASE} <> 0 AS base_failed, {_sql_keeps(POLICIES[-1])} AS kept, failed, {', '.join(f'{_sql_keeps(p)} AS kept_by_{p.version}' for p in POLICIES)} FROM b"""


def _ablation_sql() -> str:
    out = []
    for p in POLICIES:
        for r in RULES:
            if (p.always | p.counted) & _BIT[r.name]:
                q = Policy(p.version, p.always & ~_BIT[r.name], p.counted & ~_BIT[r.name], p.forgiven)
                out.append(f"SELECT '{p.version}' AS policy, '{r.name}' AS rule, count(*) FILTER (failed & {_BIT[r.name]} <> 0) AS failed, count(*) FILTER (NOT {_sql_keeps(p)} AND {_sql_keeps(q)}) AS sole, count(*) FILTER ({_sql_keeps(p)}) AS kept, count(*) FILTER ({_sql_keeps(q)}) AS kept_without FROM b")
    return _LEDGER + "\n" + "\nUNION ALL ".join(out)


ABLATION_SQL = _ablation_sql()
