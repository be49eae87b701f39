"""Column functions over sequences: alphabet, composition, reverse complement, k-mers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_dna5(seq: Column) -> Column:
    """A, C, G, T in upper case, everything else N; one character stays one character."""
    return F.upper(F.regexp_replace(seq, "[^ACGTacgt]", "N"))


def gc_fraction(seq: Column) -> Column:
    """Share of C and G among all characters; null for an empty sequence."""
    gc = F.length(seq) - F.length(F.translate(seq, "CGcg", ""))
    return F.when(F.length(seq) > 0, gc / F.length(seq))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def all_kmers(spark: SparkSession, k: int, code: str | None = None) -> DataFrame:
    """(kmer): all words of k letters over A < C < G < T, from the base-4 digits of a range; with `code` that number too."""
    digits = [F.substring(F.lit("ACGT"), (F.shiftright("id", 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)]
    return spark.range(4**k).select(F.concat(*digits).alias("kmer"), *([F.col("id").alias(code)] if code else []))


def kmer_dimensions(spark: SparkSession, k: int) -> DataFrame:
    """(kmer, canonical, dim): canonical k-mers numbered in lexicographic order; 4**k rows by definition."""
    from pyspark.sql import Window

    pairs = all_kmers(spark, k).withColumn("canonical", canonical(F.col("kmer")))
    return pairs.withColumn("dim", F.dense_rank().over(Window.orderBy("canonical")) - 1)


def window_count(length: Column, width: int, step: int) -> Column:
    return F.when(length >= width, F.floor((length - width) / step) + 1).otherwise(1).cast("int")


def perplexity(n: Column) -> Column:
    return F.floor(F.pow(F.log(n), 2)).cast("long")


def significant(x: Column, digits: int = 4) -> Column:
    """x with so many significant digits, as C prints %.4g: halves are those of the binary value, which Java's formatter doesn't see; null stays null."""
    def text(v: pd.Series) -> pd.Series:
        return v.map(lambda d: f"{d:.{digits}g}", na_action="ignore").astype(object)

    return F.when(x.isNotNull(), F.pandas_udf(text, "string")(F.coalesce(x.cast("double"), F.lit(0.0))))


def regex_is(text: Column, pattern: str) -> Column:
    """Whole-text match, case-insensitive; an empty pattern never matches."""
    return text.rlike(f"(?i)^(?:{pattern})$") if pattern else F.lit(False)
