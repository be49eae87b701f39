"""Writers: FASTA whole, chosen or by class, tables per sample, matrices and nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_fasta(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """>id and the sequence on one line each."""
    df.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value")).write.mode(mode).text(path)


def write_chosen(df: DataFrame, names: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """FASTA of the rows of (id, seq) whose id is among `names` (id)."""
    write_fasta(df.join(names.select("id").distinct(), "id", "left_semi"), path, mode)


def write_per_sample(df: DataFrame, path: str, mode: str = "append") -> None:
    """Lines of JSON in a folder per sample; rows are added to those that are there."""
    df.write.mode(mode).partitionBy("sample").json(path)


def write_classes(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder per class of (id, seq, class); NA is written with contamination, unknown states too."""
    kind = F.when(F.coalesce(F.col("class"), F.lit("NA")) == "clean", "clean").otherwise("contamination")
    df.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value"), kind.alias("class")).write.mode(mode).partitionBy("class").text(path)


def write_matrix(df: DataFrame, path: str, delimiter: str = "\t", mode: str = "errorifexists") -> None:
    """Rows of vec; the number of columns stands in a header line of each part."""
    width = df.select(F.max(F.size("vec"))).first()[0] or 0
    df.select(F.array_join(F.transform("vec", lambda x: x.cast("string")), delimiter).alias(str(width))).write.mode(mode).option("header", True).option("quote", "").csv(path, sep="\x01")


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A line of JSON per sample."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).write.mode(mode).text(path)
