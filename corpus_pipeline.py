"""Pipeline over a corpus: quality, line dedup, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's docs, and may be chained without that. All but the last return the columns of `documents`, further ones too, whatever
their names. Null and empty texts are scored like any, hold no lines, copies or passages, and pack as
their end token alone; texts of any length are taken whole; rows without an id and rows alike pass
each stage as its operator says; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import common, decontamination, line_dedup, ngram_join, packing, quality


def _stage(f: Callable) -> Callable:
    """Before a stage, delete written tables that nothing reads any more; what a result reads stays as long as it does."""
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.ship(spark)
        common.sweep(spark)
        return f(spark, docs, sf_dir)
    return run_stage


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality machine, trained on `labels`, doesn't reject."""
    machine = quality.train(docs, common.table(spark, sf_dir, "labels"))
    score = common.free(docs, "score")
    return quality.with_score(docs, machine, score).where(F.col(score) >= 0.5).drop(score)


@_stage
def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which nothing is left go."""
    removed = common.free(docs, "removed")
    out = line_dedup.dedup_lines(docs, removed=removed)
    out = out.where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    chars = {"n_chars": F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(chars).drop(removed)


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component of near copies; of rows alike in id all stay, and those without an id."""
    found = ngram_join.near_duplicates(docs)
    copies = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(copies.hint("merge"), docs["doc_id"] == copies["doc_id"], "left_anti")  # the copies grow with the input


@_stage
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of `benchmark`."""
    return decontamination.without_benchmark(docs, common.table(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [("quality", good_quality), ("line_dedup", unrepeated_lines), ("ngram_join", one_of_each), ("decontamination", no_benchmark), ("packing", packed)]

#: Neither a trained machine nor tokens can be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Runs don't know of each other: results of earlier ones and of other threads stay readable."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out, path = stage(spark, docs, sf_dir), common.new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = common.read_back(spark, out.schema, path)
        del out
    return STAGES[-1][1](spark, docs, sf_dir)
