"""python -m tidemill: screen FASTA files and write the report, tables and clean contigs."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import session
from tidemill.config import Options
from tidemill.plans import screen
from tidemill.sources import readers, writers

LOG = logging.getLogger("tidemill")
#: Options by the letter that stands for them.
_LETTERS = {"seed": "R", "tsne_dim": "d", "tsne_pca_dim": "u", "perplexity": "p", "theta": "t", "min_length": "m", "kmer": "k", "width": "w", "step": "s", "target_points": "n", "subsamples": "b", "subsample_ratio": "r", "aggressive_threshold": "a", "target_taxonomy": "X"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemill", description=__doc__)
    p.add_argument("-i", "--input-fasta", action="append", default=[], help="a FASTA file; may be given again")
    p.add_argument("-I", "--input-list", help="a file with the paths of FASTA files, one a line")
    p.add_argument("-x", "--taxonomy-file", help="contig and taxonomy, tab-separated")
    p.add_argument("-G", "--rrna-file", help="hits of 16S genes as GFF")
    p.add_argument("-o", "--output-dir", default="results")
    p.add_argument("-v", "--verbose", action="count", default=0, help="once or more: say more")
    p.add_argument("-q", "--quiet", action="store_true")
    for f in fields(Options):
        names = ["-" + _LETTERS[f.name]] if f.name in _LETTERS else []
        names.append("--" + f.name.replace("_", "-"))
        kind = {"action": "store_true"} if isinstance(f.default, bool) else {"type": type(f.default)}
        p.add_argument(*names, default=f.default, **kind)
    return p


def level(verbose: int, quiet: bool) -> int:
    """Warnings; information or all with one or more -v; nothing with -q."""
    return logging.CRITICAL + 1 if quiet else max(logging.DEBUG, logging.WARNING - 10 * verbose)


def _contigs(spark: SparkSession, paths: list[str], strict: bool) -> tuple[DataFrame, DataFrame]:
    """(contigs in the order of the files, (sample, error) of files that can't be read or, if strict, hold other letters than those of the alphabet).

    Only if reading all files at once fails is each tried by itself.
    """
    def copied(some: list[str]) -> DataFrame:
        rows = readers.read_fasta(spark, some, strict)
        return session.cut_lineage(rows.select(F.col("path").alias("sample"), F.monotonically_increasing_id().alias("contig_idx"), "id", "seq", *(["error"] if strict else [])))

    errors = {}
    try:
        rows = copied(paths)
    except Exception:
        errors = readers.unreadable(spark, paths)
        if not errors or len(errors) == len(paths):
            raise
        rows = copied([p for p in paths if p not in errors])
    failed = spark.createDataFrame([(readers.absolute_path(spark, p), e) for p, e in errors.items()], "sample string, error string")
    if strict:
        odd = rows.where("error is not null").groupBy("sample").agg(F.min("error").alias("error"))  # a row per file
        rows, failed = rows.drop("error").join(odd, "sample", "left_anti"), failed.union(odd)
    return rows, failed


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Screen the inputs that are there; what stops one sample is in its row, the others go on. Returns the report."""
    options = Options(**{f.name: getattr(args, f.name) for f in fields(Options)})
    # a list stands instead of single files
    paths = [r.path for r in readers.read_list(spark, args.input_list).collect()] if args.input_list else args.input_fasta
    known = readers.existing(spark, paths)
    for path in set(paths) - {p for _, p in known}:
        LOG.error("no such file: %s", path)
    if not known:
        raise SystemExit("no input")
    LOG.info("options %s", options.as_strings())
    contigs, failed = _contigs(spark, [p for _, p in known], options.strict_alphabet)
    tax = readers.read_taxonomy(spark, args.taxonomy_file) if args.taxonomy_file else None
    hits = readers.read_rrna(spark, args.rrna_file) if args.rrna_file else None
    found = screen.screen(contigs, options, tax, hits)
    out = args.output_dir.rstrip("/")
    writers.write_report(screen.report(found, options).unionByName(failed, allowMissingColumns=True), f"{out}/report")
    for name, table in screen.details(found, contigs, options).items():
        writers.write_per_sample(table, f"{out}/{name}")
    writers.write_per_sample(screen.scattered(found), f"{out}/scatter")
    if tax is not None:
        writers.write_classes(screen.decontaminated(contigs, found["contigs"]), f"{out}/classes")
    report = readers.read_report(spark, f"{out}/report")
    for r in report.select("sample", *[F.col(c) for c in ("state", "error") if c in report.columns]).collect():
        LOG.warning("%s", r.asDict())
    return report


def main(argv: list[str] | None = None) -> None:
    args, unknown = parser().parse_known_args(argv)
    logging.basicConfig(level=level(args.verbose, args.quiet), format="%(asctime)s %(levelname)s %(message)s")
    if unknown:
        LOG.warning("options not known: %s", unknown)
    spark = SparkSession.builder.appName("tidemill").getOrCreate()
    session.ship(spark)
    run(spark, args)


if __name__ == "__main__":
    main()
