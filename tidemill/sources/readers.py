"""Readers: FASTA, FASTQ, EMBL, GenBank and raw text, file lists, delimited matrices, taxonomies, lineages, GFF hits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_IUPAC = "ABCDGHKMNRSTUVWYabcdghkmnrstuvwy"


def read_fasta(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """(path, contig_idx, id, seq): records in the order of the file, id the whole header. With `strict` also error, which names a record with letters outside the alphabet and is null else.

    Records are split by Spark's own line reader, so a large file is read by many tasks and .gz is unpacked.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    text = F.regexp_replace(F.col("value"), r"^\s*>|\r", "")
    rec = raw.select("path", "_b", "_m", F.split(text, "\n", 2).alias("p")).where(F.length(F.trim(F.element_at("p", 1))) > 0)
    seq = F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s", "")
    error = [F.when(~seq.rlike(f"^[{_IUPAC}]*$"), F.concat(F.lit("letters outside the alphabet in "), F.element_at("p", 1))).alias("error")] if strict else []
    return rec.select("path", F.struct("_b", "_m").alias("contig_idx"), F.element_at("p", 1).alias("id"), seq.alias("seq"), *error)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq) of records of four lines."""
    lines = spark.read.option("lineSep", "\n@").text(path).select(F.split(F.regexp_replace("value", r"^@|\r", ""), "\n").alias("p"))
    return lines.where(F.size("p") >= 2).select(F.element_at("p", 1).alias("id"), F.element_at("p", 2).alias("seq"))


def _flat_file(spark: SparkSession, path: str, name: str, start: str) -> DataFrame:
    """(id, seq) of records that end with a line of two slashes; the letters after the line that `start` matches are the sequence."""
    rec = spark.read.option("lineSep", "\n//").text(path).where(F.col("value").rlike(name))
    letters = F.regexp_replace(F.regexp_extract("value", rf"(?ms)^{start}[^\n]*\n(.*)\z", 1), r"[^A-Za-z*-]", "")
    return rec.select(F.regexp_extract("value", name, 1).alias("id"), letters.alias("seq"))


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq) of EMBL records; the id is the first field of the ID line."""
    return _flat_file(spark, path, r"(?m)^ID\s+([^;\s]+)", "SQ")


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq) of GenBank records; the id is the name in the LOCUS line."""
    return _flat_file(spark, path, r"(?m)^LOCUS\s+(\S+)", "ORIGIN")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(id, seq): each file is one sequence, its name the id; white space is no part of it. A file is read whole by one task."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("id"), F.regexp_replace("value", r"\s", "").alias("seq"))


def absolute_path(spark: SparkSession, path: str) -> str:
    """The full path with its file system, as Spark's readers take it."""
    h = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return h.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(h).toString()


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The rows that write_report() wrote, nested as they were."""
    return spark.read.json(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(path): lines that aren't empty."""
    return spark.read.text(path).where("value <> ''").withColumnRenamed("value", "path")


def existing(spark: SparkSession, paths: list[str]) -> list[tuple[int, str]]:
    """(number, path) of those that are files, numbered from 1; the others are skipped."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        fs = h.getFileSystem(conf)
        if fs.exists(h) and fs.getFileStatus(h).isFile():
            found.append(p)
    return list(enumerate(found, 1))


def unreadable(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Those of the files that can't be read to their end (a broken archive, say), with what went wrong; each is read by itself."""
    found = {}
    for p in paths:
        try:
            spark.read.text(p).agg(F.sum(F.length("value"))).collect()
        except Exception as e:  # whatever a file system or codec raises
            found[p] = f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"
    return found


def read_matrix(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """(vec): rows of numbers, read as floats; the first line of each file holds the dimensions, the number of columns last, and is passed over by its place."""
    head = spark.read.text(path).first()
    width = int(head.value.split()[-1])
    lines = spark.read.schema("value string").option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    parts = F.filter(F.split("value", f"[{delimiter}]"), lambda x: x != "")
    return lines.where(F.size(parts) >= width).select(F.slice(parts, 1, width).cast("array<float>").cast("array<double>").alias("vec"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(contig, taxonomy): lower case, the last line of a contig counts, further fields don't."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where("value <> ''").select(f.alias("f"), F.monotonically_increasing_id().alias("n")).where(F.size("f") >= 2)
    return lines.groupBy(F.col("f")[0].alias("contig")).agg(F.lower(F.max_by(F.col("f")[1], "n")).alias("taxonomy"))


def lineage_fields(line: str = "lineage"):
    """(domain, species): the third and ninth of a semicolon list, unknown if it has no ninth."""
    parts = F.split(line, ";")
    return F.coalesce(F.get(parts, F.lit(2)), F.lit("unknown")).alias("domain"), F.coalesce(F.get(parts, F.lit(8)), F.lit("unknown")).alias("species")


def read_lineages(spark: SparkSession, path: str) -> DataFrame:
    """(contig, domain, species) of each line, contig<TAB>lineage."""
    f = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(f[0].alias("contig"), F.coalesce(F.get(f, F.lit(1)), F.lit("")).alias("lineage")).select("contig", *lineage_fields())


def read_rrna(spark: SparkSession, path: str) -> DataFrame:
    """(hit_id, contig, start, end): lines of at least ten fields whose ninth is 16s_rRNA."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).select(f.alias("f"), F.monotonically_increasing_id().alias("hit_id")).where(F.size("f") >= 10).where(F.col("f")[8] == "16s_rRNA")
    return rows.select("hit_id", F.col("f")[0].alias("contig"), F.col("f")[3].cast("int").alias("start"), F.col("f")[4].cast("int").alias("end"))
