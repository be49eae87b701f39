"""Shared folder, staged tables and session facts that the operators of this folder use."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemill import session
from tidemill.session import free, shared_dir  # noqa: F401

#: Folders of staged tables, each with a weak reference to what the plans that read it hold in common.
_live: dict[str, tuple[str, object]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_back(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """The written table at `path`; sweep() may delete it when no plan of this session reads it any more."""
    out = spark.read.schema(schema).parquet(path)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _live[path] = (spark.sparkContext.applicationId, spark.sparkContext._jvm.java.lang.ref.WeakReference(files))
    return out


def sweep(spark: SparkSession) -> None:
    """Delete the written tables that nothing reads any more: no DataFrame, of whatever thread, and no plan made from one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    for path, (app, files) in list(_live.items()):
        if app != spark.sparkContext.applicationId:
            _live.pop(path, None)  # of a session that has ended
        elif files.refersTo(None) and _live.pop(path, None):
            discard(spark, path)


#: Bytes that a writer of a staged table holds before it writes them.
ROW_GROUP = 16 << 20


def trim() -> None:
    """Give back what the allocator kept of earlier tasks of this worker, where it can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    out = read_back(spark, df.schema, path)
    out.staged_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of staged() that nothing reads any more."""
    for df in tables:
        _live.pop(df.staged_at, None)
        discard(df.sparkSession, df.staged_at)


def discard(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a batch that goes to a Python worker: whole texts are wide.
BATCH = 2000


def ship(spark: SparkSession) -> None:
    """Make a session ready: Python workers get this package from where the driver has it, and batches of at most BATCH rows."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH:
        spark.conf.set(rows, BATCH)
    session.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions that a keyed exchange gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
