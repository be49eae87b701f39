"""What operators need of a session: the shared folder, written copies, and this package on the workers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("a cluster needs spark.checkpoint.dir: a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidemill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable copy of df, written to the shared folder: a lost executor costs no more than what is read again."""
    path = f"{shared_dir(df.sparkSession)}/copy-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.copied_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a copy of cut_lineage() that nothing reads any more."""
    jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(df.copied_to)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def narrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, what is run sends Python workers at most about `most` bytes at once: for rows that are wide."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def free(df: DataFrame, name: str) -> str:
    """`name`, or with as many underscores after it as make it differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
