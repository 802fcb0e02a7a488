"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may still be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000

#: Shuffle files of a query are deleted as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where none is set and all tasks run on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own_dir[0]


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written once and read back: lineage ends here, and lost executors cost nothing."""
    return kept_at(df, tag)[0]


def folder(spark: SparkSession, tag: str) -> str:
    """The path of a new scratch folder, which release() deletes."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def kept_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As kept, with the path that discard() takes."""
    path = folder(df.sparkSession, tag)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, path: str, mode: str = "error", **options: str) -> None:
    """Write df, whose shuffles nothing reads afterwards: their files go at once, not when the driver's garbage is next collected."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).options(**options).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def count_files(spark: SparkSession, path: str, ending: str) -> int:
    """How many files of a folder have the ending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sum(f.getPath().getName().endswith(ending) for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def discard(spark: SparkSession, path: str) -> None:
    """Delete one scratch table, whose readers have all been written."""
    if path in _written:
        _written.remove(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete this process's scratch tables; call it once results that read them are written."""
    for path in list(_written):
        discard(spark, path)


def small_or_shuffled(right: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint if the table (kept, so counting is cheap) is within the bound, else none."""
    n = right.count() if rows is None else rows
    return F.broadcast(right) if n <= BROADCAST_ROWS else right.hint("merge")
