"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Stashes made inside the innermost finished() that is under way, of this thread alone.
_OPEN: ContextVar[list[DataFrame] | None] = ContextVar("stashes", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (master := spark.sparkContext.master).startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lathework-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage for good."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    made = _OPEN.get()
    if made is not None:
        made.append(out)
    return out


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """A stash of what make() returns; all other stashes made on the way are deleted once it is written."""
    made: list[DataFrame] = []
    token = _OPEN.set(made)
    try:
        out = stash(make())
    finally:
        _OPEN.reset(token)
    discard(*made[:-1])
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the tables behind stash()es that nothing reads any more, and the shuffle files of steps that are over.

    Spark deletes a shuffle's files when the driver's JVM collects the plan that it belongs to, which by itself may
    come hours later; so a collection is asked for here.
    """
    for df in tables:
        path = getattr(df, "_stash_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            df._stash_path = None
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Gives a written table another name, in place of a table that has it."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    files = new.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(new, True)
    if not files.rename(old, new):
        raise OSError(f"not renamed: {path} to {to}")
