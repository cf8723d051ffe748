"""Intermediates in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests).

    On a cluster the setting is required, since executors would write to disks of their own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not where:
        where = cached("shared_dir", lambda: "file://" + tempfile.mkdtemp(prefix="pageloom-"))
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/pageloom-{tag}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            delete(spark, path)
        except Exception:  # the session may have ended first; the folder's owner then clears it
            pass

    atexit.register(clean)
    return path


def written(df: DataFrame, tag: str, **options) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table that written() made and nothing reads any more."""
    delete(df.sparkSession, df.written_at)


def cached(key, make):
    """make()'s value, kept for the life of the Python process (functions arrive pickled anew with each task)."""
    store = sys.__dict__.setdefault("_pageloom_cache", {})
    if key not in store:
        store[key] = make()
    return store[key]
