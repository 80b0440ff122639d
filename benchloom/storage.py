"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder if that is unset in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("benchloom.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="benchloom-")
        spark.conf.set("benchloom.shared.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: it cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/benchloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._benchloom_path = path
    return out


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, never sent whole through the driver in its join with another table: for tables that grow with the input.

    Spark's size check judges a table by its compressed files and its column types, and takes no account of an explode: one of millions of
    rows can pass for less than the threshold of a broadcast.
    """
    return df.hint("merge")


#: Seconds between two requests to clear shuffle files, and when the last one was.
CLEAR_EVERY = 3.0
_cleared = 0.0


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes frames made by stored() that nothing reads any more.

    Spark removes shuffle files once the driver's collector has found their plans unused, by itself every 30 minutes: too late for
    jobs that shuffle their whole input several times. A session that sets spark.cleaner.periodicGC.interval (a minute, say) leaves that to Spark;
    for others a collection is asked for, at most every CLEAR_EVERY seconds.
    """
    global _cleared
    jvm = spark.sparkContext._jvm
    for frame in frames:
        path = jvm.org.apache.hadoop.fs.Path(frame._benchloom_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if time.monotonic() - _cleared > CLEAR_EVERY and not spark.sparkContext.getConf().contains("spark.cleaner.periodicGC.interval"):
        jvm.System.gc()
        _cleared = time.monotonic()
