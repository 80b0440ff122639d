"""Snapshots of nested rows by content: each row is kept once, however many samples and snapshots refer to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks


def entries(parts: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(key, kind, content): every other column of each part's rows as JSON, names in order, nulls left out."""
    one = lambda kind, df: df.select(F.col(key).cast("string").alias(key), F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(c for c in df.columns if c != key))).alias("content"))
    return reduce(DataFrame.unionByName, (one(kind, df) for kind, df in parts.items()))


def snapshot(parts: dict[str, DataFrame], path: str, key: str = "id") -> DataFrame:
    """Adds what the store at path lacks of the parts' rows, makes them its current snapshot, and returns their references (key, kind, sha256).

    A row that several samples share, or an earlier snapshot had, is one entry; a changed row makes a new one and the old one stays for the snapshots before.
    """
    kept = sinks.archive(entries(parts, key), f"{path}/content")
    sinks.replace_atomically(kept.select(key, "kind", "sha256"), f"{path}/references")
    return sinks.current(kept.sparkSession, f"{path}/references")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(kind, sha256, n): how many samples of the current snapshot refer to each entry."""
    return sinks.current(spark, f"{path}/references").groupBy("kind", "sha256").agg(F.count(F.lit(1)).alias("n"))


def unreferenced(spark: SparkSession, path: str) -> DataFrame:
    """(sha256): entries that the current snapshot doesn't refer to."""
    there = spark.read.schema("sha256 string, content binary, prefix string").parquet(f"{path}/content")
    return there.select("sha256").join(sinks.current(spark, f"{path}/references").select("sha256"), "sha256", "left_anti")


def restored(spark: SparkSession, path: str, kind: str, schema: str, key: str = "id") -> DataFrame:
    """The rows of a part as they were put in: (key, *schema)."""
    there = spark.read.schema("sha256 string, content binary, prefix string").parquet(f"{path}/content").select("sha256", F.col("content").cast("string").alias("content"))
    mine = sinks.current(spark, f"{path}/references").where(F.col("kind") == kind).join(there, "sha256")
    return mine.select(key, F.from_json("content", schema).alias("r")).select(key, "r.*")
