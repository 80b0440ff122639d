"""A table by key that takes upserts: sorted runs in buckets, and a merge that leaves one row for each key.

An upsert writes a run of its own: one row for each of its keys, dealt by a hash of the key over buckets and sorted by key there. The pointer of the
table names the runs that make it up, oldest first. Once there are MOST_RUNS of them they are merged bucket by bucket into a single one. Readers follow
the pointer, so that they see the table before or after a change, never between; runs that it no longer names stay
for readers that have just begun, until the next merge. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

#: Buckets of a run, runs from which on an upsert merges them.
BUCKETS, MOST_RUNS = 64, 8


def bucket_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs that make up the table, oldest first."""
    return [r for r in sinks.pointed(spark, path).split(",") if r]


def _last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    columns = [c for c in rows.columns if c != "run_"]
    return rows.groupBy(*(F.col(k).alias(f"key_{k}") for k in keys)).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row_")).select("row_.*")


def _write(rows: DataFrame, path: str, keys: list[str]) -> None:
    dealt = rows.withColumn("bucket", bucket_of(keys)).repartition(F.col("bucket"))
    dealt.sortWithinPartitions("bucket", *keys).write.partitionBy("bucket").parquet(path)


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The rows of these runs, with the place of their run as run_."""
    found = None
    for k, name in enumerate(names):
        run = spark.read.parquet(f"{path}/{name}").withColumn("run_", F.lit(k))
        found = run if found is None else found.unionByName(run, allowMissingColumns=True)
    return found


def upsert(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Adds rows; of each key the greatest order counts, and of equal ones the later upsert. Null keys are keys. Columns may be added over time; `bucket` is taken."""
    spark, run = rows.sparkSession, sinks.named("run")
    _write(_last(rows, keys, [F.col(c) for c in order]), f"{path}/{run}", keys)
    names = [*runs(spark, path), run]
    sinks.point(spark, path, ",".join(names))
    if len(names) >= MOST_RUNS:
        compact(spark, path, keys, order)


def read(spark: SparkSession, path: str, keys: list[str], order: list[str], wanted: list[tuple] | None = None) -> DataFrame:
    """A row for each key; with `wanted`, a short list of keys, of these, from their buckets alone."""
    names = runs(spark, path)
    if not names:
        raise FileNotFoundError(f"no table at {path}")
    rows = _rows(spark, path, names)
    if wanted is not None:
        asked = spark.createDataFrame(wanted, rows.select(*keys).schema).withColumn("bucket", bucket_of(keys))
        buckets = sorted({r["bucket"] for r in asked.select("bucket").collect()})  # as many as wanted
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
        rows = rows.where(F.col("bucket").isin(buckets)).alias("r").join(asked.distinct().alias("w"), same, "left_semi")
    if len(names) > 1:
        rows = _last(rows, keys, [*(F.col(c) for c in order), F.col("run_")])
    return rows.drop("bucket", "run_")


def compact(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> None:
    """Merges the runs into one. What was merged is deleted when the next merge is done."""
    names, run = runs(spark, path), sinks.named("run")
    if len(names) > 1:
        merged = _last(_rows(spark, path, names).drop("bucket"), keys, [*(F.col(c) for c in order), F.col("run_")])
        _write(merged, f"{path}/{run}", keys)
        sinks.point(spark, path, run)
        for old in sinks.folders(spark, path, "run-"):
            if old not in names and old < names[-1]:
                sinks.delete(spark, f"{path}/{old}")
