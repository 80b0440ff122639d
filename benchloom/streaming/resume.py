"""Runs as streams of result rows: resumable batches, counters, first terminal result wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders that the keys of a sink are dealt over.
BUCKETS = 64


def watch(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """New Parquet files below a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append_new(results: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "attempt_number") -> None:
    """Adds terminal results of keys that the sink at path doesn't have yet, and stops when all that is there is read.

    A batch that is replayed after a failure overwrites its own part, so each result is written once. Each part is dealt by a hash of
    the key over BUCKETS folders, and a batch reads the folders of its own keys only.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        fresh = batch.where("status in ('completed', 'failed')").groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct(order, "status")).alias("r")).select("r.*").withColumn("bucket", bucket)
        if fs.exists(root):
            mine = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS or fewer
            done = spark.read.parquet(path).where((F.col("batch") != number) & F.col("bucket").isin(mine)).select(key)
            fresh = fresh.join(done, key, "left_anti")
        fresh.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def progress(results: DataFrame) -> DataFrame:
    """Running counts by status: an aggregate view for a console or memory sink in update mode."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
