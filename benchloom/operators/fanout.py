"""From cases to language configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES
from .identity import variant_id


def languages(spark, order: tuple[str, ...] = LANGUAGES) -> DataFrame:
    return spark.createDataFrame(list(enumerate(order)), "language_order int, language string")


def variants(cases: DataFrame, codes: DataFrame, case: str = "base_id", pivots: tuple[str, ...] = ("zh", "en")) -> DataFrame:
    """cases, once for each image language and for each language asked in it: itself and the pivots (3L - 2 of them).

    The languages are a fixed short list, so that the product with them is a generator in the scan, without a shuffle.
    """
    images = cases.crossJoin(F.broadcast(codes.select(F.col("language").alias("image_language"))))
    asked = F.array_distinct(F.array(F.col("image_language"), *map(F.lit, pivots)))
    rows = images.withColumn("query_language", F.explode(asked))
    own = F.col("image_language") == F.col("query_language")
    named = F.when(own, "monolingual").otherwise(F.concat(F.lit("cross_"), F.col("query_language")))
    return rows.withColumns({"answer_language": F.col("query_language"), "configuration": named, "variant_id": variant_id(F.col(case).cast("string"), F.col("image_language"), F.col("query_language"))})


def with_locales(rows: DataFrame, locales: DataFrame, case: str = "case_id") -> DataFrame:
    """rows joined to locales(case, language, ...) of the language asked in."""
    return rows.join(locales.withColumnRenamed("language", "query_language"), [case, "query_language"])


def image_manifest(rows: DataFrame, case: str = "case_id") -> DataFrame:
    """One row for each image; all variants of an image must name the same file."""
    return rows.groupBy(case, "image_language").agg(F.min("image_path").alias("image_path"), F.min("image_sha256").alias("image_sha256"), F.count(F.lit(1)).alias("variants"), (F.min("image_sha256") == F.max("image_sha256")).alias("consistent"))


def namespaced(labels: Column, panel: int) -> Column:
    """A panel's labels, keys prefixed so that panels can be merged."""
    return F.transform_keys(labels, lambda k, v: F.concat(F.lit(f"panel_{panel:02d}_"), k))


def collapsed_labels(labels: DataFrame) -> DataFrame:
    """(case_id, language, translated, keys) where different originals became the same text, case and edge blanks aside.

    labels(case_id, language, key, original, translated).
    """
    folded = F.lower(F.trim("translated"))
    grouped = labels.groupBy("case_id", "language", folded.alias("translated")).agg(F.countDistinct(F.lower(F.trim("original"))).alias("n"), F.sort_array(F.collect_set("key")).alias("keys"))
    return grouped.where("n > 1").drop("n")
