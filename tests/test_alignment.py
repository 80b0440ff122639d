"""Audits over whole builds find nothing; identities are single."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from benchloom.operators import audit, identity
from benchloom.plans import checks


def test_whole_builds_pass(spark, sf_dir):
    rows = checks.build(spark, sf_dir)
    cases = rows.select("case_id", "base_id", F.col("source_question").alias("question"), F.col("source_answer").alias("answer")).distinct()
    localized = rows.select("case_id", "query_language", "question", "answer").distinct()
    images = rows.select("case_id", "image_language", F.col("image_path").alias("path"), F.col("image_sha256").alias("sha256")).distinct()
    refs = checks.references(rows)
    requests = refs.select("id", F.col("query").alias("question"), "image_path", "image_sha256")
    found = audit.variant_alignment(rows, cases, localized, images, None, ("fr", "en")) + audit.validation_alignment(refs, rows) + audit.run_alignment(refs, requests, refs)
    assert audit.report(spark, found).count() == 0
    whole = refs.withColumn("source_context", F.lit("x"))
    assert audit.revision(whole, whole.withColumn("source_context", F.lit("y")), ("source_context",)).count() == 0
    found = refs.select("image_path", F.col("image_sha256").alias("found_sha256")).distinct()
    assert audit.dependencies(refs, refs.select("case_id").distinct(), found, 4).count() == 0


def test_missing_values_differ(spark):
    mine = spark.createDataFrame([("a", None), ("b", "x"), ("c", None), ("d", "x")], "id string, v string")
    other = spark.createDataFrame([("a", None), ("b", None), ("c", "x")], "id string, w string")
    assert {r.key for r in audit.disagree(mine, other, ["id"], {"v": (["v"], ["w"])}, "id")[0].collect()} == {"b", "c"}
    assert {r.key for r in audit.absent("gone", mine, other, ["id"], "id").collect()} == {"d"}


def test_single_identities(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    whole = spark.createDataFrame([("a", 1), ("b", 2)], "id string, x int")
    assert {tuple(r) for r in identity.with_identity(rows, whole).collect()} == {("a", 1), ("b", 2)}
    for broken in (whole.where("x = 1"), whole.unionByName(whole)):
        with pytest.raises(PySparkException):
            identity.with_identity(rows, broken).collect()
