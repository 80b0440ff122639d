"""Audits accept what is right and catch each mutation."""

import pytest
from pyspark.sql import functions as F

from benchloom.operators import audit, incremental, predicates, sets

LANGS = ("en", "zh", "fr")


def release(spark):
    rows = [(f"{c}/{v}/{q}", c, v, q, f"img-{c}-{v}", f"images/{c}/{v}.png", f"Q {c} {q}", "5") for c in ("c1", "c2") for v in LANGS for q in dict.fromkeys((v, "en", "zh"))]
    return spark.createDataFrame(rows, "id string, case_id string, image_language string, query_language string, image_sha256 string, image_path string, query string, answer string")


def names(df):
    return {r.check for r in df.collect()}


def test_release(spark):
    rows = release(spark)
    files = rows.select(F.col("image_path").alias("path")).distinct()
    assert names(audit.release(rows, files, 2, 3)) == set()
    first = F.col("id") == "c1/en/en"
    assert "configurations_of_case" in names(audit.release(rows.where(~first), files, 2, 3))
    assert "unique_ids" in names(audit.release(rows.unionByName(rows.where(first)), files, 2, 3))
    assert "one_hash_for_image" in names(audit.release(rows.withColumn("image_sha256", F.when(first, "x").otherwise(F.col("image_sha256"))), files, 2, 3))
    assert "files" in names(audit.release(rows.withColumn("image_path", F.when(first, "../x").otherwise(F.col("image_path"))), files, 2, 3))


@pytest.mark.parametrize("field", ["answer", "image_sha256", "query"])
def test_revision_allows_context_only(spark, field):
    old = release(spark).withColumn("source_context", F.lit("a"))
    assert names(audit.revision(old, old.withColumn("source_context", F.lit("b")), ("source_context",))) == set()
    assert names(audit.revision(old, old.withColumn(field, F.when(F.col("id") == "c1/en/en", "x").otherwise(F.col(field))), ("source_context",))) == {"field_changed"}
    assert names(audit.revision(old, old.where("id <> 'c1/en/en'"), ("source_context",))) == {"rows_changed"}


def test_run(spark):
    refs = spark.createDataFrame([("a",), ("b",)], "id string")
    preds = spark.createDataFrame([("a", "completed", "k"), ("b", "started", "other")], "id string, status string, run_key string")
    assert names(audit.run(refs, preds, "k")) == {"terminal", "run_key"}
    assert names(audit.run(refs, preds.where("id = 'a'"), "k")) == {"complete"}
    with pytest.raises(ValueError):
        audit.require(audit.run(refs, preds, "k"))


def test_judgments(spark):
    rows = spark.createDataFrame([("a", "equivalent", "r", "pass"), ("b", "maybe", "r", "pass"), ("c", "different", " ", "pass"), ("d", "different", "r", None)], "id string, verdict string, reason string, language_compliance string")
    assert {(r.check, r.key) for r in audit.judgments(rows.withColumn("category", F.when(F.col("id") != "a", ""))).collect()} == {("category", "a"), ("verdict", "b"), ("reason", "c"), ("language_compliance", "d")}


def test_classifications(spark):
    schema = "case_id string, visual_kind string, table_structure struct<row_spans:boolean,column_spans:boolean>, confidence double, layout string, panel_count int"
    kinds = [("Simple Table", False, False), ("Row-Spanning Table", True, False), ("Column-Spanning Table", False, True), ("Mixed-Spanning Table", True, True)]
    good = spark.createDataFrame([(k, k, (r, c), 0.9, "single", 1) for k, r, c in kinds], schema)
    assert names(audit.classifications(good)) == set()
    bad = spark.createDataFrame([(k, k, (not r, c), 0.9, "single", 2) for k, r, c in kinds], schema)
    assert names(audit.classifications(bad)) == {"span_class", "panels"}


def test_geometry(spark):
    schema = "image string, box int, left double, top double, right double, bottom double, width double, height double"
    rows = spark.createDataFrame([("i", 1, 0.0, 0.0, 300.0, 300.0, 600.0, 600.0), ("i", 2, 299.0, 299.0, 400.0, 400.0, 600.0, 600.0), ("i", 3, 400.0, 0.0, 601.0, 10.0, 600.0, 600.0), ("j", 1, 0.0, 0.0, 5.0, 5.0, 9.0, 9.0)], schema)
    assert {(r.check, r.key, r.detail) for r in audit.geometry(rows).collect()} == {("overlap", "i", "1/2"), ("inside_canvas", "i", "3")}


def test_reuse_plan(spark):
    fields = ("query", "answer")
    old = spark.createDataFrame([("a", "q", None), ("b", "q", "x"), ("c", "q", "x")], "id string, query string, answer string")
    new = spark.createDataFrame([("a", "q", None), ("b", "q", "y"), ("c", "q", "x"), ("d", "q", "x")], "id string, query string, answer string")
    results = spark.createDataFrame([("a", "completed"), ("b", "completed"), ("c", "started")], "id string, status string")
    actions = incremental.plan(old, new, results, fields)
    assert {r.id: r.action for r in actions.collect()} == {"a": "reuse", "b": "rerun", "c": "run", "d": "run"}
    assert [r.id for r in incremental.invalidated(actions).collect()] == ["b"]
    fresh = spark.createDataFrame([("b", "failed"), ("c", "completed"), ("d", "completed")], "id string, status string")
    assert incremental.merged_results(results, fresh, actions).count() == 4


def test_context_allow_list(spark):
    rows = spark.createDataFrame([("1", "ChartQAPro", None, "a\n\nb", None, None), ("2", "MMTU", "FinQA", None, ["x"], ["y", "z"]), ("3", "MMTU", "WikiQA", None, ["x"], None), ("4", "ChartQA", None, "p", None, None), ("5", "ChartQAPro", None, " ", None, None)], "case_id string, source string, dataset string, paragraph string, pre_text array<string>, post_text array<string>")
    got = {(r.case_id, r.id): r.text for r in predicates.allowed_context(rows).collect()}
    assert got == {("1", "document_000"): "a", ("1", "document_001"): "", ("1", "document_002"): "b", ("2", "pre_000"): "x", ("2", "post_000"): "y", ("2", "post_001"): "z"}


def test_sets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (3,)], "k int")
    assert {(r.k, r.side) for r in sets.row_diff(a, b).collect()} == {(1, "old"), (2, "old"), (3, "new")}
    assert sets.replaced_selection(a.distinct(), b.where("k = 1"), b.where("k = 3"), 2, "k").count() == 2
    with pytest.raises(Exception, match="another size"):
        sets.replaced_selection(a.distinct(), b.where("k = 1"), b.where("k = 3"), 5, "k").collect()
    m = spark.sql("select map('a', 1, 'b', 2) as l, map('b', 3) as r").select(sets.merged(F.col("l"), F.col("r")).alias("m")).first().m
    assert m == {"a": 1, "b": 3}


def test_alignments_send_no_table_through_the_driver(spark):
    links = spark.createDataFrame([(1, "r1", "p1"), (2, "r2", "p2"), (3, None, "p3")], "case_id long, request_sha256 string, payload_sha256 string")
    requests = spark.createDataFrame([("r1", 9, "r1", "p1")], "request_sha256 string, case_id long, sha256 string, payload_sha256 string")
    paths = spark.createDataFrame([("a",), ("b",)], "path string")
    checks = [*audit.request_alignment(links, requests), audit.unavailable(links, requests), audit.references_found("files", paths, paths.where("path = 'a'"), "path")]
    assert [r.key for c in checks for r in c.collect()] == ["1", "2", "b"]
    assert not [c for c in checks if "Broadcast" in c._jdf.queryExecution().executedPlan().toString()]


@pytest.mark.parametrize("kind, a, b", [("double", 0.0, float("nan")), ("timestamp", "2020-01-01", "2020-01-02"), ("string", "a", "b"), ("boolean", True, False)])
def test_constant_fields(spark, kind, a, b):
    groups = {"same": [a, a], "varied": [a, b], "null": [None, None], "partly": [a, None], "mixed": [a, None, b], "one": [b], "twice": [b, b]}
    rows = spark.createDataFrame([(k, None if v is None else str(v)) for k, g in groups.items() for v in g], "k string, v string").withColumn("v", F.col("v").cast(kind))
    found = audit.constant("c", rows, ["k"], ["v"])
    passes = found._jdf.queryExecution().executedPlan().toString().count("Aggregate(")
    assert (passes > 2) == (kind == "string")
    assert {(r.key, r.detail) for r in found.collect()} == {(k, "v") for k in ("varied", "partly", "mixed")}
