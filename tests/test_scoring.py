"""Fixed denominators, strict macros, usage, paired statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchloom.functions.text import LANGUAGES
from benchloom.operators import bootstrap, clusters, paired, scoring, usage


def cells():
    return [(v, q) for v in LANGUAGES for q in dict.fromkeys((v, "en", "zh"))]


def board(spark, without=()):
    refs = spark.createDataFrame([(f"{v}/{q}", v, q, "1") for v, q in cells()], "id string, image_language string, query_language string, answer string")
    preds = spark.createDataFrame([(f"{v}/{q}", "completed", "1.0" if v == q else "2") for v, q in cells() if (v, q) not in without], "id string, status string, prediction string")
    rows = scoring.graded(refs, preds).withColumn("cohort", F.lit("all"))
    return scoring.leaderboard(rows, scoring.expected_cells(spark), ["cohort"]).first()


def test_seventy_cells(spark):
    assert len(cells()) == 70 and scoring.expected_cells(spark).count() == 70
    r = board(spark)
    assert (r.XQA_ZH, r.XQA_EN, r.LQA_EN, r.failed_or_missing) == (0, 0, 100, 0)
    assert r.AVG == pytest.approx(100 * 24 / 70)


def test_missing_prediction_is_wrong(spark):
    r = board(spark, [("en", "en")])
    assert (r.LQA_EN, r.failed_or_missing, r.n) == (0, 1, 70)
    assert r.AVG == pytest.approx(100 * 23 / 70)


def test_macro_is_null_without_a_cell(spark):
    rows = spark.createDataFrame([("en", "en", 1)], "image_language string, query_language string, hit int").withColumns({"cohort": F.lit("c"), "prediction_status": F.lit("completed")})
    r = scoring.leaderboard(rows, scoring.expected_cells(spark), ["cohort"]).first()
    assert r.AVG is None and r.XQA_EN is None and r.LQA_EN == 100 and r.covered_configurations == 1


def test_judge_order_and_score(spark):
    refs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, answer string")
    preds = spark.createDataFrame([("a", "completed", "1"), ("b", "completed", "one"), ("c", "failed", None)], "id string, status string, prediction string")
    rows = scoring.graded(refs, preds)
    assert [r.id for r in scoring.pending_judgments(rows, spark.createDataFrame([], "id string")).collect()] == ["b"]
    found = scoring.judged(rows, spark.createDataFrame([("b", "equivalent")], "id string, verdict string"))
    assert {r.id: (r.verdict, r.method) for r in found.collect()} == {"a": ("equivalent", "strict"), "b": ("equivalent", "judge"), "c": ("different", "inference_failure")}
    by = scoring.graded(refs, preds, found.select("id", "correct"))
    assert scoring.coverage(by).first().micro_acc == pytest.approx(200 / 3)


ATTEMPT = "id string, attempt_number int, retryable boolean, http_status int, response_id string, answer_mode string, elapsed_seconds double, usage struct<input_tokens:long,output_tokens:long,total_tokens:long,input_tokens_details:struct<cached_tokens:long>,output_tokens_details:struct<reasoning_tokens:long>>"


def test_usage(spark):
    rows = spark.createDataFrame([(None, 1, True, None, None, None, 1.0, (100, 20, 120, (50,), (15,))), (None, 2, None, None, None, None, 1.0, None)], ATTEMPT)
    r = usage.usage_summary(rows).first()
    assert (r.api_attempts, r.transport_retries, r.total_tokens, r.cached_input_tokens, r.reasoning_output_tokens, r.usage_is_complete) == (2, 1, 120, 50, 15, False)
    assert usage.usage_summary(rows.where("attempt_number = 2")).first().total_tokens is None


def test_retry_kinds(spark):
    rows = spark.createDataFrame([("x", 1, False, 403, None, None, 1.0, None), ("x", 2, None, 200, None, None, 1.0, None)], ATTEMPT)
    r = usage.usage_summary(rows).first()
    assert (r.successful_http_responses, r.transport_retries, r.non_transport_retry_attempts) == (1, 0, 1)


def test_one_plain_fallback(spark):
    rows = spark.createDataFrame([("a", "json", True), ("b", "json", False), ("c", "json", True), ("c", "plain", False)], "id string, answer_mode string, bad boolean")
    assert {r.id: r.next_mode for r in usage.answer_modes(rows, F.col("bad")).collect()} == {"a": "plain", "b": "json", "c": None}


def test_bootstrap_reproduces_generators(spark):
    import random

    data = [(f"c{i:02d}", float(i % 4), float(4 + i % 3)) for i in range(17)]
    rows = spark.createDataFrame(data, "c string, total double, size double")
    r = bootstrap.ratio_interval(rows, ["c"], resamples=300)
    rng, samples = random.Random(42), []
    for _ in range(300):
        draw = rng.choices(data, k=len(data))
        samples.append(sum(d[1] for d in draw) / sum(d[2] for d in draw))
    samples.sort()
    assert (r.first().low, r.first().high) == (samples[int(0.025 * 299)], samples[int(0.975 * 299)])
    m = bootstrap.mean_intervals(rows, ["total"], ["c"], resamples=500).first()
    v = np.array([d[1] for d in data])
    boot = v[np.random.default_rng(20261002).integers(0, 17, (500, 17))].mean(axis=1)
    assert (m.low, m.high) == pytest.approx(tuple(np.quantile(boot, [0.025, 0.975])))
    h = bootstrap.hashed_interval(rows, "c", resamples=400).first()
    assert h.low == pytest.approx(r.first().low, abs=0.08) and h.high == pytest.approx(r.first().high, abs=0.08)


def test_components(spark):
    rows = spark.createDataFrame([(9, ["a"]), (4, ["a", "b"]), (7, ["b"]), (1, []), (3, ["z"])], "n long, keys array<string>")
    assert {r.n: r.component for r in clusters.components_of_keys(rows, "n", "keys").collect()} == {9: 4, 4: 4, 7: 4, 1: 1, 3: 3}


def test_long_chain(spark):
    links = spark.range(1, 400).selectExpr("id as a", "id - 1 as b")
    assert {r.label for r in clusters.connected_components(links).collect()} == {0}


def test_paired(spark):
    rows = spark.createDataFrame([("c", "en", 1), ("c", "fr", 0), ("c", "de", 1)], "case_id string, lang string, hit int")
    r = paired.seed_metrics(rows, ["case_id"], "lang", "en").first()
    assert tuple(r)[1:] == (100, 50, -50, 50, 0)
