import datetime
import random

import pytest

from benchloom.streaming import resume, retries

SCHEMA = "id string, status string, attempt_number int"


def test_resume_adds_each_terminal_result_once(spark, tmp_path):
    log, out, state = (str(tmp_path / n) for n in ("log", "out", "state"))
    first = spark.createDataFrame([("a", "started", 1), ("a", "completed", 2), ("a", "failed", 3), ("b", "started", 1)], SCHEMA)
    second = spark.createDataFrame([("a", "completed", 4), ("b", "failed", 2), ("c", "completed", 1)], SCHEMA)
    for part in (first, second):
        part.write.mode("append").parquet(log)
        resume.append_new(resume.watch(spark, log, part.schema), out, state)
        resume.append_new(resume.watch(spark, log, part.schema), out, state)  # nothing new
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("id", "status", "attempt_number").collect())
    assert got == [("a", "completed", 2), ("b", "failed", 2), ("c", "completed", 1)]


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "completed", 1)], SCHEMA)
    rows.write.parquet(log)
    for attempt in ("one", "two"):  # the second run has lost its checkpoint and reads everything again
        resume.append_new(resume.watch(spark, log, rows.schema), out, str(tmp_path / attempt))
    assert spark.read.parquet(out).count() == 1


def test_progress(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame([("a", "completed", 1), ("b", "failed", 1), ("c", "completed", 1)], SCHEMA).write.parquet(log)
    stream = resume.progress(resume.watch(spark, log, spark.read.parquet(log).schema))
    stream.writeStream.outputMode("complete").format("memory").queryName("benchloom_progress").trigger(availableNow=True).start().awaitTermination()
    assert {r.status: r.n for r in spark.table("benchloom_progress").collect()} == {"completed": 2, "failed": 1}


def attempt(i, n, status, http=None, error=None, again=False, at=0):
    return (i, n, status, http, error, again, datetime.datetime.fromtimestamp(at, datetime.UTC))


ATTEMPT = "id string, attempt_number int, status string, http_status int, error_type string, retryable boolean, finished_at timestamp"


def replayed(spark, path, batches, **options):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = resume.watch(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema, files=1)
        retries.run_to(retries.decisions(stream, **options), f"{path}/out", f"{path}/state")  # each run starts from the checkpoint
    return spark.read.parquet(f"{path}/out")


def test_next_calls_go_on_after_a_restart(spark, tmp_path):
    first = [attempt("a", 1, "failed", 503, "Error", True, 10), attempt("b", 1, "failed", None, "AnswerFormatError", False, 10), attempt("c", 1, "failed", 401, "Error", False, 10), attempt("d", 1, "completed", at=10), attempt(None, 1, "completed")]
    second = [attempt("a", 1, "failed", 503, "Error", True, 10), attempt("a", 2, "completed", at=20), attempt("b", 2, "failed", 503, "Error", True, 20), attempt("d", 2, "failed", 503, "Error", True, 20), attempt("e", 2, "failed", 503, "Error", True, 20), attempt("e", 1, "failed", 503, "Error", True, 19)]
    log = replayed(spark, str(tmp_path), [first, second], tries=2, lateness="1 hour")
    got = {r.id: tuple(r)[1:] for r in retries.next_calls(log).collect()}
    assert got == {"a": (2, "completed", None, None), "b": (2, "failed", None, None), "c": (1, "refused", None, None), "d": (1, "completed", None, None), "e": (2, "failed", None, None)}
    assert {(r.id, r.attempt_number, r.next_mode, r.not_before) for r in log.where("next_mode is not null and not due").collect()} == {("a", 1, "json", 15_000_000), ("b", 1, "plain", 10_000_000)}


def test_calls_are_due_when_their_time_has_come(spark, tmp_path):
    batches = [[attempt("a", 1, "failed", 503, "Error", True, 10)], [attempt("x", 1, "completed", at=12)], [attempt("x", 2, "completed", at=100)], [attempt("y", 1, "completed", at=101)]]
    log = replayed(spark, str(tmp_path), batches[:2]).cache()
    assert log.where("due").count() == 0
    log = replayed(spark, str(tmp_path), batches[2:])
    assert [(r.id, r.attempt_number, r.next_mode, r.not_before) for r in log.where("due").collect()] == [("a", 1, "json", 15_000_000)]


@pytest.mark.parametrize("order", [0, 1, 2])
def test_cases_are_given_out_once(spark, tmp_path, order):
    rows = [(c, p) for c in range(6) for p in ("en", "de", "xx", "en", None) if (c, p) != (4, "de")] + [(None, "en")]
    rng = random.Random(order)
    rng.shuffle(rows)
    seen = []
    for part in (rows[:9], rows[9:20], rows[20:], rows):
        spark.createDataFrame(part, "case_id int, language string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = resume.watch(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files=2)
        retries.run_to(retries.complete_cases(stream, ["en", "de"]), str(tmp_path / "out"), str(tmp_path / "state"))
        seen.append(sorted(r.case_id for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen[-1] == seen[-2] == [0, 1, 2, 3, 5]
