"""Scores with a fixed denominator: a reference without a completed prediction is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES, same_answer

CELL = ["image_language", "query_language"]


def graded(references: DataFrame, predictions: DataFrame, verdicts: DataFrame | None = None, normal=None) -> DataFrame:
    """references with prediction, prediction_status (missing if there is none) and hit (0 or 1).

    predictions(id, status, prediction); verdicts(id, correct) if a judge decides, false where it said nothing.
    """
    found = predictions.select("id", F.col("status").alias("prediction_status"), "prediction")
    rows = references.join(found, "id", "left").withColumn("prediction_status", F.coalesce("prediction_status", F.lit("missing")))
    if verdicts is None:
        right = same_answer(F.col("prediction"), F.col("answer"), normal)
    else:
        rows = rows.join(verdicts.select("id", F.col("correct").alias("__correct")), "id", "left")
        right = F.coalesce("__correct", F.lit(False))
    return rows.withColumn("hit", ((F.col("prediction_status") == "completed") & right).cast("int")).drop("__correct")


def accuracy(hit: str = "hit") -> Column:
    return 100 * F.sum(hit) / F.count(F.lit(1))


def cell_accuracy(rows: DataFrame, cell: list[str] = CELL, by: list[str] | None = None) -> DataFrame:
    """(by, cell, acc, n)."""
    return rows.groupBy(*(by or []), *cell).agg(accuracy().alias("acc"), F.count(F.lit(1)).alias("n"))


def strict_macro(cells: DataFrame, expected: DataFrame, cell: list[str] = CELL, by: list[str] | None = None) -> DataFrame:
    """(by, avg, covered, expected): the mean of the expected cells' accuracies, null unless all of them exist.

    expected(cell[, by]); without rows for a `by` value nothing is said of it.
    """
    keys = (by or []) + cell
    joined = expected.select(*keys).join(cells, keys, "left")
    grouped = joined.groupBy(*by) if by else joined.groupBy()
    mean = F.when(F.count("acc") == F.count(F.lit(1)), F.avg("acc"))
    return grouped.agg(mean.alias("avg"), F.count("acc").alias("covered"), F.count(F.lit(1)).alias("expected"))


def expected_cells(spark, languages: tuple[str, ...] = LANGUAGES, pivots: tuple[str, ...] = ("en", "zh")) -> DataFrame:
    """The 3L - 2 cells: each image language asked in itself and in the pivots."""
    images = spark.createDataFrame([(x,) for x in languages], "image_language string")
    asked = F.array_distinct(F.array(F.col("image_language"), *map(F.lit, pivots)))
    return images.select("image_language", F.explode(asked).alias("query_language"))


def leaderboard(rows: DataFrame, expected: DataFrame, by: list[str], pivots: tuple[str, ...] = ("zh", "en"), languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """One row for each `by`: XQA of each pivot, LQA of each language, AVG over all cells, micro accuracy and coverage."""
    groups = rows.select(*by).distinct()
    wanted = groups.crossJoin(F.broadcast(expected))  # the few cells, for each cohort
    cells = wanted.join(cell_accuracy(rows, by=by), by + CELL, "left")
    image, query = F.col("image_language"), F.col("query_language")

    def strict(where: Column) -> Column:
        of = F.count_if(where)
        return F.when((of > 0) & (F.count_if(where & F.col("acc").isNotNull()) == of), F.avg(F.when(where, F.col("acc"))))

    metrics = [strict((query == p) & (image != p)).alias(f"XQA_{p.upper()}") for p in pivots]
    metrics += [F.max(F.when((image == x) & (query == x), F.col("acc"))).alias(f"LQA_{x.upper()}") for x in languages]
    metrics += [strict(F.lit(True)).alias("AVG"), F.count("acc").alias("covered_configurations")]
    return cells.groupBy(*by).agg(*metrics).join(coverage(rows, by), by)


def coverage(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, completed, failed_or_missing, coverage, micro_acc)."""
    done = F.count_if(F.col("prediction_status") == "completed")
    n = F.count(F.lit(1))
    return rows.groupBy(*(by or [])).agg(n.alias("n"), done.alias("completed"), (n - done).alias("failed_or_missing"), F.try_divide(done, n).alias("coverage"), F.try_divide(100 * F.sum("hit"), n).alias("micro_acc"))


def cohorts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each row once for every cohort whose rule holds, named in `cohort`: one scan for all cohorts."""
    named = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))
    return rows.withColumn("cohort", F.explode(named))


def family(column: str = "visual_family", other: str = "visual_kind") -> Column:
    return F.coalesce(column, other)


def by_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, acc, n) for each single-valued field, in one pass of grouping sets."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return rows.select("hit", F.inline(parts)).groupBy("field", "value").agg(accuracy().alias("acc"), F.count(F.lit(1)).alias("n"))


def by_labels(rows: DataFrame, labels: str, default: str | None = None) -> DataFrame:
    """(value, acc, n) over an array column's elements; rows without any count under default, or not at all."""
    values = F.col(labels) if default is None else F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.col(labels)).otherwise(F.array(F.lit(default)))
    return rows.select("hit", F.explode(values).alias("value")).groupBy("value").agg(accuracy().alias("acc"), F.count(F.lit(1)).alias("n"))


def macro_of(rows: DataFrame, field: str) -> DataFrame:
    """One row: the mean of a field's groups' accuracies."""
    return rows.groupBy(field).agg(accuracy().alias("acc")).agg(F.avg("acc").alias("macro"), F.count(F.lit(1)).alias("groups"))


def matched_gaps(rows: DataFrame, pivots: tuple[str, ...], base: str = "base_id") -> DataFrame:
    """(pivot, gap, pairs): mean of own-language less pivot-language hits over bases and image languages that have both."""
    own = F.max(F.when(F.col("query_language") == F.col("image_language"), F.col("hit")))
    asked = rows.where(F.col("query_language").isin(*pivots) | (F.col("query_language") == F.col("image_language")))
    grouped = asked.groupBy(base, "image_language").agg(own.alias("own"), *(F.max(F.when(F.col("query_language") == p, F.col("hit"))).alias(p) for p in pivots))
    pairs = F.array(*(F.struct(F.lit(p).alias("pivot"), F.when(F.col("image_language") != p, F.col("own") - F.col(p)).alias("gap")) for p in pivots))
    return grouped.select(F.inline(pairs)).groupBy("pivot").agg(F.avg("gap").alias("gap"), F.count("gap").alias("pairs"))


def with_corrections(references: DataFrame, corrections: DataFrame) -> DataFrame:
    """references with answer_effective and correction_id; a correction of another source row or answer gives correction_error.

    corrections(case_id, id, source, file, row_index, original_answer, corrected_answer), a short list.
    """
    c = corrections.select("case_id", *(F.col(x).alias(f"__{x}") for x in corrections.columns if x != "case_id"))
    rows = references.join(c, "case_id", "left")
    bound = (F.col("source") == F.col("__source")) & (F.col("file") == F.col("__file")) & (F.col("row_index") == F.col("__row_index")) & (F.col("answer") == F.col("__original_answer"))
    has, fits = F.col("__id").isNotNull(), F.coalesce(bound, F.lit(False))
    return rows.select(*references.columns, F.when(has & fits, F.col("__corrected_answer")).otherwise(F.col("answer")).alias("answer_effective"), F.when(has & fits, F.col("__id")).alias("correction_id"), (has & ~fits).alias("correction_error"))


def judged(rows: DataFrame, judgments: DataFrame) -> DataFrame:
    """Verdicts, cheapest first: failed predictions differ, strict matches are equivalent, the judge decides the rest.

    judgments(id, verdict); uncertain counts as different. Adds verdict, method and correct.
    """
    found = judgments.select("id", F.col("verdict").alias("__verdict"))
    strict, done = F.col("hit") == 1, F.col("prediction_status") == "completed"
    verdict = F.when(~done, "different").when(strict, "equivalent").when(F.col("__verdict") == "equivalent", "equivalent").otherwise("different")
    method = F.when(~done, "inference_failure").when(strict, "strict").when(F.col("__verdict").isNull(), "judge_error").otherwise("judge")
    return rows.join(found, "id", "left").withColumns({"verdict": verdict, "method": method, "correct": verdict == "equivalent"}).drop("__verdict")


def pending_judgments(rows: DataFrame, judgments: DataFrame) -> DataFrame:
    """Rows that still need a judge: completed, not strictly equal, not judged."""
    return rows.where("prediction_status = 'completed' and hit = 0").join(judgments.select("id"), "id", "left_anti")


def normalized_verdict(verdict: Column) -> Column:
    """struct(verdict, was_uncertain)."""
    return F.struct(F.when(verdict == "uncertain", "different").otherwise(verdict).alias("verdict"), F.coalesce(verdict == "uncertain", F.lit(False)).alias("was_uncertain"))


def failure_kind(method: Column, status: Column) -> Column:
    return F.when(method == "judge_error", "judge_error").when(status != "completed", "inference_failure")


def outcome_changes(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, before, after, change, gained, lost) of two gradings of the same ids."""
    b = after.select("id", F.col("hit").alias("__after"))
    rows = before.join(b, "id", "left").withColumn("__after", F.coalesce("__after", F.lit(0)))
    n = F.count(F.lit(1))
    return rows.groupBy(*(by or [])).agg(n.alias("n"), (100 * F.sum("hit") / n).alias("before"), (100 * F.sum("__after") / n).alias("after"), (100 * F.sum(F.col("__after") - F.col("hit")) / n).alias("change"), F.count_if(F.expr("hit = 0 and __after = 1")).alias("gained"), F.count_if(F.expr("hit = 1 and __after = 0")).alias("lost"))


def language_place(column: str, order: tuple[str, ...] = LANGUAGES) -> Column:
    """A language's place in the fixed order, from 1; 0 if it has none."""
    return F.array_position(F.array(*map(F.lit, order)), F.col(column))


def in_language_order(rows: DataFrame, column: str, order: tuple[str, ...] = LANGUAGES) -> DataFrame:
    return rows.orderBy(language_place(column, order), column)


def first_per(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(at)).where(F.col("__n") <= n).drop("__n")
