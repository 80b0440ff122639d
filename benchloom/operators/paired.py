"""Paired comparison of one case's outcomes across languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed_metrics(rows: DataFrame, case: list[str], language: str, baseline: str, hit: str = "hit") -> DataFrame:
    """(case, baseline_acc, cross_acc, delta_pp, correct_to_wrong_pct, wrong_to_correct_pct) in percent, one pass."""
    own = F.col(language) == baseline
    base = F.max(F.when(own, F.col(hit)))
    share = lambda value: F.avg(F.when(~own, (F.col(hit) == value).cast("double")))
    g = rows.groupBy(*case).agg(base.alias("base"), share(1).alias("right"), share(0).alias("wrong"))
    return g.select(*case, (100.0 * F.col("base")).alias("baseline_acc"), (100.0 * F.col("right")).alias("cross_acc"), (100.0 * (F.col("right") - F.col("base"))).alias("delta_pp"), F.when(F.col("base") == 1, 100.0 * F.col("wrong")).otherwise(F.lit(0.0)).alias("correct_to_wrong_pct"), F.when(F.col("base") == 0, 100.0 * F.col("right")).otherwise(F.lit(0.0)).alias("wrong_to_correct_pct"))


METRICS = ("baseline_acc", "cross_acc", "delta_pp", "correct_to_wrong_pct", "wrong_to_correct_pct")


def subgroups(rows: DataFrame, groups: Column, by: list[str] | None = None) -> DataFrame:
    """(by, group, n, mean of each metric); a case counts in each of its groups."""
    exploded = rows.withColumn("group", F.explode(groups))
    return exploded.groupBy(*(by or []), "group").agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in METRICS))


def sensitivity(rows: DataFrame, case: list[str], failed: Column, settings: str, plain: Column) -> DataFrame:
    """(case, failure_free, clean): clean if nothing failed, one setting was used and no plain answer was taken."""
    free = ~F.bool_or(F.coalesce(failed, F.lit(False)))
    return rows.groupBy(*case).agg(free.alias("failure_free"), (free & (F.countDistinct(settings) <= 1) & ~F.bool_or(F.coalesce(plain, F.lit(False)))).alias("clean"))


def coverage_curve(rows: DataFrame, case: list[str], most: int, hit: str = "hit", by: list[str] | None = None) -> DataFrame:
    """(by, k, pct): the share of cases with k hits or more, for k from 1 to most."""
    totals = rows.groupBy(*(by or []), *case).agg(F.sum(hit).alias("total"))
    at = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")
    # Counts by total first: `most` rows for each total, not for each case.
    counted = totals.groupBy(*(by or []), "total").agg(F.count(F.lit(1)).alias("cases"))
    expanded = counted.select(*(by or []), "total", "cases", at)
    return expanded.groupBy(*(by or []), "k").agg((100 * F.sum(F.when(F.col("total") >= F.col("k"), F.col("cases")).otherwise(0)) / F.sum("cases")).alias("pct"))


def pass_fractions(checks: DataFrame, name: str = "check", passed: str = "passed") -> DataFrame:
    """(check, passed, total, rate); null outcomes don't count, and a rate over nothing is null."""
    return checks.groupBy(name).agg(F.count_if(F.col(passed)).alias("passed"), F.count(passed).alias("total"), F.try_divide(F.count_if(F.col(passed)).cast("double"), F.count(passed)).alias("rate"))


def issue_histogram(rows: DataFrame, rules: dict[str, Column], case: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """((case, issues) of cases with any, (issue, n))."""
    found = rows.select(case, F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items()))).alias("issues")).where(F.size("issues") > 0)
    return found, found.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
