"""Accounting of attempts, retries and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metric and the field of `usage` that reports it.
TOKENS = {"input_tokens": "usage.input_tokens", "output_tokens": "usage.output_tokens", "total_tokens": "usage.total_tokens", "cached_input_tokens": "usage.input_tokens_details.cached_tokens", "reasoning_output_tokens": "usage.output_tokens_details.reasoning_tokens"}


def with_previous(attempts: DataFrame, columns: list[str], key: str = "id", number: str = "attempt_number") -> DataFrame:
    """attempts with has_previous and previous_<column>s of the attempt numbered one less; null keys match each other."""
    before = attempts.select(F.col(key).alias("__key"), (F.col(number) + 1).alias("__number"), *(F.col(c).alias(f"previous_{c}") for c in columns), F.lit(True).alias("has_previous"))
    joined = attempts.join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col(number) == F.col("__number")), "left")
    return joined.withColumn("has_previous", F.coalesce("has_previous", F.lit(False))).drop("__key", "__number")


def with_lagged(attempts: DataFrame, columns: list[str], key: str = "id", number: str = "attempt_number") -> DataFrame:
    """The same for attempts numbered without gaps or repeats: one shuffle instead of a join."""
    at = Window.partitionBy(key).orderBy(number)
    return attempts.withColumns({"has_previous": F.lag(F.lit(True), 1, False).over(at), **{f"previous_{c}": F.lag(c).over(at) for c in columns}})


def token_totals(by_field: dict[str, str]) -> list[Column]:
    """Sums that are null if nobody reported, and how many did."""
    return [c for name, path in by_field.items() for c in (F.sum(path).alias(name), F.count(path).alias(f"{name}_reported_attempts"))]


def usage_summary(attempts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Attempts, retries by cause, token totals and completeness, for each `by` or overall."""
    rows = with_previous(attempts, ["retryable"])
    n, retry = F.count(F.lit(1)), (F.col("attempt_number") > 1) & F.col("has_previous")
    transport = retry & F.coalesce("previous_retryable", F.lit(False))
    answered = F.coalesce(F.col("response_id") != "", F.lit(False)) | F.coalesce(F.col("http_status").between(200, 299), F.lit(False))
    reported = F.count("usage")
    return rows.groupBy(*(by or [])).agg(
        n.alias("api_attempts"), reported.alias("attempts_with_usage"), (n - reported).alias("attempts_without_usage"), (n == reported).alias("usage_is_complete"), F.count_if(answered).alias("successful_http_responses"),
        F.count_if(retry).alias("retry_attempts"), F.count_if(transport).alias("transport_retries"), F.count_if(retry & ~transport).alias("non_transport_retry_attempts"),
        F.count_if(F.col("answer_mode") == "plain").alias("plain_answer_fallback_calls"), F.countDistinct("id").alias("logical_qa_attempted"), F.round(F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0)), 3).alias("sum_attempt_elapsed_seconds"), *token_totals(TOKENS),
    )


def plain_totals(rows: DataFrame, fields: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Sums in which what wasn't reported counts as 0."""
    return rows.groupBy(*(by or [])).agg(*(F.coalesce(F.sum(path), F.lit(0)).alias(name) for name, path in fields.items()))


def state_counters(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) for several fields of a log in one scan; nulls count."""
    parts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))
    return rows.select(F.inline(parts)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def normalized_usage(meta: str = "usage_metadata") -> Column:
    """A provider's counts in the common form: output is candidates and thoughts, else total less prompt if no tool took part."""
    get = lambda name: F.col(f"{meta}.{name}")
    prompt, total, candidate, thought = (get(f"{x}TokenCount") for x in ("prompt", "total", "candidates", "thoughts"))
    tools = F.coalesce(get("toolUsePromptTokenCount"), F.lit(0)) > 0
    output = F.when(candidate.isNotNull() & thought.isNotNull(), candidate + thought).when((total >= prompt) & ~tools, total - prompt)
    return F.when(F.col(meta).isNotNull(), F.struct(prompt.alias("input_tokens"), output.alias("output_tokens"), total.alias("total_tokens"), F.struct(get("cachedContentTokenCount").alias("cached_tokens")).alias("input_tokens_details"), F.struct(thought.alias("reasoning_tokens")).alias("output_tokens_details"), candidate.alias("visible_candidate_tokens")))


def answer_modes(attempts: DataFrame, format_failure: Column, most: int = 11) -> DataFrame:
    """(id, attempts, next_mode): json until an answer couldn't be read, then plain once; null when no call is left."""
    plain = F.bool_or(F.coalesce(F.col("answer_mode") == "plain", F.lit(False)))
    unread = F.bool_or(format_failure)
    n = F.count(F.lit(1))
    mode = F.when(plain, F.lit(None).cast("string")).when(unread, "plain").when(n < most, "json")
    return attempts.groupBy("id").agg(n.alias("attempts"), mode.alias("next_mode"))


def recover_answers(results: DataFrame, attempts: DataFrame, format_failure: Column, extract) -> DataFrame:
    """(id, recovered, prediction, attempt_number, queued): failed results whose last unread answer can be read after all.

    extract: a function of (raw_output, plain) giving struct(answer, error). Those that still can't be read are queued for
    the plain call.
    """
    last = attempts.where(format_failure).groupBy("id").agg(F.max_by(F.struct("raw_output", "attempt_number"), "attempt_number").alias("a"))
    plain = attempts.where("answer_mode = 'plain'").select("id").distinct()
    rows = results.where("status = 'failed'").select("id").join(plain, "id", "left_anti").join(last, "id")
    read = rows.withColumn("r", extract(F.coalesce("a.raw_output", F.lit("")), F.lit(False)))
    return read.select("id", F.col("r.answer").isNotNull().alias("recovered"), F.col("r.answer").alias("prediction"), F.col("a.attempt_number").alias("attempt_number"), F.col("r.answer").isNull().alias("queued"))
