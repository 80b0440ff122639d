"""Attempts and usage: events stand for attempts (user is the key, rows are numbered in time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import incremental, usage, windows
from .registry import query, rounded, table

NUMBERED = "a as (select *, row_number() over (partition by user_id order by ts, event_id) as no, try_cast(json_extract_string(props, '$.k') as bigint) as k from events)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumns({"no": F.row_number().over(at), "k": F.get_json_object("props", "$.k").cast("long")})


@query(f"with {NUMBERED} select event_type, sum(case when k > 50 then k end)::bigint as tokens, count(case when k > 50 then k end) as tokens_reported_attempts, coalesce(sum(k), 0)::bigint as plain from a group by event_type")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir).withColumn("reported", F.when(F.col("k") > 50, F.col("k")))
    return rows.groupBy("event_type").agg(*usage.token_totals({"tokens": "reported"}), F.coalesce(F.sum("k"), F.lit(0)).alias("plain"))


_RETRIES = f"""with {NUMBERED}, p as (select a.*, lag(event_type) over (partition by user_id order by no) as prev from a)
select user_id, count(*) as attempts, count(*) filter (where no > 1) as retries, count(*) filter (where prev = 'error') as transport_retries from p group by user_id"""


@query(_RETRIES)
def retry_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.with_lagged(attempts(spark, sf_dir), ["event_type"], "user_id", "no")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("has_previous").alias("retries"), F.count_if(F.col("previous_event_type") == "error").alias("transport_retries"))


@query(_RETRIES)
def retry_accounting_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a null-safe join, for attempt numbers with gaps."""
    rows = usage.with_previous(attempts(spark, sf_dir), ["event_type"], "user_id", "no")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("has_previous").alias("retries"), F.count_if(F.col("previous_event_type") == "error").alias("transport_retries"))


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.earliest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("select event_type, event_id, value from events qualify row_number() over (partition by event_type order by ts, event_id) <= 2")
def first_two_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value", "ts")
    return windows.first_n(e, ["event_type"], ["ts", "event_id"], 2).drop("ts")


@query("select 'event_type' as field, event_type as value, count(*) as n from events group by event_type union all select 'day', strftime(ts, '%Y-%m-%d'), count(*) from events group by all")
def state_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.state_counters(table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["event_type", "day"])


@query("""with w as (select event_id, list_sort(list(value) over (partition by user_id order by ts, event_id rows between 1 preceding and 1 following)) as near from events)
select event_id, round(near[len(near) // 2 + 1], 6) as median from w""")
def sliding_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding_median(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", rounded("median").alias("median"))


@query("select event_type, round(median(value), 6) as median from events group by event_type")
def group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.group_median(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("median", rounded("median"))


@query("select event_id, lpad((row_number() over (partition by user_id order by ts, event_id) - 1)::varchar, 3, '0') as number from events")
def numbered_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.numbered(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("event_id", "number")


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("""with m as (select user_id, bool_or(event_type = 'click' and value > 60) as plain, bool_or(event_type = 'error') as unread, count(*) as n from events group by user_id)
select user_id as id, n as attempts, case when plain then null when unread then 'plain' when n < 11 then 'json' end as next_mode from m""")
def next_answer_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.when((F.col("event_type") == "click") & (F.col("value") > 60), "plain").alias("answer_mode"), "event_type")
    return usage.answer_modes(rows, F.col("event_type") == "error")


@query("""with old as (select event_id as id, event_type, value from events where event_type <> 'view'), new as (select event_id as id, event_type, case when value > 20 then value + 1 else value end as value from events)
select case when o.id is null then 'run' when not (o.event_type is not distinct from n.event_type and o.value is not distinct from n.value) then 'rerun' when n.event_type = 'click' then 'reuse' else 'run' end as action, count(*) as n from new n left join old o on n.id = o.id group by 1""")
def rerun_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    new = e.withColumn("value", F.when(F.col("value") > 20, F.col("value") + 1).otherwise(F.col("value")))
    results = e.where("event_type = 'click'").select("id", F.lit("completed").alias("status"))
    return incremental.plan(e.where("event_type <> 'view'"), new, results, ("event_type", "value")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {NUMBERED}, f as (select user_id, min(no) as no from a where event_type in ('purchase', 'error') group by user_id)
select a.user_id as id, case when a.event_type = 'error' then 'failed' else 'completed' end as status, a.no::int as attempt_number from a join f on a.user_id = f.user_id and a.no = f.no""")
def resume_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log replayed as a stream in two runs; the second one finds the first one's results and adds only new keys."""
    import uuid

    from ..storage import shared_dir
    from ..streaming import resume

    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("started")
    log = attempts(spark, sf_dir).select(F.col("user_id").alias("id"), status.alias("status"), F.col("no").cast("int").alias("attempt_number"))
    base = f"{shared_dir(spark)}/benchloom/resume-{uuid.uuid4().hex}"
    for half in ("attempt_number <= 20", "attempt_number > 20"):
        log.where(half).write.mode("append").parquet(f"{base}/log")
        resume.append_new(resume.watch(spark, f"{base}/log", log.schema), f"{base}/results", f"{base}/state")
    return spark.read.parquet(f"{base}/results").select("id", "status", "attempt_number")
