"""Streams over the driver's tables, stopped in their middle and started again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import resume, retries
from .files import folder
from .registry import query, table

#: The driver's languages.
LANGUAGES = ["de", "en", "es", "fr"]


def streamed(rows: DataFrame, name: str, parts: list[str], build) -> DataFrame:
    """What build makes of rows as a stream: each condition's rows are written and read to their end in a run of its own, with one checkpoint."""
    spark, root = rows.sparkSession, folder(rows.sparkSession, name)
    for condition in parts:
        rows.where(condition).write.mode("append").parquet(f"{root}/in")
        retries.run_to(build(resume.watch(spark, f"{root}/in", rows.schema, files=3)), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


_ATTEMPTS = """a as (select event_id, event_id % 2500 as q, row_number() over (partition by event_id % 2500 order by event_id)::int as no, event_type, epoch_us(ts) as us from events),
f as (select *, coalesce(bool_or(event_type = 'signup') over (partition by q order by no rows between unbounded preceding and 1 preceding), false) as plain from a),
e as (select *, event_type in ('purchase', 'view') or plain or (event_type <> 'signup' and no >= 3) as ends from f),
n as (select *, coalesce(min(no) filter (ends) over (partition by q), max(no) over (partition by q)) as last from e)"""


@query(f"""with {_ATTEMPTS} select q::varchar as id, no as attempt_number, case when event_type = 'purchase' then 'completed' when event_type = 'view' and event_id % 2 = 0 then 'refused' when ends then 'failed' end as outcome,
case when not ends then case event_type when 'signup' then 'plain' else 'json' end end as next_mode, case when not ends then case event_type when 'signup' then us else us + 5000000 end end as not_before from n where no = last""")
def retry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts: purchases answer, sign-ups can't be read, clicks and errors fail in transport, views for good or by refusal; three tries."""
    from pyspark.sql import Window

    kind, q = F.col("event_type"), F.col("event_id") % 2500
    at = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"))
    rows = table(spark, sf_dir, "events").select(
        q.cast("string").alias("id"), F.row_number().over(Window.partitionBy(q).orderBy("event_id")).alias("attempt_number"), F.when(kind == "purchase", "completed").otherwise("failed").alias("status"),
        F.when(kind == "view", F.when(F.col("event_id") % 2 == 0, 401).otherwise(400)).alias("http_status"), F.when(kind == "signup", "AnswerFormatError").when(kind != "purchase", "Error").alias("error_type"),
        kind.isin("click", "error").alias("retryable"), at.alias("finished_at"),
    )
    return retries.next_calls(streamed(rows, "retries", ["attempt_number <= 2", "attempt_number > 2"], lambda s: retries.decisions(s, tries=3, lateness="365 days")))


@query("select doc_id // 8 as case_id, 4 as parts from documents where lang in ('de', 'en', 'es', 'fr') group by 1 having count(distinct lang) = 4")
def ready_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of eight documents each, given out when all four languages have come, from files in three runs."""
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 8").alias("case_id"), F.col("lang").alias("language")).repartition(4)
    return streamed(rows, "ready", ["case_id % 3 = 1", "language in ('fr', 'de') and case_id % 3 <> 1", "language not in ('fr', 'de') and case_id % 3 <> 1"], lambda s: retries.complete_cases(s, LANGUAGES))
