"""Scores: documents stand for references, labels for predictions; (lang, source) is the configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, paired, scoring
from .registry import query, rounded, table

CELL = ["lang", "source"]
HITS = "hits as (select d.*, case when l.quality = 1 then 1 else 0 end as hit, l.doc_id is not null as done from documents d left join labels l on d.doc_id = l.doc_id)"
LENGTHS = "case when n_chars < 500 then 'short' when n_chars < 2000 then 'middle' else 'long' end"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id").withColumn("answer", F.lit("1"))
    preds = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("completed").alias("status"), F.col("quality").cast("string").alias("prediction"))
    return scoring.graded(refs, preds)


@query(f"with {HITS} select lang, source, round(100.0 * sum(hit) / count(*), 6) as acc, count(*) as n from hits group by all")
def cell_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cell_accuracy(hits(spark, sf_dir), CELL).withColumn("acc", rounded("acc"))


_STRICT = f"""
with {HITS}, cells as (select distinct lang, source from documents), part(cohort, low) as (values ('all', 0), ('longest', 6000)),
acc as (select cohort, lang, source, 100.0 * sum(hit) / count(*) as acc from hits, part where n_chars >= low group by all)
select p.cohort, c.lang, case when count(a.acc) = count(*) then round(avg(a.acc), 6) end as macro, count(a.acc) as covered, count(*) as expected
from part p cross join cells c left join acc a on a.cohort = p.cohort and a.lang = c.lang and a.source = c.source group by all"""


@query(_STRICT)
def strict_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir)
    expected = rows.select(*CELL).distinct()
    named = scoring.cohorts(rows, {"all": F.lit(True), "longest": F.col("n_chars") >= 6000})
    cells = scoring.cell_accuracy(named, CELL, ["cohort"])
    wanted = expected.withColumn("cohort", F.explode(F.array(F.lit("all"), F.lit("longest"))))
    found = scoring.strict_macro(cells, wanted, ["source"], ["cohort", "lang"])
    return found.select("cohort", "lang", rounded("avg").alias("macro"), "covered", "expected")


@query(f"with {HITS} select lang, count(*) as n, count(*) filter (where done) as completed, count(*) filter (where not done) as failed_or_missing, round(count(*) filter (where done) / count(*), 6) as coverage, round(100.0 * sum(hit) / count(*), 6) as micro_acc from hits group by lang")
def micro_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.coverage(hits(spark, sf_dir), ["lang"])
    return found.withColumns({"coverage": rounded("coverage"), "micro_acc": rounded("micro_acc")})


_COHORTS = f"""with {HITS}, named as (
select 'all' as cohort, * from hits union all select 'long', * from hits where n_chars >= 2000
union all select 'short', * from hits where n_chars < 2000 union all select 'labelled', * from hits where done)
select cohort, round(100.0 * sum(hit) / count(*), 6) as acc, count(*) as n from named group by cohort"""


@query(_COHORTS)
def cohort_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"all": F.lit(True), "long": F.col("n_chars") >= 2000, "short": F.col("n_chars") < 2000, "labelled": F.col("prediction_status") == "completed"}
    return scoring.cell_accuracy(scoring.cohorts(hits(spark, sf_dir), rules), ["cohort"]).withColumn("acc", rounded("acc"))


@query(f"""with {HITS}, parts as (select unnest([{{'field': 'lang', 'value': lang}}, {{'field': 'source', 'value': source}}, {{'field': 'length', 'value': {LENGTHS}}}]) as p, hit from hits)
select p.field as field, p.value as value, round(100.0 * sum(hit) / count(*), 6) as acc, count(*) as n from parts group by all""")
def accuracy_by_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir).withColumn("length", F.expr(LENGTHS))
    return scoring.by_fields(rows, ["lang", "source", "length"]).withColumn("acc", rounded("acc"))


@query(f"with {HITS}, g as (select lang, 100.0 * sum(hit) / count(*) as acc from hits group by lang) select round(avg(acc), 6) as macro, count(*) as groups from g")
def macro_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.macro_of(hits(spark, sf_dir), "lang").withColumn("macro", rounded("macro"))


@query(f"""with {HITS}, tagged as (select hit, unnest(list_filter([case when text ilike '%the%' then 'the' end, case when contains(text, chr(10)) then 'lines' end, case when n_chars > 1000 then 'long' end], lambda x: x is not null)) as value from hits)
select value, round(100.0 * sum(hit) / count(*), 6) as acc, count(*) as n from tagged group by value""")
def multi_label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.lower("text").contains("the"), "the"), F.when(F.col("text").contains("\n"), "lines"), F.when(F.col("n_chars") > 1000, "long")))
    return scoring.by_labels(hits(spark, sf_dir).withColumn("tags", tags), "tags").withColumn("acc", rounded("acc"))


_MEANS = f"with {HITS}, g as (select source, lang, avg(hit) as m from hits group by all)"


@query(_MEANS + """, p as (select source, max(case when lang = 'en' then m end) as en, max(case when lang = 'fr' then m end) as fr, max(case when lang = 'de' then m end) as de, max(case when lang = 'es' then m end) as es from g group by source)
select "pivot", round(avg(gap), 6) as gap, count(gap) as pairs from (select unnest([{'pivot': 'fr', 'gap': en - fr}, {'pivot': 'de', 'gap': en - de}, {'pivot': 'es', 'gap': en - es}], recursive := true) from p) group by "pivot" """)
def matched_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own-language (en) less each other language, matched by source."""
    means = hits(spark, sf_dir).groupBy("source", "lang").agg(F.avg("hit").alias("hit"))
    rows = means.select(F.col("source").alias("base_id"), F.lit("en").alias("image_language"), F.col("lang").alias("query_language"), "hit")
    return scoring.matched_gaps(rows, ("fr", "de", "es")).withColumn("gap", rounded("gap"))


_ONE = f"with {HITS}, one as (select source, lang, arg_min(hit, doc_id) as hit from hits group by all)"


@query(_ONE + """, g as (select source, max(hit) filter (where lang = 'en') as base, avg((hit = 1)::int) filter (where lang <> 'en') as r, avg((hit = 0)::int) filter (where lang <> 'en') as w from one group by source)
select source, round(100.0 * base, 6)::double as baseline_acc, round(100.0 * r, 6) as cross_acc, round(100.0 * (r - base), 6) as delta_pp, round(case when base = 1 then 100.0 * w else 0 end, 6) as correct_to_wrong_pct, round(case when base = 0 then 100.0 * r else 0 end, 6) as wrong_to_correct_pct from g""")
def paired_flip_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = hits(spark, sf_dir).groupBy(*CELL).agg(F.min_by("hit", "id").alias("hit"))
    found = paired.seed_metrics(one, ["source"], "lang", "en")
    return found.select("source", *(rounded(m).alias(m) for m in paired.METRICS))


@query(_ONE + """, g as (select source, max(hit) filter (where lang = 'en') as base, avg((hit = 1)::int) filter (where lang <> 'en') as r from one group by source),
grouped as (select unnest(list_filter(['all', case when source < 'src2' then 'low' else 'high' end], lambda x: x is not null)) as "group", 100.0 * base as b, 100.0 * r as c, 100.0 * (r - base) as d from g)
select "group", count(*) as n, round(avg(b), 6) as baseline_acc, round(avg(c), 6) as cross_acc, round(avg(d), 6) as delta_pp from grouped group by all""")
def subgroup_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = hits(spark, sf_dir).groupBy(*CELL).agg(F.min_by("hit", "id").alias("hit"))
    groups = F.array(F.lit("all"), F.when(F.col("source") < "src2", "low").otherwise("high"))
    found = paired.subgroups(paired.seed_metrics(one, ["source"], "lang", "en"), groups)
    return found.select("group", "n", *(rounded(m).alias(m) for m in paired.METRICS[:3]))


@query("""with u as (select user_id, count(distinct event_type) filter (where value > 10) as k from events group by user_id)
select g.k::int as k, round(100.0 * count(*) filter (where u.k >= g.k) / count(*), 6) as pct from u, range(1, 6) g(k) group by g.k""")
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max((F.coalesce(F.col("value") > 10, F.lit(False))).cast("int")).alias("hit"))
    return paired.coverage_curve(rows, ["user_id"], 5).withColumn("pct", rounded("pct"))


@query("""with k as (select user_id, bool_or(event_type = 'error') as failed, count(distinct event_type) as kinds from events group by user_id)
select user_id, not failed as failure_free, not failed and kinds <= 4 as clean from k""")
def sensitivity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = e.groupBy("user_id").agg((F.countDistinct("event_type") > 4).alias("many"))
    return paired.sensitivity(e.join(kinds, "user_id"), ["user_id"], F.col("event_type") == "error", "user_id", F.col("many"))


@query(f"""with {HITS} select lang, count(*) as n, round(100.0 * sum(hit) / count(*), 6) as before, round(100.0 * sum(case when n_chars > 800 then 1 else hit end) / count(*), 6) as after,
round(100.0 * sum(case when n_chars > 800 then 1 - hit else 0 end) / count(*), 6) as change, count(*) filter (where hit = 0 and n_chars > 800) as gained, 0::bigint as lost from hits group by lang""")
def outcome_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir)
    found = scoring.outcome_changes(rows, rows.withColumn("hit", F.when(F.col("n_chars") > 800, 1).otherwise(F.col("hit"))), ["lang"])
    return found.withColumns({c: rounded(c) for c in ("before", "after", "change")})


@query(f"""with {HITS} select verdict, method, count(*) as n from (select case when not done then 'different' when hit = 1 then 'equivalent' when n_chars % 3 = 0 then 'equivalent' else 'different' end as verdict,
case when not done then 'inference_failure' when hit = 1 then 'strict' when n_chars % 3 = 2 then 'judge_error' else 'judge' end as method from hits) group by all""")
def judged_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hits(spark, sf_dir)
    said = rows.where("n_chars % 3 <> 2").select("id", F.when(F.col("n_chars") % 3 == 0, "equivalent").otherwise("uncertain").alias("verdict"))
    return scoring.judged(rows, said).groupBy("verdict", "method").agg(F.count(F.lit(1)).alias("n"))


@query()
def bootstrap_cluster_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = hits(spark, sf_dir).groupBy("source").agg(F.sum("hit").alias("total"), F.count(F.lit(1)).alias("size"))
    return bootstrap.ratio_interval(clusters, ["source"])


@query()
def bootstrap_linear_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = hits(spark, sf_dir).groupBy(*CELL).agg(F.min_by("hit", "id").alias("hit"))
    return bootstrap.mean_intervals(paired.seed_metrics(one, ["source"], "lang", "en"), list(paired.METRICS), ["source"])


@query()
def bootstrap_hashed_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = hits(spark, sf_dir).groupBy("source").agg(F.sum("hit").alias("total"), F.count(F.lit(1)).alias("size"))
    return bootstrap.hashed_interval(clusters, "source")
