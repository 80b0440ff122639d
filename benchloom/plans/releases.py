"""Curation and release operators: (source, language) stands for a case's configuration, tables' texts for labels and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import audit, curation, fanout, identity, incremental, predicates, scoring, sets, usage, windows
from ..session import ship
from ..sources import sinks
from .registry import query, table

FAMILY = "case when source < 'src5' then 'chart' else 'table' end"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"with r as (select *, {FAMILY} as f from documents) select min(doc_id) as id, f as visual_family from r where (f = 'chart' and lang = 'en') or (f = 'table' and lang = 'fr') group by f")
def smoke_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.when(F.col("lang") == "fr", "zh").otherwise(F.col("lang"))
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.expr(FAMILY).alias("visual_family"), language.alias("image_language"), language.alias("query_language"))
    return predicates.smoke_rows(rows, "id").select("id", "visual_family")


@query("select p_partkey as case_id, p_brand as answer_type, p_size as row_index from part where p_brand in ('Brand#1', 'Brand#2', 'Brand#3')")
def answer_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_brand").alias("answer_type"), F.col("p_size").alias("row_index"))
    return predicates.answer_outliers(rows, ("Brand#1", "Brand#2", "Brand#3"))


@query("""with p as (select doc_id, source, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents where trim(text) <> '')
select doc_id as case_id, 'document_' || case when length(i::varchar) < 3 then lpad(i::varchar, 3, '0') else i::varchar end as id, text, 'Paragraph' as source_field, i::int as source_index from p where source in ('src0', 'src1', 'src2')""")
def allowed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("source").isin("src0", "src1", "src2"), "ChartQAPro").otherwise(F.col("source"))
    none = F.lit(None).cast("array<string>")
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("case_id"), shown.alias("source"), F.lit(None).cast("string").alias("dataset"), F.col("text").alias("paragraph"), none.alias("pre_text"), none.alias("post_text"))
    return predicates.allowed_context(rows)


@query("select doc_id, case lang when 'en' then 'en/' || source || '/long' when 'fr' then 'fr/' || n_chars when 'de' then 'de/' || source end as stratum from documents")
def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = curation.stratum({"en": [F.col("source"), F.lit("long")], "fr": [F.col("n_chars")], "de": [F.col("source")]}, "lang")
    return documents(spark, sf_dir).select("doc_id", rule.alias("stratum"))


@query("""with t as (select p_partkey, case when p_size > 40 then 'multi_step' when p_size > 20 then 'counting' else 'other' end as tag from part) select case tag when 'multi_step' then 'hard' when 'counting' then 'medium' else 'easy' end as difficulty, count(*) as n from t group by 1""")
def difficulties(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("p_size") > 40, "multi_step").when(F.col("p_size") > 20, "counting").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(curation.difficulty(F.array(tag)).alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, case when lang = 'en' then source else source || chr(10) || 'reply' end as question from documents")
def reply_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("lang") == "en", F.col("n_chars").cast("string")).otherwise("text")
    asked = F.concat("source", F.lit("\nreply"))
    return documents(spark, sf_dir).select("doc_id", text.without_reply(asked, answer, F.lit("reply")).alias("question"))


@query("select n_nationkey, 'panel_07_name=' || n_name || ',panel_07_region=' || n_regionkey as labels from nation")
def panel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fanout.namespaced(F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")), 7)
    spelt = F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return table(spark, sf_dir, "nation").select("n_nationkey", spelt.alias("labels"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    rows = fanout.variants(d.select(F.col("source").alias("case_id")).distinct(), d.select(F.col("lang").alias("language")).distinct(), "case_id", ("fr", "en"))
    return rows.withColumns({"image_path": F.concat_ws("/", "case_id", "image_language"), "image_sha256": F.sha2(F.concat_ws("/", "case_id", "image_language"), 256)})


VARIANTS = "v as (select s.source as case_id, l.lang as image_language, unnest(list_distinct([l.lang, 'fr', 'en'])) as query_language from (select distinct source from documents) s, (select distinct lang from documents) l)"


@query(f"with {VARIANTS}, k as (select source as case_id, lang as query_language, count(*) as texts from documents group by all) select v.case_id, image_language, v.query_language, texts from v join k using (case_id, query_language)")
def locales_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    locales = documents(spark, sf_dir).groupBy(F.col("source").alias("case_id"), F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("texts"))
    return fanout.with_locales(variants(spark, sf_dir), locales).select("case_id", "image_language", "query_language", "texts")


@query(f"with {VARIANTS} select case_id, image_language, case_id || '/' || image_language as image_path, count(*) as variants, true as consistent from v group by all")
def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fanout.image_manifest(variants(spark, sf_dir)).drop("image_sha256")


@query(f"with {VARIANTS} select case_id, image_language, query_language from v where image_language = 'en' and query_language = 'en'")
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.representatives(variants(spark, sf_dir)).select("case_id", "image_language", "query_language")


@query("""select 'configurations_of_case' as "check", 'src3' as key, '9, expected 10' as detail
union all select 'configurations_of_case', 'src5', '11, expected 10' union all select 'unique_ids', 'variant_' || sha256('["src5", "en", "fr", "fr"]'), 'rows: 2' union all select 'unique_configurations', 'src5/en/fr', 'rows: 2'
union all select 'one_hash_for_image', 'src7/de', 'image_sha256' union all select 'files', 'src7/es', 'missing' union all select 'files', '../src9/en', 'missing' union all select 'files', '../src9/en', 'outside the root'""")
def release_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fan-out with one variant lost, one twice, one image of two hashes, one file lost and one path that leaves the root."""
    whole = variants(spark, sf_dir).withColumn("id", F.col("variant_id"))
    cell = lambda c, i, q: (F.col("case_id") == c) & (F.col("image_language") == i) & (F.col("query_language") == q)
    rows = whole.where(~cell("src3", "es", "en")).unionByName(whole.where(cell("src5", "en", "fr")))
    rows = rows.withColumn("image_sha256", F.when(cell("src7", "de", "en"), "other").otherwise(F.col("image_sha256")))
    rows = rows.withColumn("image_path", F.when((F.col("case_id") == "src9") & (F.col("image_language") == "en"), F.concat(F.lit("../"), "image_path")).otherwise(F.col("image_path")))
    files = whole.select(F.col("image_path").alias("path")).distinct().where("path <> 'src7/es'")
    return audit.release(rows, files, 20, 4)


@query("select 'none' as state, 0 as violations")
def release_audit_of_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole fan-out has no violations."""
    rows = variants(spark, sf_dir).withColumn("id", F.col("variant_id"))
    n = rows.select("image_language").distinct().count()
    found = audit.release(rows, rows.select(F.col("image_path").alias("path")).distinct(), rows.select("case_id").distinct().count(), n)
    return found.agg(F.lit("none").alias("state"), F.count(F.lit(1)).alias("violations"))


@query(f"with {VARIANTS}, k as (select case_id, image_language, count(*) as n from v where query_language <> 'fr' or image_language <> 'de' group by all) select case_id, sum(n)::bigint as n from k group by case_id having sum(n) <> 10")
def incomplete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants(spark, sf_dir).where("query_language <> 'fr' or image_language <> 'de'")
    found = audit.group_sizes("complete", rows, ["case_id"], 10)
    return found.select(F.col("key").alias("case_id"), F.regexp_extract("detail", "^([0-9]+)", 1).cast("long").alias("n"))


@query("select s_suppkey from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey = 1)")
def unused_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("groups", F.array(F.concat(F.lit("n"), "s_nationkey")))
    used = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("group"))
    return curation.unused_groups(rows, used, key="s_suppkey").select("s_suppkey")


@query("select n_name, case when n_regionkey in (0, 1) then 'current/' || n_name else 'archive/' || n_name end as path, n_regionkey not in (0, 1) as archived from nation")
def archived_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_name", "n_regionkey", F.sha2("n_name", 256).alias("sha256"))
    current = n.where("n_regionkey in (0, 1)").select("sha256", F.concat(F.lit("current/"), "n_name").alias("path"))
    archive = n.select("sha256", F.concat(F.lit("archive/"), "n_name").alias("path"))
    return identity.archived_content(n, current, archive).select("n_name", "path", "archived")


@query("select n_nationkey::varchar as id, n_name, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey in (3, 1, 7)")
def listed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey).select("id", "r_name")
    return curation.in_list_order(["7", "3", "1"], n.select("id", "n_name"), named)


@query(f"with {VARIANTS} select case_id, image_language, query_language, (case when query_language = 'en' then 'polished ' || case_id else 'old' end) || chr(10) || 'reply' as question from v")
def polished_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variants(spark, sf_dir).withColumns({"question_without_instruction": F.lit("old"), "answer": F.lit("text"), "instruction": F.lit("reply")})
    queries = documents(spark, sf_dir).select(F.col("source").alias("case_id"), F.lit("en").alias("language"), F.concat(F.lit("polished "), "source").alias("query")).distinct()
    return curation.polished(rows, queries).select("case_id", "image_language", "query_language", "question")


@query("select p_partkey as case_id, case when p_size > 30 then 'Row-Spanning Table' else p_type end as visual_kind, p_type as visual_family from part")
def reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("case_id"), F.col("p_type").alias("visual_kind"), F.lit(None).cast("string").alias("visual_family"))
    return curation.reclassified(rows, p.where("p_size > 30").select(F.col("p_partkey").alias("case_id"), F.lit("Row-Spanning Table").alias("visual_kind")))


@query("select s_suppkey as case_id, s_name as before, upper(s_name) || '!' as after from supplier where s_acctbal < 0")
def correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_name").alias("answer"), "s_acctbal")
    fixes = rows.select("case_id", F.when(F.col("s_acctbal") < 0, F.concat(F.upper("answer"), F.lit("!"))).otherwise(F.col("answer")).alias("corrected_answer"))
    return curation.corrected(rows, fixes)[1]


@query("select lang as language, count(*) filter (where n_chars < 1000) as short, count(*) filter (where n_chars >= 1000) as long from documents group by lang")
def language_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("lang").alias("language"), F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("status"))
    return curation.language_summary(rows, ["short", "long"])


@query("with c as (select source, count(*) as cases, count(*) filter (where lang = 'en') as with_context from documents group by source) select source, cases, with_context, with_context * 70 as configurations from c")
def context_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "source", "lang")
    return audit.context_inventory(rows, rows.where("lang = 'en'").select("case_id"))


@query("select bool_and(n_chars < 1000000) as all_inside, (select bool_and(k = 1) from (select count(distinct lang) as k from documents group by source)) as data_constant, (select array_to_string(list_sort(list(distinct lang)), ',') from documents) as glyphs from documents")
def release_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(F.col("source").alias("case_id"), F.col("lang").alias("data_sha256"), (F.col("n_chars") < 1000000).alias("text_inside_canvas"), F.array("lang").alias("missing_glyphs"))
    return curation.release_facts(rows).select("all_inside", "data_constant", F.array_join("missing_glyphs", ",").alias("glyphs"))


@query("select count(*) filter (where event_type = 'error' and value > 10) as recovered, count(*) filter (where event_type = 'error' and not coalesce(value > 10, false)) as still_failed, count(*) filter (where event_type <> 'error') as preserved from events")
def repair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), status.alias("status"), "value")
    after = e.withColumn("status", F.when(F.col("value") > 10, "completed").otherwise(F.col("status")))
    return incremental.repair_summary(e, after)


@query("select n_nationkey from nation where n_regionkey = 0 and n_nationkey <> (select min(n_nationkey) from nation where n_regionkey = 0) union select min(n_nationkey) from nation where n_regionkey = 2")
def replaced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    first = lambda r: n.where(F.col("n_regionkey") == r).agg(F.min("n_nationkey").alias("n_nationkey"))
    selected = n.where("n_regionkey = 0").select("n_nationkey")
    return sets.replaced_selection(selected, first(0), first(2), selected.count(), "n_nationkey")


@query("select o_orderkey as id from orders where o_totalprice > 100000 and o_orderpriority is not null")
def stale_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions whose recorded inputs differ from the current ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("query"), "o_totalprice")
    current = o.withColumn("query", F.when(F.col("o_totalprice") > 100000, F.concat("query", F.lit("?"))).otherwise(F.col("query")))
    return audit.resume(o.select("id", "query"), current, ["query"]).select(F.col("key").cast("long").alias("id"))


@query("select 'candidates' as view, count(*) as n from documents union all select 'accepted', count(*) from documents d join labels l using (doc_id) where quality = 1 union all select 'needs_review', count(*) from documents d left join labels l using (doc_id) where quality is distinct from 1")
def split_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    views = sinks.split_views(rows, "quality <=> 1")
    return sets.unions([v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("view"), "n") for name, v in views.items()])


@query("select event_type, coalesce(sum(json_extract_string(props, '$.k')::bigint), 0)::bigint as tokens from events group by event_type")
def plain_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return usage.plain_totals(e, {"tokens": "k"}, ["event_type"])


@query("""with c as (select n_regionkey as t, n_name as x, n_nationkey as o from nation), f as (select x, min(o) as first from c group by x) select o as place, 'label_' || lpad((row_number() over (order by first, c.x) - 1)::varchar, 3, '0') as label_key from c join f on c.x = f.x""")
def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "nation").select(F.col("n_name").alias("text"), F.col("n_nationkey").alias("place"))
    return parsing.label_keys(cells, "text", "place").select("place", "label_key")


@query("select event_id, case when event_type = 'error' then 'judge_error' when value < 5 then 'inference_failure' end as kind from events")
def failure_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("event_type") == "error", "judge_error").otherwise("judge")
    status = F.when(F.coalesce(F.col("value") < 5, F.lit(False)), "failed").otherwise("completed")
    return table(spark, sf_dir, "events").select("event_id", scoring.failure_kind(method, status).alias("kind"))


@query("select o_custkey, count(*) as orders, any_value(o_orderkey order by o_orderdate desc, o_orderkey desc) as last_order from orders group by o_custkey")
def last_per_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    last = windows.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders")).join(last, "o_custkey")


@query("select doc_id, source || '?' as new, case when lang = 'en' then 'number_changed' else '' end as issues from documents")
def edit_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy edits that add a question mark; in English one number too many."""
    ship(spark)
    old = F.concat(F.lit("what is the value for the row named "), "source")
    new = F.concat(old, F.when(F.col("lang") == "en", " 7?").otherwise("?"))
    return documents(spark, sf_dir).select("doc_id", F.concat("source", F.lit("?")).alias("new"), F.array_join(curation.edit_issues(old, new), ",").alias("issues"))


@query("""select n_nationkey, 'pair_' || sha256('["' || n_name || '", "en", "fr"]') as pair_id, 'qa_' || sha256('["S",{"key":' || n_nationkey || '},"' || n_name || '","qa"]') as base_id from nation""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    pair = curation.keyed_digest("pair_", F.col("n_name"), F.lit("en"), F.lit("fr"))
    base = curation.base_id(F.lit("S"), F.to_json(F.struct(F.col("n_nationkey").alias("key"))), F.col("n_name"), F.lit("qa"))
    return table(spark, sf_dir, "nation").select("n_nationkey", pair.alias("pair_id"), base.alias("base_id"))
