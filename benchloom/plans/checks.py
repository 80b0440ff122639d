"""Audits over builds made of the driver's tables, with faults put in that each audit must find, and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..functions import text
from ..operators import audit, curation, identity
from ..session import ship
from .registry import query, table
from .releases import VARIANTS, variants

#: Number of a case (src0 to src19): faults go by it.
N = "substr(case_id, 4)::int"


def number(column: str = "case_id") -> Column:
    return F.substring(column, F.lit(4), F.lit(9)).cast("int")


def counted(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A faultless fan-out with its questions and images."""
    case, asked = F.col("case_id"), F.col("query_language")
    question = F.concat(F.lit("Q "), case, F.lit(" "), asked)
    rows = variants(spark, sf_dir).withColumns({"base_id": case, "question": question, "answer": F.lit("5"), "source_question": F.concat(F.lit("Q "), case), "source_answer": F.lit("5")})
    return rows.withColumn("variant_id", identity.variant_id(F.col("base_id"), F.col("image_language"), asked))


def changed(rows: DataFrame, column: str, wrong: Column, value: object = "other") -> DataFrame:
    return rows.withColumn(column, F.when(wrong, value).otherwise(F.col(column)))


@query(f"""with {VARIANTS}, n as (select *, {N} as n from v) select * from (
select 'variant_identity_mismatch' as "check", count(*) as n from n where n.n in (1, 8) union all select 'variant_localized_qa_mismatch', count(*) from n where n.n = 2 and query_language = 'fr'
union all select 'variant_image_mismatch', count(*) from n where n.n = 3 and image_language = 'de' union all select 'variant_original_qa_mismatch', count(*) from n where n.n = 4
union all select 'variant_base_mismatch', count(*) from n where n.n in (5, 8) union all select 'variant_locale_missing', count(*) from n where n.n = 6 and query_language = 'es'
union all select 'variant_image_missing', count(*) from n where n.n = 7 and image_language = 'es' union all select 'duplicate_variant_ids', count(*) from n where n.n = 9)""")
def variant_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = build(spark, sf_dir)
    cases = whole.select("case_id", "base_id", F.col("source_question").alias("question"), F.col("source_answer").alias("answer")).distinct()
    localized = whole.select("case_id", "query_language", "question", "answer").distinct().where(~((number() == 6) & (F.col("query_language") == "es")))
    images = whole.select("case_id", "image_language", F.col("image_path").alias("path"), F.col("image_sha256").alias("sha256")).distinct().where(~((number() == 7) & (F.col("image_language") == "es")))
    rows = changed(whole, "answer_language", number() == 1)
    rows = changed(rows, "question", (number() == 2) & (F.col("query_language") == "fr"))
    rows = changed(rows, "image_sha256", (number() == 3) & (F.col("image_language") == "de"))
    rows = changed(rows, "source_answer", number() == 4)
    rows = changed(rows, "base_id", number() == 8)
    rows = rows.unionByName(rows.where(number() == 9))
    # A corrected case: its source answer is the corrected one.
    rows = changed(rows, "source_answer", number() == 10, "6")
    fixes = cases.where(number() == 10).select("case_id", F.lit("6").alias("corrected_answer"))
    cases = changed(cases, "base_id", number() == 5)
    return counted(audit.report(spark, audit.variant_alignment(rows, cases, localized, images, fixes, ("fr", "en"))))


@query("""with p as (select p_partkey % 100 as n, count(*) as c from part group by 1) select case n when 1 then 'raw_record_mismatch' when 2 then 'raw_qa_mismatch' when 3 then 'source_rows_missing' when 4 then 'source_locator_id_mismatch' when 5 then 'raw_image_mismatch' else 'duplicate_case_ids' end as "check", c as n
from p where n between 1 and 6""")
def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates against the records that they came from, read anew."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 100
    record = F.to_json(F.struct("p_partkey", "p_name", "p_type"))
    image = F.sha2("p_type", 256)
    records = p.where(k != 3).select(F.lit("part").alias("file"), F.col("p_partkey").alias("row_index"), F.col("p_name").alias("question"), F.col("p_type").alias("answer"), record.alias("record"), image.alias("image_sha256"))
    cid = identity.short_id(F.lit("part"), F.col("p_partkey"), F.lit("qa"))
    rows = p.select(F.when(k == 4, F.concat(F.lit("x"), cid)).otherwise(cid).alias("case_id"), F.lit("part").alias("file"), F.col("p_partkey").alias("row_index"), F.lit("qa").alias("slot"), F.col("p_name").alias("question"), F.when(k == 2, "other").otherwise(F.col("p_type")).alias("answer"), F.when(k == 1, "{}").otherwise(record).alias("record"), F.when(k == 5, "other").when(k != 7, image).alias("image_sha256"))
    rows = rows.unionByName(rows.where(F.col("row_index") % 100 == 6))
    return counted(audit.report(spark, audit.source_alignment(rows, records)))


@query("""with c as (select c_custkey as k from customer) select * from (select 'api_case_id_mismatch' as "check", count(*) as n from c where k % 10 = 1 union all select 'api_fingerprint_mismatch', count(*) from c where k % 10 = 2
union all select 'request_input_mismatch', count(*) from c where k % 10 = 3 union all select 'historical_api_request_unavailable', count(*) from c where k % 10 = 4)""")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cases say they were made by, against the requests kept; requests that are gone are warnings."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 10
    own, payload = F.sha2("c_name", 256), F.sha2(F.concat("c_name", F.lit("!")), 256)
    links = c.select(F.col("c_custkey").alias("case_id"), F.when(k != 5, own).alias("request_sha256"), payload.alias("payload_sha256"))
    requests = c.where(k != 4).select(own.alias("request_sha256"), F.when(k == 1, -1).otherwise(F.col("c_custkey")).alias("case_id"), F.when(k == 2, "other").otherwise(own).alias("sha256"), F.when(k == 3, "other").otherwise(payload).alias("payload_sha256"))
    return counted(audit.report(spark, [*audit.request_alignment(links, requests), audit.unavailable(links, requests)]))


@query("""select * from (values ('adjudication_source_mismatch', 'src1'), ('adjudication_source_mismatch', 'src2'), ('adjudication_output_mismatch', 'src3')) as t("check", key)""")
def correction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = build(spark, sf_dir).select("case_id", "answer").distinct().withColumns({"file": F.lit("f"), "row_index": number()})
    fixes = cases.where(number() < 6).select("case_id", F.when(number() == 1, "9").otherwise(F.col("answer")).alias("original_answer"), "file", F.when(number() == 2, -1).otherwise(F.col("row_index")).alias("row_index"), F.lit("6").alias("corrected_answer"))
    answers = cases.select("case_id", F.lit("6").alias("answer"), F.when(number() == 3, "5").otherwise("6").alias("answer_template"))
    return audit.report(spark, audit.correction_alignment(cases, answers, fixes)).select("check", "key")


@query("""select * from (values ('src1', '6', '5', '6', '5', 'fix1'), ('src2', '5', null, '5', null, null), ('src3', '6', '5', '6', '5', 'fix3')) as t(case_id, answer, upstream_source_answer, reference_answer, upstream_original_answer, fix)""")
def corrected_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction carried through cases, variants and references; one that names another record changes nothing."""
    whole = build(spark, sf_dir).where(number().between(1, 3))
    cases = whole.select("case_id", "answer").distinct().withColumns({"file": F.lit("f"), "row_index": number()})
    references = whole.select(F.col("variant_id").alias("id"), "case_id", "answer", F.col("answer").alias("original_answer"))
    fixes = cases.select("case_id", F.concat(F.lit("fix"), number()).alias("id"), "file", F.when(number() == 2, -1).otherwise(F.col("row_index")).alias("row_index"), F.col("answer").alias("original_answer"), F.lit("6").alias("corrected_answer"))
    done = curation.corrected_release(cases, whole.select("variant_id", "case_id", "answer", "source_answer"), references, fixes)
    r = done["references"].select("id", F.col("answer").alias("reference_answer"), "upstream_original_answer")
    rows = done["variants"].join(r, F.col("variant_id") == F.col("id")).join(done["cases"].select("case_id", F.col("answer").alias("case_answer")), "case_id").where("case_answer = answer")
    log = done["changes"].groupBy("case_id").agg(F.count(F.lit(1)).alias("changed"))
    rows = rows.join(log, "case_id", "left").where("coalesce(changed, 10) = 10").join(done["errors"].select("case_id", F.lit(True).alias("wrong")), "case_id", "left").where("coalesce(wrong, false) = (reference_correction_id is null)")
    return rows.select("case_id", "answer", "upstream_source_answer", "reference_answer", "upstream_original_answer", F.col("reference_correction_id").alias("fix")).distinct()


@query("""select * from (values ('translation_qa_output_mismatch', 'src1'), ('translation_labels_output_mismatch', 'src2'), ('english_locale_labels_mismatch', 'src3'), ('english_locale_source_mismatch', 'src4'), ('query_polish_output_mismatch', 'src5'),
('translation_qa_output_mismatch', 'src4')) as t("check", key)""")
def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locales against what translators said and started from; in src6 a question was polished after its translation."""
    whole = build(spark, sf_dir).select("case_id", F.col("query_language").alias("language"), "question", F.col("answer").alias("answer_template")).distinct().withColumn("labels", F.concat(F.lit('{"k":"'), "language", F.lit('"}')))
    lang = lambda x: F.col("language") == x
    outputs = changed(changed(whole, "answer_template", (number() == 1) & lang("de")), "labels", (number() == 2) & lang("es"))
    specs = changed(whole.where("language = 'en'").select("case_id", "labels"), "labels", number() == 3)
    answers = whole.where("language = 'en'").select("case_id", "question", "answer_template")
    polished = F.when((number() == 5) & lang("fr"), "polished").when((number() == 6) & lang("fr"), "smooth")
    locales = whole.withColumns({"question_original": F.when((number() == 6) & lang("fr"), F.col("question")), "polished": polished})
    locales = changed(changed(locales, "question", (number() == 6) & lang("fr"), "smooth"), "question", (number() == 4) & lang("en"))
    return audit.report(spark, audit.output_alignment(locales, outputs, specs, answers)).select("check", "key")


@query("""select * from (values ('render_data_changed', 'src1', null), ('exported_code_data_mismatch', 'src2', 'fr'), ('exported_code_labels_mismatch', 'src3', 'de'), ('exported_code_language_mismatch', 'src4', 'es'), ('exported_code_base_mismatch', 'src5', 'en'), ('renderer_missing', 'src6', 'fr')) as t("check", key, detail)""")
def drawing_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = build(spark, sf_dir).select("case_id", F.col("image_language").alias("language"), "base_id").distinct().withColumns({"labels": F.concat_ws("/", "case_id", "language"), "data": F.concat(F.lit("data "), "case_id")})
    specs = whole.select("case_id", "data", F.when(number() == 1, "x").otherwise(F.col("data")).alias("drawn_data")).distinct()
    drawn = changed(whole.withColumn("folder_language", F.col("language")), "data", number() == 1, "x")
    lang = lambda x: F.col("folder_language") == x
    drawn = changed(changed(drawn, "data", (number() == 2) & lang("fr")), "labels", (number() == 3) & lang("de"))
    drawn = changed(changed(drawn, "language", (number() == 4) & lang("es")), "base_id", (number() == 5) & lang("en")).where(~((number() == 6) & lang("fr")))
    return audit.report(spark, audit.drawing_alignment(drawn, specs, whole.select("case_id", "language", "labels"), whole.select("case_id", "base_id").distinct()))


def references(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("variant_id").alias("id"), "case_id", F.col("question").alias("query"), "answer", "image_language", "query_language", "image_path", "image_sha256")


@query("""select * from (values ('validation_qa_mismatch', 10), ('validation_image_mismatch', 10), ('validation_variant_set_mismatch', 10), ('evaluation_snapshot_mismatch', 10), ('evaluation_snapshot_unknown', 1), ('evaluation_request_mismatch', 10), ('evaluation_request_unknown', 1)) as t("check", n)""")
def evaluation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against variants, and a run's snapshot and requests against the references."""
    whole = build(spark, sf_dir)
    refs = changed(changed(references(whole), "answer", number() == 1), "image_sha256", number() == 2).where(number() != 3)
    snapshot = changed(refs, "query", number() == 4)
    stray = snapshot.limit(1).withColumn("id", F.lit("stray"))
    requests = changed(refs, "image_path", number() == 5).select("id", F.col("query").alias("question"), "image_path", "image_sha256")
    checks = audit.validation_alignment(refs, whole) + audit.run_alignment(snapshot.unionByName(stray), requests.unionByName(stray.select("id", F.col("query").alias("question"), "image_path", "image_sha256")), refs)
    return counted(audit.report(spark, checks))


@query(f"with {VARIANTS} select case_id, count(*) as variants from v where ({N} % 5 = 0) or ({N} % 7 = 1 and query_language = 'fr') group by 1")
def semantic_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = F.when(number() % 5 == 0, "fail").when((number() % 7 == 1) & (F.col("query_language") == "fr"), "uncertain").otherwise("pass")
    rows = build(spark, sf_dir).withColumn("audit", F.struct(F.lit("pass").alias("source_fidelity"), review.alias("answer_preservation"), F.lit(None).cast("string").alias("normal_qa")))
    return audit.semantic_flags(rows.withColumn("id", F.col("variant_id")))


@query("""select * from (values ('incomplete_affected_configuration_coverage', 'src1'), ('affected_answers_need_language_review', 'src2'), ('affected_non_numeric_answer_requires_translation_review', 'src3'), ('affected_non_numeric_answer_requires_translation_review', 'src5'), ('affected_case_unknown', 'unknown')) as t("check", key)
union all select 'affected_image_changed', 'variant_' || sha256('["src4", "es", "' || q || '", "' || q || '"]') from (values ('es'), ('fr'), ('en')) as l(q)""")
def context_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adding context to cases rests on: src6's answer is a number in another form, src7 isn't affected."""
    refs = references(build(spark, sf_dir)).where(~((number() == 1) & (F.col("image_language") == "de") & (F.col("query_language") == "fr")))
    refs = changed(changed(refs, "answer", (number() == 2) & (F.col("query_language") == "en"), "six"), "answer", number().isin(3, 7), "six")
    refs = changed(changed(refs, "answer", number() == 5, "inf"), "answer", number() == 6, "-2.5e3")
    affected = refs.where(number().between(1, 6)).select("case_id").distinct().unionByName(spark.createDataFrame([("unknown",)], "case_id string"))
    images = refs.select("image_path", F.when(F.col("image_path") == "src4/es", "x").otherwise(F.col("image_sha256")).alias("found_sha256")).distinct()
    return audit.dependencies(refs, affected, images, 4).select("check", "key")


@query("""select * from (values ('rows_changed', 'variant_' || sha256('["src1", "en", "en", "en"]'), 'missing from new'), ('field_changed', 'variant_' || sha256('["src2", "en", "en", "en"]'), 'answer'), ('field_changed', 'variant_' || sha256('["src3", "en", "en", "en"]'), 'query,image_sha256')) as t("check", key, detail)""")
def revision_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two releases that may differ in their context alone; src4 differs in it."""
    old = references(build(spark, sf_dir)).withColumn("source_context", F.lit("old"))
    one = (F.col("image_language") == "en") & (F.col("query_language") == "en")
    new = changed(old.where(~(one & (number() == 1))), "answer", one & (number() == 2))
    new = changed(changed(new, "query", one & (number() == 3)), "image_sha256", one & (number() == 3))
    new = changed(new, "source_context", number() == 4)
    return audit.revision(old, new, ("source_context",))


_ADMISSION = f"""with {VARIANTS}, r as (select *, {N} as n from v) select case_id, image_language, query_language, array_to_string(list_filter([
 case when n = 1 and query_language = 'fr' then 'not_bound' end, case when n = 2 and image_language = 'de' or n = 8 and image_language = 'es' then 'render_geometry_or_glyphs' end, case when n = 3 then 'source_review' end,
 case when n = 4 and (query_language = 'en' or image_language = 'en') or (n = 9 and (query_language = 'es' or image_language = 'es')) then 'language_review' end, case when n = 5 and (query_language = 'de' or image_language = 'de') then 'localization' end,
 case when n = 6 then 'needs_curation' end, case when n = 7 and query_language <> 'es' and image_language <> 'es' then 'not_accepted_before' end], lambda x: x is not null), ',') as reasons from r"""


@query(_ADMISSION)
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants, locales, layouts and two kinds of reviews joined; es is the new language, whose queries must also read fluently."""
    whole = build(spark, sf_dir)
    empty = F.array().cast("array<string>")
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(empty)
    lang = lambda x: F.col("language") == x
    texts = whole.select("case_id", F.col("query_language").alias("language"), "question", "answer").distinct()
    locales = texts.withColumns({"issues": some((number() == 5) & lang("de")), "review_flags": empty})
    images = whole.select("case_id", F.col("image_language").alias("language")).distinct()
    layouts = images.withColumns({"inside": ~((number() == 2) & lang("de")), "missing_glyphs": some((number() == 8) & lang("es"))})
    cases = whole.select("case_id").distinct()
    reviews = cases.withColumns({"source_fidelity": F.lit("pass"), "answer_preservation": F.lit("pass"), "normal_qa": F.when(number() != 3, "pass"), "critical_issues": empty})
    spoken = images.withColumns({"translation": F.lit("pass"), "answer_equivalence": F.when((number() == 4) & lang("en"), "fail").otherwise("pass"), "render_readability": F.lit("pass"), "query_fluency": F.when(number() != 9, "pass"), "issues": empty})
    rows = changed(whole, "question", (number() == 1) & (F.col("query_language") == "fr"))
    rows = rows.withColumns({"id": F.col("variant_id"), "answer_type": F.when(number() == 6, "list").otherwise("numeric"), "before": number() != 7})
    found = audit.admission(rows, locales, layouts, reviews, spoken, ("es",))
    return found.where(F.col("accepted") == (F.size("reasons") == 0)).select("case_id", "image_language", "query_language", F.array_join("reasons", ",").alias("reasons"))


@query("""select * from (values ('configurations', 'rows', '199, expected 200'), ('answer_language', 'src2', null), ('unbound', 'src3', 'label'), ('reply', 'src4', null), ('reply', 'src3', null)) as t("check", key, detail)
union all select 'unique_variants', 'src5', 'rows: 2'""")
def export_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = build(spark, sf_dir).withColumns({"instruction": F.lit("Answer in words."), "question_without_instruction": F.col("question"), "answer": F.lit("five")})
    whole = whole.withColumn("question", text.with_reply(F.col("question"), F.col("answer"), F.col("instruction")))
    one = (F.col("image_language") == "en") & (F.col("query_language") == "en")
    named = whole.withColumn("variant_id", F.when(one, F.col("case_id")).otherwise(F.col("variant_id")))
    rows = changed(changed(named, "answer_language", one & (number() == 2)), "question", one & (number() == 3), "a [[label]]")
    rows = changed(rows, "question", one & (number() == 4), F.col("question_without_instruction"))
    rows = rows.where(~((number() == 1) & (F.col("image_language") == "de"))).unionByName(rows.where(one & (number() == 5))).unionByName(rows.where((number() == 1) & (F.col("image_language") == "de")).limit(1))
    return audit.export(rows, 20, 4)


@query("""select * from (values ('data_changed', 'src1', 'fr'), ('labels_changed', 'src2', 'de'), ('data_constant', 'src1', 'data'), ('one_renderer', 'src3/en', 'rows: 2')) as t("check", key, detail)""")
def code_data_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = build(spark, sf_dir).select("base_id", F.col("image_language").alias("language"), F.col("case_id")).distinct().withColumns({"data": F.concat(F.lit('{"v":"'), "base_id", F.lit('"}')), "labels": F.lit('{"b":"x","a":"y"}')})
    lang = lambda x: F.col("language") == x
    rows = changed(changed(whole, "data", (number() == 1) & lang("fr"), "{}"), "labels", (number() == 2) & lang("de"), '{"a":"y"}')
    rows = rows.unionByName(rows.where((number() == 3) & lang("en")))
    specs = whole.select("base_id", "data", F.array(F.lit("a"), F.lit("b")).alias("label_keys")).distinct()
    return audit.code_data(rows.drop("case_id"), specs)


@query("""select * from (values ('current_fields', 'private', 'field not allowed'), ('missing_file', 'src1/en', null), ('unexpected_file', 'stray', null), ('view_accepted', 'src2', 'old'), ('view_needs_review', 'src2', 'new'), ('unique_ids', 'src3', 'rows: 2'), ('view_candidates', 'src3', 'old')) as t("check", key, detail)""")
def clean_release_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release of a row for each case; src2 lies in the wrong view, src3 twice in the release."""
    status = F.when(number() % 2 == 0, "accepted").otherwise("held")
    rows = build(spark, sf_dir).where("image_language = 'en' and query_language = 'en'").select(F.col("case_id").alias("id"), "case_id", "image_path", F.concat("image_path", F.lit(".py")).alias("code_path"), F.struct(status.alias("status")).alias("audit"), F.lit("x").alias("private"))
    accepted = rows.where("audit.status = 'accepted'")
    views = {"candidates": rows, "accepted": accepted.where("id <> 'src2'"), "needs_review": rows.where("audit.status <> 'accepted' or id = 'src2'")}
    twice = rows.unionByName(rows.where("id = 'src3'"))
    views["needs_review"] = views["needs_review"].unionByName(rows.where("id = 'src3'"))
    files = rows.select(F.explode(F.array("image_path", "code_path")).alias("path")).where("path <> 'src1/en'").unionByName(spark.createDataFrame([("stray",)], "path string"))
    return audit.clean_release(twice, views, files, ("id", "case_id", "image_path", "code_path", "audit"))


@query("""select case when p_size % 4 = 1 then 'span_class' when p_size % 4 = 2 then 'confidence' else 'panels' end as "check", p_partkey::varchar as key from part where p_size % 4 <> 0""")
def classification_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 4
    spans = F.struct(F.lit(True).alias("row_spans"), (kind == 1).alias("column_spans"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.lit("Row-Spanning Table").alias("visual_kind"), spans.alias("table_structure"), F.when(kind == 2, 1.5).otherwise(0.5).alias("confidence"), F.when(kind == 3, 2).otherwise(1).alias("panel_count"), F.lit("single").alias("layout"))
    return audit.classifications(rows).select("check", "key")


@query("""select case c_custkey % 6 when 1 then 'verdict' when 2 then 'reason' when 3 then 'language_compliance' else 'category' end as "check", c_custkey::varchar as key from customer where c_custkey % 6 between 1 and 4""")
def judgment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(k == 1, "maybe").otherwise("equivalent").alias("verdict"), F.when(k == 2, " ").otherwise("same").alias("reason"), F.when(k != 3, "pass").alias("language_compliance"), F.when(k != 4, "").alias("category"))
    return audit.judgments(rows).select("check", "key")


@query("""select case when c_custkey % 4 = 0 then 'strict' end as skipped, c_custkey as id, case c_custkey % 4 when 1 then 'equivalent' when 2 then 'different' end as verdict, c_custkey % 4 = 2 as was_uncertain, case when c_custkey % 4 = 3 then 'judge_error' else 'judge' end as method from customer where c_custkey % 4 <> 0 and c_custkey % 7 <> 0""")
def judge_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict matches aren't judged, nor what is judged already (every seventh); an answer that isn't a verdict is an error."""
    ship(spark)
    k = F.col("id") % 4
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("query"))
    rows = c.withColumns({"answer": F.lit("five"), "prediction": F.when(k == 0, "five").otherwise(k.cast("string")), "prediction_status": F.lit("completed"), "hit": (k == 0).cast("int")})

    def provider(request: str, max_tokens: int) -> str:
        import json

        said = json.loads(request)["prediction"]
        return json.dumps({"verdict": {"1": "equivalent", "2": "uncertain"}.get(said, "perhaps"), "category": "x", "reason": f"under {max_tokens}", "language_compliance": "pass"})

    done = c.where("id % 7 = 0").select("id")
    found = providers.judge(rows, done, provider, providers.Policy(tries=2, delay=0.0, interval=0.0, workers=4, max_tokens=900))
    return found.select(F.lit(None).cast("string").alias("skipped"), "id", "verdict", "was_uncertain", "method")


@query("""select * from (values ('unique_ids', '3'), ('not_in_release', '3'), ('not_in_release', '5')) as t("check", key)""")
def subset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packaged half of the nations: 3 is in it twice, 5 was changed."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    chosen = changed(rows.where("id % 2 = 1"), "n_name", F.col("id") == 5)
    return audit.subset(rows, chosen.unionByName(chosen.where("id = 3"))).select("check", "key")


@query("""select * from (values ('images_of_question', 'src1/en', '3, expected 4'), ('question_constant', 'src2/zh', 'query'), ('delta_identity', 'src3', null), ('subgroups_equal_whole', 'src4', null)) as t("check", key, detail)""")
def paired_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paired analyses rest on: fr stands for zh."""
    rows = build(spark, sf_dir).withColumn("query", F.col("question"))
    rows = rows.withColumn("query_language", F.when(F.col("query_language") == "fr", "zh").otherwise(F.col("query_language")))
    rows = rows.where(~((number() == 1) & (F.col("query_language") == "en") & (F.col("image_language") == "de")))
    rows = changed(rows, "query", (number() == 2) & (F.col("query_language") == "zh") & (F.col("image_language") == "es"))
    cases = rows.select("case_id").distinct()
    metrics = cases.select("case_id", F.lit(3.0).alias("wrong_to_correct_pct"), F.lit(1.0).alias("correct_to_wrong_pct"), F.when(number() == 3, 4.0).otherwise(2.0).alias("delta_pp"))
    part = F.explode(F.array(*(F.struct(F.lit(p).cast("string").alias("part"), F.lit(m).alias("mean"), F.lit(n).alias("n")) for p, m, n in ((None, 2.5, 4), ("chart", 2.0, 3), ("table", 4.0, 1)))))
    groups = cases.select("case_id", part.alias("p")).select("case_id", "p.part", F.when((number() == 4) & (F.col("p.part") == "table"), 5.0).otherwise(F.col("p.mean")).alias("mean"), "p.n")
    weighted = audit.weighted_means(groups, "part", by=["case_id"]).withColumn("detail", F.lit(None).cast("string"))
    return audit.paired(rows, 4).unionByName(audit.paired_metrics(metrics, "case_id")).unionByName(weighted)


@query(f"""with {VARIANTS}, n as (select distinct {N} as n, case_id from v) select * from (
select 'context_constant' as "check", case_id || '/en' as key, 'source_context' as detail from n where n % 5 = 1 union all select 'prompt_constant', case_id || '/zh', 'prompt_sha256' from n where n % 5 = 2
union all select 'settings_constant', case_id || '/en', 'max_output_tokens,schema' from n where n % 5 = 3 union all select 'reference_constant', case_id || '/zh', 'reference_effective' from n where n % 5 = 4
union all select 'leaderboard_agrees', case_id, 'accuracy' from n where n % 5 = 1 union all select 'leaderboard_agrees', case_id, 'not published' from n where n % 5 = 2 union all select 'leaderboard_agrees', case_id, 'not found' from n where n % 5 = 3)""")
def paired_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts, prompts, settings and references that differ within a question, and scores that aren't the leaderboard's; nulls inside a context don't count."""
    fifth, one = number() % 5, F.col("image_language") == "de"
    rows = build(spark, sf_dir).withColumn("query", F.col("question")).withColumn("query_language", F.when(F.col("query_language") == "fr", "zh").otherwise(F.col("query_language")))
    wrong = lambda k, asked: (fifth == k) & one & (F.col("query_language") == asked)
    paragraph = F.struct(F.when(wrong(1, "en"), "other").otherwise("text").alias("text"), F.lit(None).cast("string").alias("note"))
    rows = rows.withColumn("source_context", F.when(number() % 2 == 0, F.struct(F.array(paragraph).alias("paragraphs"))).otherwise(F.struct(F.array(paragraph).alias("paragraphs"))))
    rows = rows.withColumns({
        "prompt_sha256": F.when(wrong(2, "zh"), "b").otherwise("a"), "max_output_tokens": F.when(wrong(3, "en"), 9).otherwise(8), "schema": F.when(~wrong(3, "en"), F.struct(F.lit("object").alias("type"))),
        "reference_effective": F.when(~wrong(4, "zh"), "5"), "generationConfig": F.lit(None).cast("struct<temperature:double>"),
    })
    scores = rows.groupBy("case_id").agg((F.count(F.lit(1)) / 7.0).alias("accuracy"), F.lit(None).cast("double").alias("gap"))
    board = scores.where(fifth != 2).withColumn("accuracy", F.col("accuracy") + F.when(fifth == 1, 1e-6).otherwise(1e-12))
    return audit.paired(rows, 4).unionByName(audit.paired_scores(scores.where(fifth != 3), board, ["case_id"], ["accuracy", "gap"]))


@query("""select * from (values ('unique_references', '1'), ('unique_predictions', '2'), ('complete', '3'), ('complete', '-1'), ('terminal', '4'), ('run_key', '5')) as t("check", key)""")
def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    preds = refs.where("id <> 3").withColumns({"status": F.when(F.col("id") == 4, "started").otherwise("completed"), "run_key": F.when(F.col("id") == 5, "old").otherwise("k")})
    preds = preds.unionByName(preds.where("id = 2")).unionByName(preds.where("id = 0").withColumn("id", F.lit(-1).cast("long")))
    return audit.run(refs.unionByName(refs.where("id = 1")), preds, "k").select("check", "key")


@query("select p_partkey as id, p_type as anchor, 'repo' || p_size % 3 as repo, p_partkey as row_index from part where p_size % 3 < 2")
def identified_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their identities and with the evidence of the files that they came from."""
    p = table(spark, sf_dir, "part")
    pool = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), F.col("p_size") % 3).alias("file"), F.col("p_partkey").alias("row_index"), F.lit("qa").alias("slot"))
    manifest = spark.createDataFrame([(f"f{i}", f"repo{i}", "r", "s") for i in (0, 1)], "file string, repo string, revision string, sha256 string")
    rows = identity.with_evidence(identity.with_identity(pool, p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("anchor"))), manifest)
    return rows.select("id", "anchor", "provenance.repo", F.col("provenance.row_index").alias("row_index"))
