"""Texts, numbers, identities, pages and grids."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing, text, udfs
from ..operators import clusters, fanout, identity, predicates
from ..session import ship
from .registry import query, rounded, table

# Task patterns that the driver's part names can meet.
PART_TASKS = (("metal", "brass|copper|steel|tin|nickel"), ("size", "small|medium|large|jumbo"), ("finish", "polished|burnished|plated|brushed|anodized"))


@query("""with t as (select p_partkey, lower(p_name || ' ' || p_type) as t from part)
select p_partkey, list_filter([case when regexp_matches(t, 'brass|copper|steel|tin|nickel') then 'metal' end, case when regexp_matches(t, 'small|medium|large|jumbo') then 'size' end, case when regexp_matches(t, 'polished|burnished|plated|brushed|anodized') then 'finish' end], lambda x: x is not null)::varchar as tags from t""")
def task_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = text.all_matches(F.concat_ws(" ", "p_name", "p_type"), PART_TASKS)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]")).alias("tags"))


@query("""with t as (select lower(p_name || ' ' || p_type) as t from part)
select case when regexp_matches(t, 'brass|copper|steel|tin|nickel') then 'metal' when regexp_matches(t, 'small|medium|large|jumbo') then 'size' when regexp_matches(t, 'polished|burnished|plated|brushed|anodized') then 'finish' else 'lookup_or_other' end as task, count(*) as n from t group by task""")
def task_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = text.first_match(F.concat_ws(" ", "p_name", "p_type"), PART_TASKS)
    return table(spark, sf_dir, "part").groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n"))


_ANSWERS = "answers as (select l_quantity::varchar as a from lineitem union all select p_name from part union all select text from documents)"


@query(f"""with {_ANSWERS} select case when regexp_full_match(a, '[\\s$€£¥+−\\-0-9.,%eE]+') then 'numeric' when len(list_filter(regexp_split_to_array(a, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')) > 30 then 'long_answer_needs_canonicalization' else 'short_text_or_expression' end as hint, count(*) as n from {{}} group by hint""".replace("{}", "answers"))
def answer_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("string").alias("a")).unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("a"))).unionByName(table(spark, sf_dir, "documents").select(F.col("text").alias("a")))
    return rows.groupBy(text.answer_hint(F.array("a")).alias("hint")).agg(F.count(F.lit(1)).alias("n"))


@query("""select conv_id from conversations group by conv_id having count(*) filter (where role = 'user') = 1
and not bool_or(role = 'user' and regexp_matches(text, '(?i)^\\s*(is|are|was|were|do|does|did|has|have|had|can|could|would|will|should)\\b'))""")
def normal_qa_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    own = F.col("role") == "user"
    grouped = c.groupBy("conv_id").agg(F.count_if(own).alias("turns"), F.bool_or(own & F.col("text").rlike(text.CLOSED_QUESTION)).alias("closed"))
    return grouped.where("turns = 1 and not closed").select("conv_id")


@query("select case when n_chars < 500 then '<500' when n_chars < 2000 then '500-1999' when n_chars < 5000 then '2000-4999' else '5000+' end as bin, count(*) as n from documents group by bin")
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bin_ = text.binned(F.col("n_chars"), [(500, "<500"), (2000, "500-1999"), (5000, "2000-4999")], "5000+")
    return table(spark, sf_dir, "documents").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, (p_size + 0.50)::decimal(10,2)::varchar as spelt, regexp_replace(regexp_replace((p_size + 0.50)::decimal(10,2)::varchar, '0+$', ''), '\\.$', '') as canonical, true as equal from part")
def number_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with signs, leading zeros and thousands separators equal their plain spelling."""
    spelt = (F.col("p_size") + F.lit("0.50").cast("decimal(10,2)")).cast("decimal(10,2)").cast("string")
    other = F.concat(F.lit("+0"), F.concat(spelt, F.lit("00")))
    return table(spark, sf_dir, "part").select("p_partkey", spelt.alias("spelt"), text.canonical_number(spelt).alias("canonical"), text.same_answer(spelt, other).alias("equal"))


@query("select doc_id, md5(nfc_normalize(text || 'e' || chr(769))) as digest, true as equal from documents")
def nfc_strict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    decomposed, composed = F.concat("text", F.lit("é")), F.concat("text", F.lit("é"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(udfs.nfc(decomposed)).alias("digest"), text.same_answer(decomposed, composed, udfs.nfc).alias("equal"))


@query("""select p_partkey, 'The [[' || p_brand || ']] and [[size]]' as template, p_brand || ',size' as keys, 'The brand and ' || p_size as bound from part""")
def placeholder_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    template = F.concat(F.lit("The [["), F.col("p_brand"), F.lit("]] and [[size]]"))
    labels = F.create_map(F.col("p_brand"), F.lit("brand"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", template.alias("template"), F.array_join(text.placeholders(template), ",").alias("keys"), udfs.bind(template, labels).alias("bound"))


@query("select doc_id, array_to_string(list_sort(regexp_extract_all(regexp_replace(text, '[^0-9 ]', ' ', 'g'), '[0-9]+')), ',') as tokens from documents")
def numeric_token_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.regexp_replace("text", "[^0-9 ]", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.numeric_tokens(digits), ",").alias("tokens"))


@query("select md5(text) as key, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.duplicate_groups(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id")


@query("select sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')))) as key, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1")
def normalized_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.duplicate_groups(table(spark, sf_dir, "documents"), identity.normalized_hash(F.col("text")), "doc_id")


@query("""with recursive keys as (select doc_id, md5(text) as k from documents union select doc_id, md5(string_split(text, chr(10))[1]) from documents where length(string_split(text, chr(10))[1]) > 40),
hub as (select k, min(doc_id) as h from keys group by k), e as (select distinct doc_id as a, h as b from keys join hub using (k) where doc_id <> h), s as (select a, b from e union select b, a from e),
walk(a, b) as (select doc_id, doc_id from documents union select w.a, s.b from walk w join s on w.b = s.a)
select a as doc_id, min(b) as component from walk group by a""")
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share their text or their long first line, directly or through others."""
    first = F.get(F.split("text", "\n"), 0)
    keys = F.array_compact(F.array(F.md5("text"), F.when(F.length(first) > 40, F.md5(first))))
    return clusters.components_of_keys(table(spark, sf_dir, "documents").withColumn("keys", keys), "doc_id", "keys")


@query("""select o_orderkey, left(sha256('orders:' || o_orderkey || ':qa'), 20) as id, 'variant_' || sha256('["' || o_orderkey || '", "fr", "en", "en"]') as variant from orders""")
def case_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", identity.short_id(F.lit("orders"), key, F.lit("qa")).alias("id"), identity.variant_id(key, F.lit("fr"), F.lit("en")).alias("variant"))


@query("""with l as (select distinct lang from documents), v as (select s.source as base_id, l.lang as image_language, unnest(list_distinct([l.lang, 'fr', 'en'])) as query_language from (select distinct source from documents) s, l)
select base_id, image_language, query_language, case when image_language = query_language then 'monolingual' else 'cross_' || query_language end as configuration, 'variant_' || sha256('["' || base_id || '", "' || image_language || '", "' || query_language || '", "' || query_language || '"]') as variant_id from v""")
def fanout_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    codes = d.select(F.col("lang").alias("language")).distinct()
    found = fanout.variants(d.select(F.col("source").alias("base_id")).distinct(), codes, pivots=("fr", "en"))
    return found.select("base_id", "image_language", "query_language", "configuration", "variant_id")


@query("""select doc_id, case when regexp_full_match(trim(n_chars::varchar), '[0-9]+') and doc_id % 2 = 0 then 'Q' || doc_id else 'Q' || doc_id || chr(10) || 'Answer in ' || lang end as question from documents""")
def reply_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")).otherwise("a text")
    question = F.concat(F.lit("Q"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.with_reply(question, answer, F.concat(F.lit("Answer in "), F.col("lang"))).alias("question"))


@query("""select n_nationkey, sha256('{"key": ' || n_nationkey || ', "name": "' || n_name || '", "region": ' || n_regionkey || '}') as digest from nation""")
def digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    row = F.to_json(F.struct(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))
    return table(spark, sf_dir, "nation").select("n_nationkey", udfs.digest("spaced")(row).alias("digest"))


@query("""select conv_id, turn, text as answer from conversations where trim(text) <> ''""")
def fenced_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers wrapped in fenced JSON are read back."""
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("answer"))), F.lit("\n```"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.read_answer(raw, F.lit(False)).alias("r"))
    return rows.where("r.error is null").select("conv_id", "turn", F.col("r.answer").alias("answer"))


@query("select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '<[^>]+>', '', 'g')) as title from pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", parsing.html_element(F.col("html"), "title").alias("title"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text outside tables, scripts and styles."""
    ship(spark)
    found = parsing.html_outside("html")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found["outside"], "\n").alias("text"))


@query("""select n_nationkey as key, r."row"::int as "row", c."column"::int as "column", case when c."column" = 0 then n_name when r."row" = 0 then 'wide' else 'cell' end as text from nation, (values (0), (1)) r("row"), (values (0), (1), (2)) c("column")
where not (r."row" = 1 and c."column" = 0) and not (r."row" = 0 and c."column" = 2)""")
def grid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of small tables with a cell of two rows and one of two columns."""
    ship(spark)
    parsing.register(spark)
    page = F.concat(F.lit("<table><tr><th rowspan=2>"), F.col("n_name"), F.lit("</th><td colspan=2>wide</td></tr><tr><td>cell</td><td>cell</td></tr></table>"))
    table(spark, sf_dir, "nation").select("n_nationkey", page.alias("page")).createOrReplaceTempView("benchloom_grids")
    return spark.sql("select n_nationkey as key, g.row, g.column, g.text from benchloom_grids, lateral html_grid(page) g")


@query("""with b as (select p_partkey, [p_name, p_brand, p_size::varchar] as cells from part) select p_partkey, (g - 1)::int as column, cells[g] as text from b, range(1, 4) r(g)""")
def markdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("before\n| a | b | c |\n|:---|---|---:|\n| "), F.concat_ws(" | ", "p_name", "p_brand", F.col("p_size").cast("string")), F.lit(" |\nafter"))
    rows = table(spark, sf_dir, "part").select("p_partkey", parsing.markdown_rows(F.get(parsing.markdown_blocks(block), 0)).alias("rows"))
    return rows.select("p_partkey", F.posexplode(F.get("rows", 1)).alias("column", "text"))


@query("select doc_id, replace(text, '0', '0') as text, regexp_replace(text, '[0-9]', '', 'g') = text as had_none from documents")
def ascii_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arabic-Indic digits back to ASCII."""
    ship(spark)
    foreign = F.translate("text", "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return table(spark, sf_dir, "documents").select("doc_id", udfs.ascii_digits(foreign).alias("text"), (F.col("text") == foreign).alias("had_none"))


@query("select doc_id, text, true as restored from documents")
def numbers_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers masked over all paragraphs of a document and put back."""
    docs = table(spark, sf_dir, "documents")
    masked = docs.withColumn("p", text.protect_numbers(F.split("text", "\n")))
    back = masked.withColumn("r", text.restore_numbers(F.col("p.paragraphs"), F.col("p.paragraphs"), F.col("p.tokens")))
    return back.select("doc_id", F.array_join("r.paragraphs", "\n").alias("text"), F.col("r.error").isNull().alias("restored"))


@query()
def similarity_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive benchmark items compared as a copy edit would be."""
    ship(spark)
    b = table(spark, sf_dir, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(after, "item_id").select("item_id", rounded(udfs.similarity_ratio("text", "other")).alias("ratio"))


@query("select p_partkey, case when p_size > 25 and p_retailprice > 1000 then 'Mixed-Spanning Table' when p_size > 25 then 'Row-Spanning Table' when p_retailprice > 1000 then 'Column-Spanning Table' else 'Simple Table' end as kind from part")
def table_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.table_span_class(F.col("p_size") > 25, F.col("p_retailprice") > 1000).alias("kind"))


@query("select event_id, case when event_id % 4 = 0 and event_type = 'error' then true else false end as exhausted from events")
def quota_exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when((F.col("event_id") % 4 == 0) & (F.col("event_type") == "error"), "Insufficient_Quota").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", predicates.quota_exhausted(F.array(code), F.array("event_type")).alias("exhausted"))


@query("select c_custkey, replace(replace(replace(c_name || ' & 5%_x', '&', '\\&'), '%', '\\%'), '_', '\\_') as escaped from (select c_custkey, replace(c_name, '#', '') as c_name from customer)")
def latex_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.regexp_replace("c_name", "#", ""), F.lit(" & 5%_x"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.escape_latex(name).alias("escaped"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects that lost their last brace."""
    cut = F.regexp_replace("props", r"\}$", "")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(text.tolerant_json(cut), "$.k", "long").alias("k"))


@query()
def python_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source code made of each nation's row, read back as data without running it."""
    ship(spark)
    code = F.concat(F.lit("BASE_ID = '"), F.col("n_nationkey").cast("string"), F.lit("'\nDATA = {'name': '"), F.col("n_name"), F.lit("'}\ndef render(d):\n    ax.barh(d)\n"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", udfs.python_literals(code).alias("l"), udfs.renderer_charts(code).alias("charts"))
    return rows.select("n_nationkey", F.col("l")["BASE_ID"].alias("base_id"), F.col("l")["DATA"].alias("data"), F.array_join("charts", ",").alias("charts"))


