"""Joins, sets, audits and sampling over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, paired, predicates, sampling, scoring, sets, windows
from ..storage import by_shuffle
from .registry import query, rounded, table

BUSY = "(select distinct o_custkey from orders where o_totalprice > 250000)"


@query(f"select c_custkey, c_name from customer where c_custkey not in {BUSY}")
def anti_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return predicates.pending(table(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query(f"select c_custkey, c_name from customer where c_custkey in {BUSY}")
def semi_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(keep, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""select coalesce(a.k, b.k) as k, case when a.k is null then 'lines' else 'orders' end as missing_from from (select distinct l_orderkey as k from lineitem where l_quantity > 3) a full join (select o_orderkey as k from orders where o_totalprice > 2000) b on a.k = b.k where a.k is null or b.k is null""")
def keyset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 3").select(F.col("l_orderkey").alias("k"))
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 2000").select(F.col("o_orderkey").alias("k"))
    found = sets.key_violations({"lines": lines, "orders": orders}, ["k"])
    return found.select("k", F.array_join("missing_from", ",").alias("missing_from"))


_PERTURBED = "select n_nationkey, case when n_nationkey % 5 = 0 then lower(n_name) else n_name end as n_name, n_regionkey from nation where n_nationkey <> 7"


@query(f"with o as (select n_nationkey, n_name, n_regionkey from nation), n as ({_PERTURBED}) select *, 'old' as side from (select * from o except all select * from n) union all select *, 'new' from (select * from n except all select * from o)")
def row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    new = old.where("n_nationkey <> 7").withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return sets.row_diff(old, new)


@query(f"with n as ({_PERTURBED}) select n.n_nationkey, 'n_name' as changed, true as violation from n join nation o using (n_nationkey) where n.n_name is distinct from o.n_name")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    new = old.where("n_nationkey <> 7").withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    return sets.changed_fields(old, new, "n_nationkey", ("n_regionkey",)).withColumn("changed", F.array_join("changed", ","))


@query("""select a.c_custkey, (a.c_name is not distinct from b.c_name and a.c_nationkey is not distinct from b.c_nationkey and a.c_acctbal is not distinct from b.c_acctbal) as reusable from customer a join (select c_custkey, c_name, case when c_custkey % 3 = 0 then null else c_nationkey end as c_nationkey, case when c_custkey % 5 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer) b using (c_custkey)""")
def null_safe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("c_name", "c_nationkey", "c_acctbal")
    old = table(spark, sf_dir, "customer").select("c_custkey", F.struct(*fields).alias("o"))
    new = table(spark, sf_dir, "customer").withColumns({"c_nationkey": F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")), "c_acctbal": F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))})
    return old.join(new.select("c_custkey", F.struct(*fields).alias("n")), "c_custkey").select("c_custkey", predicates.reusable("o", "n", fields).alias("reusable"))


@query("""select s_suppkey as case_id, case when s_suppkey in (1, 2) then 'corrected' else s_name end as answer_effective, case when s_suppkey in (1, 2) then 'c' || s_suppkey end as correction_id, s_suppkey = 3 as correction_error from supplier""")
def corrections_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("case_id"), F.lit("supplier").alias("source"), F.lit("f").alias("file"), F.col("s_suppkey").cast("long").alias("row_index"), F.col("s_name").alias("answer"))
    first = s.where("case_id between 1 and 3")
    fixes = first.select("case_id", F.concat(F.lit("c"), F.col("case_id")).alias("id"), "source", "file", F.when(F.col("case_id") == 3, -1).otherwise(F.col("row_index")).alias("row_index"), F.col("answer").alias("original_answer"), F.lit("corrected").alias("corrected_answer"))
    return scoring.with_corrections(s, fixes).select("case_id", "answer_effective", "correction_id", "correction_error")


_CHECKS = """with v as (
select 'orders_unique' as "check", count(*) as n from (select o_orderkey from orders group by 1 having count(*) > 1)
union all select 'lines_have_orders', count(*) from (select distinct l_orderkey from lineitem where l_orderkey not in (select o_orderkey from orders))
union all select 'status_known', count(*) from orders where o_orderstatus not in ('O', 'F')
union all select 'nation_has_region', count(*) from nation where n_regionkey not in (select r_regionkey from region)
union all select 'one_date_for_line', count(*) from (select l_orderkey, l_linenumber from lineitem group by all having count(distinct l_shipdate) > 1))
select "check", n as violations, n = 0 as passed from v"""


@query(_CHECKS)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lost = li.select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(by_shuffle(o), "o_orderkey", "left_anti")
    checks = [
        audit.unique("orders_unique", o, ["o_orderkey"]),
        audit.violations("lines_have_orders", lost, F.col("o_orderkey"), F.lit(None)),
        audit.where("status_known", o, ~F.col("o_orderstatus").isin("O", "F"), "o_orderkey", F.col("o_orderstatus")),
        audit.violations("nation_has_region", n.join(r, n.n_regionkey == r.r_regionkey, "left_anti"), F.col("n_nationkey"), F.lit(None)),
        audit.constant("one_date_for_line", li, ["l_orderkey", "l_linenumber"], ["l_shipdate"]),
    ]
    return audit.summary(audit.report(spark, checks), ["orders_unique", "lines_have_orders", "status_known", "nation_has_region", "one_date_for_line"])


@query("""with r as (select l_returnflag as "check", case when l_quantity < 5 then null else l_discount < 0.05 end as passed from lineitem)
select "check", count(*) filter (where passed) as passed, count(passed) as total, round(count(*) filter (where passed) / nullif(count(passed), 0), 6) as rate from r group by all""")
def audit_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("check"), F.when(F.col("l_quantity") >= 5, F.col("l_discount") < 0.05).alias("passed"))
    return paired.pass_fractions(rows).withColumn("rate", rounded("rate"))


@query("""with i as (select unnest(list_filter([case when l_discount > 0.08 then 'discount' end, case when l_tax > 0.06 then 'tax' end, case when l_quantity > 45 then 'quantity' end], lambda x: x is not null)) as issue from lineitem) select issue, count(*) as n from i group by issue""")
def issue_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"discount": F.col("l_discount") > 0.08, "tax": F.col("l_tax") > 0.06, "quantity": F.col("l_quantity") > 45}
    return paired.issue_histogram(table(spark, sf_dir, "lineitem"), rules, "l_orderkey")[1]


@query("""with w as (select o_orderpriority as source, count(*) as n from orders group by 1), s as (select *, 32 * n // (select sum(n) from w) as fl, 32 * n % (select sum(n) from w) as rest from w)
select source, n, (fl + case when row_number() over (order by rest desc, source) <= 32 - (select sum(fl) from s) then 1 else 0 end)::bigint as desired from s""")
def apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.apportion(groups, 32)


@query("select p_brand, p_partkey, row_number() over (partition by p_brand order by sha256('20260909:' || p_partkey), p_partkey)::int as place from part qualify place <= 4")
def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top_by_hash(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", 4).select("p_brand", "p_partkey", "place")


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 3).cast("string")).alias("source"), F.concat_ws("/", F.concat(F.lit("m"), (F.col("p_partkey") % 3).cast("string")), "p_brand").alias("stratum"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("id"), F.element_at(F.split("p_type", " "), -1).alias("hint"), F.concat(F.lit("g"), F.pmod(F.xxhash64("p_partkey"), F.lit(900)).cast("string")).alias("group_id"))


@query()
def quota_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    strata = {r["stratum"]: 2 for r in pool.groupBy("stratum").count().where("count >= 8").collect()}  # a row for each brand
    return sampling.greedy_quota(pool, strata)


@query()
def greedy_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    registry = pool.select(F.col("id").alias("base_id"), "source", (F.pmod(F.xxhash64("id"), F.lit(20)) == 0).alias("selected"), F.array("group_id").alias("groups"), F.array(F.concat(F.lit("task="), "hint"), F.concat(F.lit("stratum="), "stratum")).alias("tokens"))
    return sampling.greedy_extension(registry, 12)


@query()
def bounded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return sampling.batches(rows, "lang", "doc_id", "n_chars", 7500, 8)


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 4) as low, round(quantile_cont(l_extendedprice, 0.5), 4) as middle, round(quantile_cont(l_extendedprice, 0.975), 4) as high from lineitem group by 1")
def percentiles_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("l_extendedprice", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(p.alias("p")).select("l_returnflag", *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("low", "middle", "high"))))


@query("""select user_id, count(*) as n, (max(event_id) % 7)::bigint as k from (select * from events where event_id % 2 = 0 union all select * from events where event_id % 2 = 1) group by user_id""")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slices united; of two maps with one key the right one's value stays."""
    e = table(spark, sf_dir, "events")
    both = sets.unions([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")])
    rows = both.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("m"))
    merged = sets.merged(F.create_map(F.lit("k"), F.lit(-1).cast("long")), F.create_map(F.lit("k"), (F.col("m") % 7).cast("long")))
    return rows.select("user_id", "n", merged["k"].alias("k"))


@query("""with w as (select s_nationkey, s_acctbal as y, (s_suppkey % 10)::double as x, s_suppkey from supplier), p as (select s_nationkey, x, max(y) as y from w group by all),
g as (select s_nationkey, max(x) filter (where x <= 4.5) as bx, min(x) filter (where x >= 4.5) as ax from p group by 1)
select g.s_nationkey, round(coalesce(b.y + (a.y - b.y) * (4.5 - bx) / nullif(ax - bx, 0), b.y, a.y), 6) as value from g left join p b on b.s_nationkey = g.s_nationkey and b.x = bx left join p a on a.s_nationkey = g.s_nationkey and a.x = ax""")
def interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "supplier").groupBy("s_nationkey", (F.col("s_suppkey") % 10).cast("double").alias("x")).agg(F.max("s_acctbal").alias("y"))
    return windows.interpolated(points, ["s_nationkey"], "x", "y", 4.5).withColumn("value", rounded("value"))


@query("""with b as (select l_orderkey as image, l_linenumber as box, (l_linenumber * 10)::double as "left", (l_linenumber * 10 + l_quantity)::double as "right" from lineitem)
select distinct a.image::varchar as "key", a.box || '/' || o.box as detail from b a join b o on a.image = o.image and a.box < o.box and a."left" < o."right" and o."left" < a."right" """)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    left = (F.col("l_linenumber") * 10).cast("double")
    boxes = li.select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box"), left.alias("left"), F.lit(0.0).alias("top"), (left + F.col("l_quantity")).alias("right"), F.lit(10.0).alias("bottom"), F.lit(1000.0).alias("width"), F.lit(10.0).alias("height"))
    return audit.geometry(boxes).where("check = 'overlap'").select("key", "detail")


@query("""select o_orderkey, case when o_orderstatus = 'F' and o_totalprice > 200000 then 'repair' when o_orderstatus = 'F' then 'hold' else 'keep' end as decision from orders""")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rules = [("repair", (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)), ("hold", F.col("o_orderstatus") == "F")]
    return sampling.triage(o, rules, "keep").select("o_orderkey", "decision")


@query("""select n_name, case when n_regionkey = 1 then 'excluded' when n_nationkey in (3, 8) then 'selected' else 'available' end as membership from nation""")
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("membership", F.lit("available"))
    rules = {"excluded": n.where("n_regionkey = 1"), "selected": n.where("n_nationkey in (3, 8)")}
    return sets.relabelled(n, "membership", rules, "n_nationkey").select("n_name", "membership")
