"""Cross-site boilerplate lines by distinct-site spread.

HyperLogLog sketches of the sites and of the texts are kept for each line hash and merged by aggregation, before the
shuffle and after it. Lines whose estimates are near the threshold get exact distinct counts. A line that
stands on SITES sites or more, in as many distinct texts, goes from every document: a whole that was copied to many sites
is one text, so that it doesn't make its own lines boilerplate. `remove_spread` counts classes of near copies in the place of texts.
Everything is built of DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, by_shuffle, drop, stored

#: Sites, and texts, from which on a line is boilerplate; log2 of a sketch's registers; estimates within so many sites, or so
#: large a share, of the threshold are counted exactly (over 6 standard errors).
SITES, REGISTERS, NEAR, NEAR_SHARE = 10, 12, 1.0, 0.1

_BLANKS = " \t\n\x0b\x0c\r"
_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_FILLED = r"(?:\A|\n)[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D]"


def spread_lines(lines: DataFrame, over: str, least: int) -> DataFrame:
    """(h1, h2) of lines(h1, h2, ...) that stand on `least` distinct values of the column `over` or more."""
    near = max(NEAR, NEAR_SHARE * least)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg(over, F.lit(REGISTERS)).alias("sketch"), F.count(F.lit(1)).alias("n"))
    # A line on so many sites stands at least as often anywhere.
    guessed = stored(sketched.where(F.col("n") >= least).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("guess")).where(F.col("guess") > least - near), "spread")
    close = guessed.where(F.col("guess") < least + near).select("h1", "h2")
    exact = lines.select("h1", "h2", over).join(close, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    out = stored(guessed.where(F.col("guess") >= least + near).select("h1", "h2").unionByName(exact.select("h1", "h2")), "lines")
    drop(lines.sparkSession, guessed)
    return out


def _cleaned(rows: DataFrame, sites: int, near_copies: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows(row, doc, version, site, text) to (row, text, n_lines, n_removed)."""
    spark = rows.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = rows.select("doc", "version", "site", F.posexplode(F.split(text, "\n")).alias("place", "line")).withColumn("line", F.btrim("line", F.lit(_BLANKS))).where("line <> ''")
    # Texts are parted once; what follows reads places and hashes.
    lines = stored(lines.select("doc", "version", "site", "place", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")), "parted")
    on_sites = spread_lines(lines, "site", sites)
    held = stored(lines.join(on_sites, ["h1", "h2"], "left_semi").select("doc", "version", "place", "h1", "h2"), "held")
    common = spread_lines(held, "version", sites)
    drop(spark, lines, on_sites)
    if near_copies is not None:
        # Classes are no more than texts: only lines of so many texts, and the documents that hold them, need them.
        wide = stored(held.join(common, ["h1", "h2"], "left_semi"), "wide")
        drop(spark, held, common)
        holders = rows.join(wide.select("doc", "version").distinct(), ["doc", "version"], "left_semi")
        holders = stored(holders.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "text"), "holders")
        known = near_copies(holders).where("doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.min("component_id").alias("component"))
        by_class = F.when(F.col("component").isNotNull(), F.xxhash64(F.lit("class"), "component")).otherwise(F.col("version"))
        held = stored(wide.join(by_shuffle(known), "doc", "left").select("doc", "version", "place", "h1", "h2", by_class.alias("class")), "held")
        common = spread_lines(held, "class", sites)
        drop(spark, wide, holders)
    hits = held.select("doc", "version", "place", "h1", "h2").join(common, ["h1", "h2"], "left_semi")
    hits = stored(hits.groupBy("doc", "version").agg(F.collect_set("place").alias("places")), "hits")
    drop(spark, held, common)
    joined = rows.select("row", "doc", "version", "text").join(by_shuffle(hits), ["doc", "version"], "left")
    all_places = lambda parts: F.sequence(F.lit(0), F.size(parts) - 1)
    rest = F.transform(F.array(F.split(text, "\n")), lambda parts: F.array_join(F.transform(F.array_except(all_places(parts), F.col("places")), lambda i: F.get(parts, i)), "\n"))[0]
    filled = F.regexp_count(text, F.lit(_FILLED)).cast("long")
    return joined.select("row", F.when(F.col("places").isNotNull(), rest).otherwise(F.col("text")).alias("text"), filled.alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(row, doc, version, site, text): all columns travel in one struct, so that none can clash with a name used here."""
    text = F.col(f"`{text_col}`").cast("string")
    doc, site = F.col(f"`{id_col}`").cast("long"), F.col(f"`{site_col}`")
    whole = F.struct(*(F.lit(None).cast(docs.schema[c].dataType).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
    return docs.select(whole.alias("row"), F.coalesce(doc, F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("version"), F.when(site.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(site, F.lit(1))).alias("site"), text.alias("text"))


def remove_boilerplate(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with text_col rewritten, and long columns n_lines and n_removed (lines with a word) added.

    Lines are parted by \\n and compared without white space at their ends. A line on `sites` distinct sites or more, in as many
    distinct texts, goes, whatever its share of a document: one may be left empty. A null site is one site of its own.
    A null text stays null, with no lines. Rows that repeat doc_id and text get the same result; rows without a
    doc_id are told apart by their texts. Columns of docs that are called n_lines or n_removed are replaced; others can have any name. Empty table: no rows.
    """
    return _cleaned(_keyed(docs, id_col, text_col, site_col), sites).select(*_back(docs, text_col), "n_lines", "n_removed")


def _back(docs: DataFrame, text_col: str) -> list[Column]:
    return [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]


def remove_spread(docs: DataFrame, near_copies: Callable[[DataFrame], DataFrame], sites: int = SITES) -> DataFrame:
    """docs without lines that stand on `sites` distinct sites and in as many distinct classes of copies or near copies; columns as they were.

    So neither copies nor near copies of a whole can make their own lines spread. near_copies gives (doc_id, component_id) of a table
    (doc_id, text): of the documents with a line that so many sites and texts have, where alone classes matter. Rows
    with a null doc_id, or one that it doesn't give, are classed by text. Every row stays, with a null text if it had one. Empty table: no rows.
    """
    kept = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return _cleaned(_keyed(docs, "doc_id", "text", "source"), sites, near_copies).select(*kept)


#: remove_boilerplate over documents, as DuckDB SQL.
SQL = rf"""
with lines as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as place from documents
), filled as (
  select doc_id, source, text, place, raw, regexp_replace(raw, '{_EDGES}', '', 'g') as line from lines
), spread as (
  select line from filled where line <> '' group by line having count(distinct coalesce('x' || source, '')) >= {SITES} and count(distinct text) >= {SITES}
), kept as (
  select f.doc_id, string_agg(case when s.line is null then raw end, chr(10) order by place) as text,
    sum(case when f.line <> '' then 1 else 0 end)::bigint as n_lines, sum(case when s.line is not null then 1 else 0 end)::bigint as n_removed
  from filled f left join spread s on f.line = s.line group by f.doc_id
)
select doc_id, coalesce(text, '') as text, n_lines, n_removed from kept
"""
