"""Sources and sinks on round trips: the driver's tables written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import windows
from ..session import ship
from ..sources import keyed, readers, sinks
from ..sources import positions as places
from ..storage import shared_dir
from .registry import query, table

REGION_FILES = ("val-0000", "test-0001", "test-0002", "train-0003", "train-0004")


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/benchloom/{name}-{uuid.uuid4().hex}"


def one_file(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rows of known small size as one file of that very name."""
    spark = rows.sparkSession
    rows.coalesce(1).write.format(kind).save(f"{path}.parts")
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    parts = Path(f"{path}.parts")
    fs = parts.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-"))
    fs.rename(part, Path(path))
    fs.delete(parts, True)


def region_files(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The nations of each region in a file of its own."""
    nations, path = table(spark, sf_dir, "nation"), folder(spark, name)
    for region, file in enumerate(REGION_FILES):
        rows = nations.where(F.col("n_regionkey") == region).select("n_nationkey", "n_name", F.lit("pixels").alias("image"))
        one_file(rows.orderBy("n_nationkey"), f"{path}/{file}.parquet")
    return path


_SPLIT = "case n_regionkey when 0 then 'validation' when 1 then 'test' when 2 then 'test' else 'train' end"
_FILE = "case n_regionkey when 0 then 'val-0000' when 1 then 'test-0001' when 2 then 'test-0002' when 3 then 'train-0003' else 'train-0004' end"
_POSITIONS = f"p as (select n_nationkey, n_regionkey, {_FILE} as file, {_SPLIT} as split, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as row_index from nation)"


@query(f"select {_SPLIT} as split, count(distinct n_regionkey) as files from nation group by split")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.local_files(spark, region_files(spark, sf_dir, "splits")).select("split", F.size("files").cast("long").alias("files"))


@query(f"select {_SPLIT} as split, n_nationkey, n_name from nation")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = readers.load_local(spark, region_files(spark, sf_dir, "rows"))
    found = [rows.select(F.lit(name).alias("split"), "n_nationkey", "n_name") for name, rows in sorted(parts.items())]
    return found[0].unionByName(found[1]).unionByName(found[2])


def positions(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = readers.parquet_tree(spark, region_files(spark, sf_dir, name))
    return rows.withColumn("file", F.regexp_extract("file", r"([^/]+)\.parquet$", 1))


@query(f"with {_POSITIONS} select n_nationkey, file, split, row_index from p")
def file_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its file, its place there and its split; the heavy column isn't read."""
    rows = positions(spark, sf_dir, "positions")
    if "image" in rows.columns:
        raise ValueError("the heavy column was read")
    return rows.select("n_nationkey", "file", "split", "row_index")


@query(f"with {_POSITIONS} select file, row_index, n_nationkey from p where (n_regionkey % 2 = 0 and row_index = 1) or row_index = 3")
def positions_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(spark, sf_dir, "wanted")
    even = F.substring("file", -1, 1).cast("int") % 2 == 0
    wanted = rows.where((even & (F.col("row_index") == 1)) | (F.col("row_index") == 3)).select("file", "row_index")
    return readers.wanted_rows(rows, wanted, ["n_nationkey"])


@query(f"with {_POSITIONS} select file, count(*) as rows from p group by file")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.inventory(positions(spark, sf_dir, "inventory"))


@query(f"with {_POSITIONS} select file, row_index, p.n_nationkey, n_name from p join nation n on n.n_nationkey = p.n_nationkey where (p.n_regionkey % 2 = 0 and row_index = 1) or row_index = 3")
def indexed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of some places, by the files' index of row groups."""
    path = region_files(spark, sf_dir, "indexed")
    every = readers.parquet_tree(spark, path)
    even = F.regexp_extract("file", r"([0-9])\.parquet$", 1).cast("int") % 2 == 0
    wanted = every.where((even & (F.col("row_index") == 1)) | (F.col("row_index") == 3)).select("file", "row_index")
    rows = places.rows_at(spark, path, wanted, ["n_nationkey", "n_name"])
    return rows.withColumn("file", F.regexp_extract("file", r"([^/]+)\.parquet$", 1))


@query(f"with {_POSITIONS} select file, count(*) as rows, 'n_nationkey,n_name,image' as columns from p group by file")
def file_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of each file, from the footers."""
    found = places.inventory(places.row_groups(spark, region_files(spark, sf_dir, "columns")))
    return found.select(F.regexp_extract("file", r"([^/]+)\.parquet$", 1).alias("file"), "rows", F.array_join("columns", ",").alias("columns"))


@query("select doc_id, case when doc_id % 5 = 0 then n_chars + 5 when doc_id % 3 = 0 then n_chars + 3 else n_chars end as n_chars, case when doc_id % 5 = 0 then 3 when doc_id % 3 = 0 then 2 else 1 end as attempt from documents")
def compacted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three upserts and a merge: one row for each key, the latest."""
    rows, path = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), folder(spark, "keyed")
    for attempt, every in ((1, 1), (3, 5), (2, 3)):
        new = F.col("n_chars") + (every if attempt > 1 else 0)
        keyed.upsert(rows.where(F.col("doc_id") % every == 0).select("doc_id", new.alias("n_chars"), F.lit(attempt).alias("attempt")), path, ["doc_id"], ["attempt"])
    keyed.compact(spark, path, ["doc_id"], ["attempt"])
    return keyed.read(spark, path, ["doc_id"], ["attempt"])


@query("select 'tests' as name, 2 as files union all select 'parquet', 5 union all select 'none', 0")
def file_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.marker_counts(spark, region_files(spark, sf_dir, "markers"), {"tests": "/test-", "parquet": r"\.parquet$", "none": "/x-"})


@query("select r_regionkey, sha256(r_name || chr(10)) as sha256, octet_length(encode(r_name)) + 1 as length from region")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "hashes")
    for r in table(spark, sf_dir, "region").collect():  # five rows
        one_file(spark.createDataFrame([(r["r_name"],)], "value string"), f"{path}/{r['r_regionkey']}.txt", "text")
    rows = readers.binaries(spark, path, "*.txt")
    return rows.select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("int").alias("r_regionkey"), "sha256", "length")


@query("select conv_id, turn, role, text from conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "conversations"), folder(spark, "jsonl")
    sinks.write_jsonl(rows, path)
    return readers.jsonl(spark, path, rows.schema).select("conv_id", "turn", "role", "text")


@query("select r_regionkey as number, 'run' || r_regionkey % 2 as run, r_name as name from region")
def json_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document in each file, whose path says which one it is."""
    path = folder(spark, "json")
    for r in table(spark, sf_dir, "region").collect():  # five rows
        one_file(spark.createDataFrame([(f'{{\n "name": "{r["r_name"]}"\n}}',)], "value string"), f"{path}/run{r['r_regionkey'] % 2}/{r['r_regionkey']}.json", "text")
    rows = readers.json_documents(spark, f"{path}/*/*.json", ("run", "number"), "name string")
    return rows.select(F.col("path_number").cast("int").alias("number"), F.col("path_run").alias("run"), "name")


@query("select c_custkey::varchar as c_custkey, c_name, c_acctbal::decimal(12,2)::varchar as c_acctbal from customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal")), path)
    return readers.csv_rows(spark, path)


@query("""with n as (select n_name, n_nationkey, row_number() over (order by n_nationkey) - 1 as row from nation)
select row, 0 as "column", n_nationkey::varchar as text from n union all select row, 1, n_name || ', "the"' || chr(10) || 'second line' from n union all select row, 2, '' from n""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headerless file whose cells hold separators, quotes and line breaks."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_nationkey", F.lit(',"'), "n_name", F.lit(', ""the""\nsecond line",')).alias("value"))
    path = folder(spark, "grid")
    one_file(rows.coalesce(1).sortWithinPartitions("n_nationkey").select("value"), f"{path}/grid.csv", "text")
    return readers.csv_grid(spark, path).select("row", "column", "text")


@query("select p_partkey, p_size + 1 as width, p_size * 300 as height from part")
def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of PNG files made from numbers, and read again."""
    ship(spark)
    four = lambda c: F.lpad(F.hex(c), 8, "0")
    width, height = (F.col("p_size") + 1).cast("long"), (F.col("p_size") * 300).cast("long")
    header = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(width), four(height)))
    return table(spark, sf_dir, "part").select("p_partkey", udfs.image_size(header).alias("s")).select("p_partkey", "s.width", "s.height")


@query("select doc_id, text from documents where doc_id % 2 = 1")
def replaced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written whole and then replaced: readers see the second state."""
    rows, path = table(spark, sf_dir, "documents").select("doc_id", "text"), folder(spark, "replaced")
    sinks.replace_atomically(rows, path)
    sinks.replace_atomically(rows.where("doc_id % 2 = 1"), path)
    return sinks.current(spark, path)


@query("select doc_id, case when doc_id % 3 = 0 then n_chars + 1 else n_chars end as n_chars from documents")
def appended_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results added twice under some keys: the latest of each counts."""
    rows, path = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), folder(spark, "appended")
    sinks.append_keyed(rows.withColumn("attempt", F.lit(1)), path)
    sinks.append_keyed(rows.where("doc_id % 3 = 0").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), F.lit(2).alias("attempt")), path)
    return windows.latest(spark.read.parquet(path), ["doc_id"], ["attempt"]).select("doc_id", "n_chars")


@query("select sha256(text) as sha256, count(distinct text) as copies from documents group by 1")
def archive_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents archived in two overlapping slices: all are there, each once."""
    rows, path = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), folder(spark, "archive")
    sinks.archive(rows.where("doc_id % 3 < 2"), path)
    sinks.archive(rows.where("doc_id % 3 > 0"), path)
    return spark.read.parquet(path).groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))


@query("select n_name as path, sha256(n_name || ' text') as sha256 from nation")
def zipped_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), F.concat("n_name", F.lit(" text")).cast("binary").alias("content"))
    return spark.createDataFrame(list(sinks.zipped(files)[1].items()), "path string, sha256 string")


def _cells(row: dict) -> list[float]:
    return [float(row["r_regionkey"] * 10 + 0.25)] * 26 + [100.0]


@query(r"""select r_name as name, r_name || repeat(' & ' || printf('%.1f', r_regionkey * 10 + 0.25), 26) || ' & 100 \\' as line from region""")
def latex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed table into which each region's row is put twice: it stands there once."""
    regions = table(spark, sf_dir, "region").collect()  # five rows
    text = "\\toprule\nhead\n\\midrule\n\\bottomrule\n"
    for r in [*regions, *regions]:
        text = sinks.publish(text, r["r_name"], sinks.latex_row(r["r_name"], _cells(r)), 70, 70, 70, _cells(r))
    body = text.split("\\midrule\n")[1].split("\\bottomrule")[0].strip().split("\n")
    return spark.createDataFrame([(line.split(" & ")[0], line) for line in body], "name string, line string")


@query("""select '# Nations' || chr(10) || chr(10) || '**nations**: ' || count(*) || chr(10) || chr(10) || '**regions**: ' || count(distinct n_regionkey) || chr(10) as report from nation""")
def printed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("nations"), F.countDistinct("n_regionkey").alias("regions")).first().asDict()
    return spark.createDataFrame([(sinks.paragraph_report("Nations", facts),)], "report string")
