"""Readers: each keeps where a row came from."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Split names that stand for others.
SPLIT_NAMES = {"val": "validation"}


def split_of(file_name: Column) -> Column:
    """The split that a file's name begins with, up to its first dash or point."""
    stem = F.regexp_extract(file_name, r"^([^-.]+)", 1)
    names = F.create_map(*(F.lit(x) for pair in SPLIT_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, stem), stem)


def parquet_tree(spark: SparkSession, path: str, without: tuple[str, ...] = ("image",)) -> DataFrame:
    """All Parquet files below a folder with file, row_index (from 0 in each file) and split; heavy columns left out."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    kept = [c for c in rows.columns if c not in without]
    return rows.select(*kept, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"), split_of(F.col("_metadata.file_name")).alias("split"))


def local_files(spark: SparkSession, path: str) -> DataFrame:
    """(split, files): the Parquet files of each split. An empty folder is an error."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    files = rows.select(F.col("path"), split_of(F.element_at(F.split("path", "/"), -1)).alias("split")).groupBy("split").agg(F.sort_array(F.collect_list("path")).alias("files"))
    if files.isEmpty():
        raise FileNotFoundError(f"no Parquet files below {path}")
    return files


def load_local(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The rows of each split below a folder."""
    return {r["split"]: spark.read.parquet(*r["files"]) for r in local_files(spark, path).collect()}  # a row for each split


def wanted_rows(rows: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Some columns of the rows that wanted(file, row_index) names; the latest row wanted bounds the scan."""
    latest = wanted.groupBy("file").agg(F.max("row_index").alias("__latest"))
    near = rows.join(latest, "file").where(F.col("row_index") <= F.col("__latest"))
    return near.join(wanted.select("file", "row_index"), ["file", "row_index"], "left_semi").select("file", "row_index", *columns)


def jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines don't count."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def json_documents(spark: SparkSession, pattern: str, levels: tuple[str, ...] = ("id",), schema: StructType | str | None = None) -> DataFrame:
    """One JSON document for each file; the last steps of its path, extension dropped, become columns."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(pattern)
    steps = F.split(F.regexp_replace(F.col("_metadata.file_path"), r"\.json$", ""), "/")
    return rows.select("*", *(F.element_at(steps, k - len(levels)).alias(f"path_{name}") for k, name in enumerate(levels)))


def csv_rows(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", separator).csv(path)


def csv_grid(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(file, row, column, text): a headerless file as a grid of cells; quoted cells may hold separators, quotes and line breaks. Blank lines are no rows."""
    quoted = re.escape(separator)
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r?\n\z", "").alias("value"))
    # A cell with what ends it: a quoted one up to its closing quote, a plain one up to a separator or line break.
    cell = rf'("(?:[^"]|"")*"|[^{quoted}\r\n]*)({quoted}|\r?\n|\z)'
    texts, ends = (F.regexp_extract_all("value", F.lit(cell), F.lit(k)) for k in (1, 2))
    cells = whole.select("file", F.posexplode(F.arrays_zip(texts.alias("text"), ends.alias("end"))).alias("place", "cell")).select("file", "place", "cell.*")
    return _grid(cells)


def _grid(cells: DataFrame) -> DataFrame:
    at = Window.partitionBy("file").orderBy("place")
    breaks = F.col("end").rlike("\n")
    rows = cells.withColumn("line", F.coalesce(F.sum(breaks.cast("int")).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # After the last cell the pattern matches once more, empty, at the text's end, unless that cell is the empty one after a separator.
    last = F.lag("end").over(at)
    rows = rows.withColumn("extra", (F.col("text") == "") & (F.col("end") == "") & F.coalesce(last == "", F.lit(False))).where("not extra")
    by_line = Window.partitionBy("file", "line")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(by_line)).where("n > 1 or text <> ''")
    rows = rows.withColumns({"row": F.dense_rank().over(Window.partitionBy("file").orderBy("line")) - 1, "column": F.row_number().over(by_line.orderBy("place")) - 1})
    plain = F.when(F.col("text").startswith('"'), F.replace(F.substring("text", F.lit(2), F.length("text") - 2), F.lit('""'), F.lit('"'))).otherwise(F.col("text"))
    return rows.select("file", "row", "column", plain.alias("text"))


def sources(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, value): whole text files, for source code read as data."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def binaries(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256): files by content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"))


def inventory(rows: DataFrame) -> DataFrame:
    """(file, rows): how many rows each file has."""
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))


def marker_counts(spark: SparkSession, path: str, markers: dict[str, str]) -> DataFrame:
    """(name, files): for each name how many files below path match its pattern; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    found = rows.agg(*(F.count_if(F.col("path").rlike(pattern)).alias(name) for name, pattern in markers.items()))
    return found.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("files")) for n in markers))))
