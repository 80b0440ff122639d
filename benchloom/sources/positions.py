"""Rows of Parquet files by their place, read by row groups.

An index of row groups comes from the files' footers, read by tasks. Wanted places are looked up in it, and only row groups that hold one are read, and of these
only the columns asked for. The files must be open to tasks by pyarrow (mounted folders, HDFS, object stores); readers.wanted_rows needs Spark's readers only, but scans.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

FOOTER = "file string, row_group int, first_row long, rows long, bytes long, columns array<string>"


def opened(path: str) -> pq.ParquetFile:
    """A file by its URI; Spark escapes these, also of local files."""
    if urlsplit(path).scheme in ("", "file"):
        return pq.ParquetFile(unquote(urlsplit(path).path))
    system, inner = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(inner))


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path in frame["path"]:
            with opened(path) as file:
                groups, first, out = file.metadata, 0, []
                for k in range(groups.num_row_groups):
                    group = groups.row_group(k)
                    out.append((path, k, first, group.num_rows, group.total_byte_size, list(file.schema_arrow.names)))
                    first += group.num_rows
            yield pd.DataFrame(out, columns=["file", "row_group", "first_row", "rows", "bytes", "columns"])


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, first_row, rows, bytes, columns) of all Parquet files below a folder; only listings and footers are read."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select(F.col("_metadata.file_path").alias("path"))
    return files.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(_footers, FOOTER)


def inventory(index: DataFrame) -> DataFrame:
    """(file, rows, columns): how many rows each file has, and which columns."""
    return index.groupBy("file").agg(F.sum("rows").alias("rows"), F.first("columns").alias("columns"))


def wanted_groups(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, row_group, places): the row groups that hold any of wanted(file, row_index), and the places in them, from 0. Places outside of a file are left out."""
    groups = index.where("rows > 0").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("first_row", "rows", "row_group"))).alias("groups"))
    found = wanted.select("file", "row_index").where("row_index >= 0").distinct().join(groups, "file")
    group = F.element_at("groups", F.size(F.filter("groups", lambda g: g["first_row"] <= F.col("row_index"))))
    held = found.select("file", group.alias("g"), "row_index").where(F.col("row_index") < F.col("g.first_row") + F.col("g.rows"))
    return held.groupBy("file", F.col("g.row_group").alias("row_group"), F.col("g.first_row").alias("first_row")).agg(F.sort_array(F.collect_list(F.col("row_index") - F.col("g.first_row"))).alias("places"))


def rows_at(spark: SparkSession, path: str, wanted: DataFrame, columns: list[str], index: DataFrame | None = None) -> DataFrame:
    """(file, row_index, *columns) of the rows that wanted(file, row_index) names; file as in the index."""
    index = row_groups(spark, path) if index is None else index
    kinds = spark.read.option("recursiveFileLookup", True).parquet(path).select(*columns).schema
    shape = "file string, row_index long" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kinds)
    names = list(columns)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                with opened(r.file) as file:
                    rows = file.read_row_group(r.row_group, columns=names).select(names).take(r.places).to_pandas()
                rows.insert(0, "row_index", [p + r.first_row for p in r.places])
                rows.insert(0, "file", r.file)
                yield rows

    ship(spark)
    return wanted_groups(index, wanted).mapInPandas(read, shape)
