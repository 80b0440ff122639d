"""Sinks: JSON lines, leaderboards, content-addressed archives, split views, reports."""

from __future__ import annotations

import io
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file that names a table's current version; bytes that an archive made on the driver may have.
POINTER, MOST_ZIPPED = "_current", 1 << 28


def write_jsonl(rows: DataFrame, path: str, order: list[str] | None = None, single: bool = False, mode: str = "error") -> None:
    """JSON lines, non-ASCII as it is; `single` asks for one file, for results of known small size."""
    if order:
        rows = rows.orderBy(*order)
    (rows.coalesce(1) if single else rows).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def replace_atomically(rows: DataFrame, path: str) -> None:
    """Writes rows as a new version below path and then points to it; `current` reads the version pointed to.

    The pointer is one small file, replaced by a rename that overwrites: readers see the old rows or the new ones, at any moment, never
    a part and never none. A writer that dies leaves a version that nothing points to. The version before the last is kept for
    readers that have just begun; older ones are deleted.
    """
    spark, version = rows.sparkSession, named("version")
    rows.write.parquet(f"{path}/{version}")
    point(spark, path, version)
    for old in folders(spark, path, "version-")[:-2]:
        delete(spark, f"{path}/{old}")


def named(kind: str) -> str:
    """A name of its own that sorts by time."""
    return f"{kind}-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _root(spark: SparkSession, path: str) -> tuple:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, begin: str) -> list[str]:
    root, fs = _root(spark, path)
    return sorted(name for f in fs.listStatus(root) if (name := f.getPath().getName()).startswith(begin))


def delete(spark: SparkSession, path: str) -> None:
    root, fs = _root(spark, path)
    fs.delete(root, True)


def point(spark: SparkSession, path: str, to: str) -> None:
    """Writes what the table at path is now into its pointer, at once."""
    jvm, (root, fs) = spark.sparkContext._jvm, _root(spark, path)
    Path, conf = jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    new, pointer = Path(root, f"_{named('pointer')}"), Path(root, POINTER)
    out = fs.create(new, True)
    out.writeUTF(to)
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(pointer), options)


def pointed(spark: SparkSession, path: str) -> str:
    """What the pointer at path says; empty if there is none."""
    root, fs = _root(spark, path)
    pointer = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, POINTER)
    if not fs.exists(pointer):
        return ""
    handle = fs.open(pointer)
    said = handle.readUTF()
    handle.close()
    return said


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that replace_atomically has last pointed to."""
    return spark.read.parquet(f"{path}/{pointed(spark, path)}")


def append_keyed(rows: DataFrame, path: str) -> None:
    """Adds results; a reader takes the latest of each key (operators.windows.latest). For tables that go on growing see sources.keyed."""
    rows.write.mode("append").parquet(path)


def archive(rows: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Adds the distinct contents that the archive at path lacks, below the first two digits of their hash; returns rows with the hash.

    What is there stays. Contents that rows have again are read back, and one that no longer has the hash that it is filed under is an error.
    Null contents have no hash and aren't archived.
    """
    spark = rows.sparkSession
    hashed = rows.withColumn("sha256", F.sha2(content, 256))
    mine = hashed.where("sha256 is not null").select("sha256", F.col(content).alias("content"), F.substring("sha256", 1, 2).alias("prefix")).dropDuplicates(["sha256"])
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        there = spark.read.schema("sha256 string, content binary, prefix string").parquet(path)
        again = there.join(mine.select("prefix", "sha256"), ["prefix", "sha256"], "left_semi")
        changed = again.where(F.sha2("content", 256) != F.col("sha256")).select("sha256").first()
        if changed is not None:
            raise ValueError(f"archived content of {changed[0]} has changed")
        mine = mine.join(there.select("prefix", "sha256"), ["prefix", "sha256"], "left_anti").select("sha256", "content", "prefix")
    mine.withColumn("content", F.col("content").cast("binary")).write.mode("append").partitionBy("prefix").parquet(path)
    return hashed.drop(content)


def split_views(rows: DataFrame, accepted: str = "audit.status <=> 'accepted'") -> dict[str, DataFrame]:
    """candidates, and its two complementary parts: null statuses need review."""
    return {"candidates": rows, "accepted": rows.where(accepted), "needs_review": rows.where(f"not ({accepted})")}


def rooted(rows: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """A view for another root: relative paths get a prefix."""
    return rows.withColumns({c: F.concat(F.lit(prefix.rstrip("/") + "/"), F.col(c)) for c in columns})


def zipped(rows: DataFrame, name: str = "path", content: str = "content", most: int = MOST_ZIPPED) -> tuple[bytes, dict[str, str]]:
    """(archive, {name: sha256}) of a few files of `most` bytes or less together, packed on the driver; more is an error."""
    size = rows.agg(F.sum(F.octet_length(content))).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} bytes are too many for one archive on the driver ({most})")
    out, manifest = io.BytesIO(), {}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in rows.select(name, content, F.sha2(content, 256).alias("sha")).orderBy(name).toLocalIterator():
            z.writestr(zipfile.ZipInfo(r[name]), bytes(r[content]))
            manifest[r[name]] = r["sha"]
    return out.getvalue(), manifest


def number(value: float | None) -> str:
    """A metric as tables print it: one decimal, half to even on the exact binary value."""
    return "\\textemdash" if value is None else "100" if value == 100 else f"{value:.1f}"


def latex_row(name: str, values: list[float | None]) -> str:
    return " & ".join([name, *map(number, values)]) + r" \\"


def upsert_row(table: str, name: str, row: str, cells: int = 27) -> str:
    """A LaTeX table with the row of that name replaced, or added as the last one. Wrong cell counts are errors."""
    if row.count("&") != cells:
        raise ValueError(f"{cells} cells expected, {row.count('&')} found")
    head, middle, rest = table.partition("\\midrule\n")
    body, bottom, tail = rest.partition("\\bottomrule")
    if not middle or not bottom:
        raise ValueError("no table body")
    lines = [x for x in body.split("\n") if x.strip()]
    at = next((i for i, x in enumerate(lines) if x.split("&")[0].strip() == name), len(lines))
    lines[at : at + 1] = [row]
    return head + middle + "\n".join(lines) + "\n" + bottom + tail


def publish(table: str, name: str, row: str, judged: int, expected: int, configurations: int, values: list[float]) -> str:
    """upsert_row behind its guards: a finished judge, all configurations, values between 0 and 100."""
    if judged != expected:
        raise ValueError("judging is not finished")
    if configurations != 70:
        raise ValueError("70 configurations expected")
    if any(v is None or not 0 <= v <= 100 for v in values):
        raise ValueError("values must be between 0 and 100")
    return upsert_row(table, name, row)


def paragraph_report(title: str, facts: dict[str, object]) -> str:
    return f"# {title}\n\n" + "\n\n".join(f"**{k}**: {v}" for k, v in facts.items()) + "\n"
