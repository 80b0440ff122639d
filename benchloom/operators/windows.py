"""First, latest and best rows for a key, and other ordered operations. Every order ends in a unique column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order for each key, by aggregation: what is shuffled is a row for each key and task."""
    return _extreme(rows, keys, F.max_by(F.struct(*rows.columns), F.struct(*order)))


def earliest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _extreme(rows, keys, F.min_by(F.struct(*rows.columns), F.struct(*order)))


def _extreme(rows: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(chosen.alias("__row")).select("__row.*")


def first_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key. Spark prunes each partition to n a key before the shuffle."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(at)).where(F.col("__n") <= n).drop("__n")


def sliding_median(rows: DataFrame, keys: list[str], order: list[str], value: str, side: int = 1, name: str = "median") -> DataFrame:
    """The middle value among `side` rows before and after; at the ends, of the rows there are (the upper of two)."""
    at = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-side, side)
    near = F.sort_array(F.collect_list(value).over(at))
    return rows.withColumn(name, F.get(near, F.floor(F.size(near) / 2).cast("int")))


def group_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.median(value).alias("median"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], width: int = 3, name: str = "number") -> DataFrame:
    """Zero-padded numbers from 0 within each key."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.lpad((F.row_number().over(at) - 1).cast("string"), width, "0"))


def priority(ranks: list[Column]) -> Column:
    """0 where the first condition holds, else 1 for the second and so on."""
    return F.coalesce(*(F.when(c, i) for i, c in enumerate(ranks)), F.lit(len(ranks)))


def by_priority(rows: DataFrame, ranks: list[Column], order: str) -> DataFrame:
    """Rows for which the first condition holds, then those for the second and so on; the old order within each."""
    return rows.orderBy(priority(ranks), order)


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place in an order, from 1, without bringing them together: dealt by ranges of the order and numbered in each, and on from the ranges before."""
    keys = [f"order_{k}_" for k in range(len(order))]
    dealt = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Stored, so that ranges and numbers are the same whenever they are read.
    dealt = stored(dealt.drop(*keys).withColumns({"range_": F.spark_partition_id(), "number_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    sizes = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.select("range_", (F.sum("n").over(Window.orderBy("range_")) - F.col("n")).alias("before_"))
    return dealt.join(before, "range_").select(*rows.columns, (F.col("before_") + F.col("number_") + 1).alias(name))


def interpolated(points: DataFrame, keys: list[str], x: str, y: str, at: float) -> DataFrame:
    """(keys, value): y at x = at, linear between neighbours and constant beyond the ends."""
    below = F.max_by(F.struct(x, y), F.when(F.col(x) <= at, F.col(x)))
    above = F.min_by(F.struct(x, y), F.when(F.col(x) >= at, F.col(x)))
    g = points.groupBy(*keys).agg(below.alias("b"), above.alias("a"))
    line = F.col(f"b.{y}") + (F.col(f"a.{y}") - F.col(f"b.{y}")) * F.try_divide(at - F.col(f"b.{x}"), F.col(f"a.{x}") - F.col(f"b.{x}"))
    return g.select(*keys, F.coalesce(line, f"b.{y}", f"a.{y}").alias("value"))


def matrix_line(points: DataFrame, keys: list[str], line: str, value: str, over: float) -> DataFrame:
    """(keys, line, greatest, above): of each row or column of a matrix of points its greatest value, and how many values are over a threshold."""
    return points.groupBy(*keys, line).agg(F.max(value).alias("greatest"), F.count_if(F.col(value) > over).alias("above"))
