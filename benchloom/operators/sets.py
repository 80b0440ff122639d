"""Comparison of relations as sets and multisets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_violations(relations: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, missing_from): keys that some of the relations lack. Empty means equal key sets.

    One bit for each relation, united before the shuffle: keys are neither made distinct first nor joined.
    """
    names = sorted(relations)
    tagged = [relations[n].select(*keys, F.lit(1 << i).alias("__in")) for i, n in enumerate(names)]
    found = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.bit_or("__in").alias("__in"))
    missing = F.array_compact(F.array(*(F.when(F.col("__in").bitwiseAND(1 << i) == 0, n) for i, n in enumerate(names))))
    return found.where(F.col("__in") != (1 << len(names)) - 1).select(*keys, missing.alias("missing_from"))


def row_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of either that the other lacks, repeats counted, with side old or new."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))


def changed_fields(old: DataFrame, new: DataFrame, key: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(key, changed, violation): fields that differ for a key in both; those not allowed to are violations."""
    fields = [c for c in old.columns if c != key and c in new.columns]
    o = old.select(key, F.struct(*fields).alias("__old"))
    n = new.select(key, F.struct(*fields).alias("__new"))
    differs = F.array_compact(F.array(*(F.when(~F.col(f"__old.{f}").eqNullSafe(F.col(f"__new.{f}")), f) for f in fields)))
    rows = o.join(n, key).select(key, differs.alias("changed")).where(F.size("changed") > 0)
    return rows.withColumn("violation", F.size(F.array_except("changed", F.array(*map(F.lit, allowed)).cast("array<string>"))) > 0)


def changed_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that are new or whose rows changed."""
    return new.exceptAll(old.select(*new.columns)).select(key).distinct()


def unions(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; the right one's values win."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def same_multiset(a: Column, b: Column) -> Column:
    return F.sort_array(a) == F.sort_array(b)


def relabelled(rows: DataFrame, column: str, rules: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """column set to a rule's name where its relation has the row's key; the first rule wins."""
    for name, ids in reversed(rules.items()):
        marked = ids.select(key).distinct().withColumn("__hit", F.lit(True))
        rows = rows.join(marked, key, "left").withColumn(column, F.when(F.col("__hit"), name).otherwise(F.col(column))).drop("__hit")
    return rows


def replaced_selection(selected: DataFrame, drop: DataFrame, add: DataFrame, size: int, key: str = "id") -> DataFrame:
    """selected without some rows and with others; another size than expected is an error when it is read."""
    rows = selected.join(drop.select(key), key, "left_anti").unionByName(add)
    count = rows.agg(F.count(F.lit(1)).alias("__n"))
    return rows.crossJoin(F.broadcast(count)).where(F.assert_true(F.col("__n") == size, F.lit("the selection has another size")).isNull()).drop("__n")
