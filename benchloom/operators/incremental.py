"""Resumable and incremental work: only what is new or changed is computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import REUSE_FIELDS, reusable
from .windows import latest


def current_results(log: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """The latest row of each key of an append-only log."""
    return latest(log, [key], order or ["attempt_number"])


def plan(old: DataFrame, new: DataFrame, results: DataFrame, fields: tuple[str, ...] = REUSE_FIELDS, key: str = "id") -> DataFrame:
    """(key, action) for each new row: reuse a finished result whose inputs are equal, rerun a changed row, run a new one."""
    o = old.select(key, F.struct(*fields).alias("o"))
    done = results.where("status in ('completed', 'failed')").select(key, F.lit(True).alias("done"))
    rows = new.select(key, F.struct(*fields).alias("n")).join(o, key, "left").join(done, key, "left")
    action = F.when(F.col("o").isNull(), "run").when(~reusable("o", "n", fields), "rerun").when(F.col("done"), "reuse").otherwise("run")
    return rows.select(key, action.alias("action"))


def invalidated(actions: DataFrame, key: str = "id") -> DataFrame:
    return actions.where("action = 'rerun'").select(key)


def merged_results(old: DataFrame, fresh: DataFrame, actions: DataFrame, key: str = "id") -> DataFrame:
    """Reused results, then fresh ones for the rest."""
    reused = old.join(actions.where("action = 'reuse'").select(key), key, "left_semi")
    return reused.unionByName(fresh.join(actions.where("action <> 'reuse'").select(key), key, "left_semi"), allowMissingColumns=True)


def repair_summary(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(recovered, still_failed, preserved) of a repair of failed rows."""
    a = after.select(key, F.col("status").alias("__after"))
    rows = before.select(key, "status").join(a, key, "left")
    failed = F.col("status") == "failed"
    return rows.agg(F.count_if(failed & (F.col("__after") == "completed")).alias("recovered"), F.count_if(failed & ~F.coalesce(F.col("__after") == "completed", F.lit(False))).alias("still_failed"), F.count_if(~failed & F.col("status").eqNullSafe(F.col("__after"))).alias("preserved"))
