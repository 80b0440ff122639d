"""Connected components over links between rows, by hooking and shortcutting labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import by_shuffle, drop, stored

#: Rounds before giving up; labels at least halve their distance to the root in each.
MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label): for each node of links(a long, b long), the smallest node it reaches.

    Each round reads stored tables only, so every join is between two plain shuffles that Spark can
    split at a hot node, and every minimum is taken before the shuffle first. Empty links: no rows.
    Links with a null end or from a node to itself are left out.
    """
    spark = links.sparkSession
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    both = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        seen = stored(both.join(by_shuffle(near), "b").groupBy("a").agg(F.min("near").alias("near")), "seen")
        own = labels.join(by_shuffle(seen.withColumnRenamed("a", "node")), "node").select("node", "label", F.least("label", "near").alias("least"))
        own = stored(own, "own")
        # A node takes its neighbours' least label, and so does the root that it pointed at.
        hooks = own.select("node", "least").unionByName(own.select(F.col("label").alias("node"), "least"))
        hooked = stored(hooks.groupBy("node").agg(F.min("least").alias("up")), "hooked")
        # Then it takes the label of its label.
        over = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = stored(hooked.join(by_shuffle(over), "up", "left").select("node", F.coalesce("top", "up").alias("label")), "labels")
        changed = new.join(by_shuffle(labels.withColumnRenamed("label", "old")), "node").where("label <> old").limit(1).count()
        drop(spark, labels, seen, own, hooked)
        labels = new
        if not changed:
            drop(spark, both)
            return labels
    raise RuntimeError(f"labels still change after {MAX_ROUNDS} rounds")


def components_of_keys(rows: DataFrame, node: str, keys: str) -> DataFrame:
    """(node, component): nodes that share any element of an array column, directly or through others.

    Each key links its nodes to its smallest one, so that a key of many nodes makes as many links and no pairs.
    Nodes are numbered by the caller (long); those without keys are components of their own.
    """
    pairs = rows.select(F.col(node).alias("a"), F.explode(keys).alias("key")).distinct()
    hubs = stored(pairs.groupBy("key").agg(F.min("a").alias("b")), "hubs")
    labels = connected_components(pairs.join(by_shuffle(hubs), "key").select("a", "b"))
    drop(rows.sparkSession, hubs)
    return rows.select(node).distinct().join(by_shuffle(labels.withColumnRenamed("node", node)), node, "left").select(node, F.coalesce("label", node).alias("component"))
