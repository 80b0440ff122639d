"""Bootstrap intervals over clusters.

Two forms reproduce given generators draw by draw; their input is a table of clusters, aggregated first, of at most
MOST_CLUSTERS rows (checked). The third draws by hashes on the executors and takes any number.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CLUSTERS = 1_000_000


def _bounded(clusters: DataFrame, columns: list[str], order: list[str]) -> np.ndarray:
    rows = clusters.orderBy(*order).select(*(F.col(c).cast("double") for c in columns)).limit(MOST_CLUSTERS + 1).toPandas().to_numpy(dtype=float)
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"over {MOST_CLUSTERS} clusters: use hashed_interval")
    return rows


def ratio_interval(clusters: DataFrame, order: list[str], total: str = "total", size: str = "size", resamples: int = 2000, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(clusters, estimate, low, high) of sum(total) / sum(size), drawing clusters with Python's generator.

    Bounds are the order statistics at int(q * (resamples - 1)). Clusters are drawn by their place in `order`.
    """
    spark, rows = clusters.sparkSession, _bounded(clusters, [total, size], order)
    schema = "clusters long, estimate double, low double, high double"
    if not len(rows):
        return spark.createDataFrame([(0, None, None, None)], schema)
    state = random.Random(seed).getstate()[1]
    generator = np.random.RandomState()
    generator.set_state(("MT19937", np.array(state[:-1], dtype=np.uint32), state[-1]))
    n, samples = len(rows), np.empty(resamples)
    for i in range(resamples):
        sums = rows[(generator.random_sample(n) * n).astype(np.int64)].sum(axis=0)
        samples[i] = sums[0] / sums[1]
    samples.sort()
    bound = lambda q: float(samples[int(q * (resamples - 1))])
    return spark.createDataFrame([(n, float(rows[:, 0].sum() / rows[:, 1].sum()), bound(low), bound(high))], schema)


def mean_intervals(cases: DataFrame, metrics: list[str], order: list[str], resamples: int = 10_000, seed: int = 20261002, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(metric, cases, estimate, low, high) of the metrics' means, drawing cases with numpy's generator; linear quantiles."""
    spark, rows = cases.sparkSession, _bounded(cases, metrics, order)
    schema = "metric string, cases long, estimate double, low double, high double"
    if not len(rows):
        return spark.createDataFrame([(m, 0, None, None, None) for m in metrics], schema)
    generator, n = np.random.default_rng(seed), len(rows)
    means = np.empty((resamples, len(metrics)))
    step = max(1, 4_000_000 // n)
    for at in range(0, resamples, step):  # in blocks, drawn in turn: the same numbers as at once
        means[at : at + step] = rows[generator.integers(0, n, (min(step, resamples - at), n))].mean(axis=1)
    bounds = np.quantile(means, [low, high], axis=0)
    return spark.createDataFrame([(m, n, float(rows[:, k].mean()), float(bounds[0, k]), float(bounds[1, k])) for k, m in enumerate(metrics)], schema)


def hashed_interval(clusters: DataFrame, key: str, total: str = "total", size: str = "size", resamples: int = 200, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The same estimate for any number of clusters: each gets a Poisson(1) weight in every resample, from a hash of its key.

    Sums are taken on the executors; what is shuffled is `resamples` rows for each task.
    """
    cuts, p, acc = [], float(np.exp(-1.0)), 0.0
    for k in range(1, 12):
        acc += p
        cuts.append(acc)
        p /= k
    uniform = (F.xxhash64(F.col(key), F.col("resample"), F.lit(seed)).bitwiseAND(F.lit(2**52 - 1))).cast("double") / float(2**52)
    weight = sum(((uniform >= c).cast("int") for c in cuts), F.lit(0))
    drawn = clusters.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight)
    rates = drawn.groupBy("resample").agg((F.sum(F.col(total) * F.col("w")) / F.sum(F.col(size) * F.col("w"))).alias("rate"))
    bounds = rates.agg(F.percentile("rate", F.lit(low)).alias("low"), F.percentile("rate", F.lit(high)).alias("high"))
    return clusters.agg(F.count(F.lit(1)).alias("clusters"), (F.sum(total) / F.sum(size)).alias("estimate")).crossJoin(bounds)
