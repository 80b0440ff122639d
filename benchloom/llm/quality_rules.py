"""Quality rules: an isolation forest on rule statistics.

Trees split random features at random values; a document that few splits set apart from the rest has a
short path and so a high anomaly score. The forest is fitted on a bounded sample (FIT_ROWS), each tree on
SUBSAMPLE rows of it, as in the method's published form. The threshold comes from all labelled rows: their
scores are counted by label in bins, and the threshold is the bin that best parts the labels among those
that reject at most FALSE_REJECTS of the rows labelled good. Rows that the base rules reject don't count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, documents, drop, stored
from .docstats import FEATURES, sample, statistics

TREES, SUBSAMPLE, FIT_ROWS, SEED = 300, 256, 20_000, 11
BINS, FALSE_REJECTS = 1000, 0.005

#: The statistics that rules are made of; the others of a text depend on its language and length.
RULES = ("symbols", "capitals", "exclamations", "bars", "function_words", "digits", "letters", "distinct_words", "top_word", "duplicate_lines", "repeated_words", "word_length")

_USED = [FEATURES.index(r) for r in RULES]

#: The base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees in flat arrays: feature (-1 at a leaf), cut, left child (the right one follows it), path length at a leaf."""

    def __init__(self, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        self.count, self.subsample, self.rng = trees, subsample, np.random.default_rng(seed)

    def fit(self, x: np.ndarray) -> IsolationForest:
        feature, cut, child, path, self.roots = [], [], [], [], []
        size = min(self.subsample, len(x))
        deepest = int(np.ceil(np.log2(max(2, size))))
        for _ in range(self.count if size else 0):
            self.roots.append(len(feature))
            todo = [(len(feature), x[self.rng.choice(len(x), size, replace=False)], 0)]
            feature.append(-1), cut.append(0.0), child.append(0), path.append(0.0)
            while todo:
                at, rows, depth = todo.pop()
                low, high = rows.min(axis=0), rows.max(axis=0)
                open_ = np.flatnonzero(high > low)
                if depth >= deepest or len(rows) <= 1 or not len(open_):
                    path[at] = depth + float(expected_path(len(rows)))
                    continue
                f = int(self.rng.choice(open_))
                c = float(self.rng.uniform(low[f], high[f]))
                feature[at], cut[at], child[at] = f, c, len(feature)
                for side, part in enumerate((rows[rows[:, f] < c], rows[rows[:, f] >= c])):
                    todo.append((child[at] + side, part, depth + 1))
                    feature.append(-1), cut.append(0.0), child.append(0), path.append(0.0)
        self.feature, self.cut, self.child, self.path = (np.array(v) for v in (feature, cut, child, path))
        self.norm, self.deepest = float(expected_path(max(2, size))), deepest
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path over its expectation: near 1 for anomalies, under 0.5 for the usual."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.deepest):
                f = self.feature[at]
                inner = f >= 0
                at = np.where(inner, self.child[at] + (x[rows, f] >= self.cut[at]), at)
            total += self.path[at]
        return 2.0 ** (-total / max(1, len(self.roots)) / self.norm)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("features")).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)[:, _USED]


def threshold_of(counts: list[tuple[int, int, int]], bins: int = BINS, false_rejects: float = FALSE_REJECTS) -> float:
    """From (bin, label, n): the score at and over which rows are rejected; over 1 if there is nothing to learn from."""
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for b, label, n in counts:
        (good if label == 1 else bad)[b] += n
    if not good.sum() or not bad.sum():
        return 2.0
    over_good, over_bad = (v[::-1].cumsum()[::-1] / v.sum() for v in (good, bad))
    gain = np.where(over_good <= false_rejects, over_bad - over_good, -1.0)
    best = int(gain.argmax())
    return best / bins if gain[best] > 0 else 2.0


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, anomaly, kept), a row for each of docs.

    labels(doc_id, quality): 1 good, 0 bad; other values and null are unlabelled, and of a doc_id labelled
    both ways both count. Without labels of both kinds only the base rules reject. Null text: as empty, so
    base_failed. Repeated rows and rows without a doc_id get a row each and count once in the sample that the forest is fitted on. Empty table: no rows.
    """
    spark = docs.sparkSession
    stats = stored(statistics(documents(docs)), "statistics")
    fit = sample(stats.where("n_words > 0").select("doc_id", "features"), FIT_ROWS, SEED).select("features").toPandas()["features"]
    forest = IsolationForest().fit(np.array(fit.tolist(), dtype=float)[:, _USED]) if len(fit) else None
    shared = spark.sparkContext.broadcast(forest)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        scores = model.score(matrix(batch)) if model else np.zeros(batch.num_rows)
        return batch_of(**{f.name: (batch.column(i), f.type) for i, f in enumerate(batch.schema) if f.name != "features"}, anomaly=(scores, pa.float64()))

    names = [c for c in stats.columns if c != "features"]
    scored = stored(arrow_map(stats, kernel, ", ".join(f"{n} long" for n in names) + ", anomaly double"), "scored")
    drop(spark, stats)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").distinct()
    bins = scored.where(~failed).join(known, "doc_id").groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), "quality").count()
    threshold = threshold_of([(r["bin"], r["quality"], r["count"]) for r in bins.collect()])  # at most 2 * BINS rows
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < F.lit(threshold))).select(*names, "base_failed", "anomaly", "kept")
