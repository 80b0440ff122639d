"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are cut into at most BINS bins at their quantiles; trees grow level by level on histograms of
gradients. A tree is a complete binary tree in flat arrays, so a batch of rows walks down it with one
numpy step for each level. Fitted on at most FIT_ROWS labelled rows, chosen by a hash of doc_id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import arrow_map, batch_of, column, documents, drop, prepare, stored
from .docstats import measure, sample, statistics

FIT_ROWS, SEED = 20_000, 5
ROUNDS, DEPTH, BINS, RATE, LAMBDA, LEAST = 120, 4, 64, 0.1, 1.0, 5.0

#: A row is held out if crc32 of its doc_id as text leaves 0 here; a score of CUT or more is predicted good.
FOLDS, CUT = 5, 0.3


class BoostedTrees:
    """Logistic gradient boosting on binned features."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE):
        self.rounds, self.depth, self.bins, self.rate = rounds, depth, bins, rate
        self.base, self.edges = 0.0, []
        self.feature = self.cut = self.leaf = np.empty((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape if x.ndim == 2 else (0, 0)
        share = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(share / (1 - share)))
        if not n or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.rounds, inner), dtype=np.int64)
        self.cut = np.full((self.rounds, inner), np.inf)
        self.leaf = np.zeros((self.rounds, leaves))
        raw = np.full(n, self.base)
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            at = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                nodes, first = 2**level, 2**level - 1
                best = np.full(nodes, 1e-6)
                chosen = [(0, None)] * nodes
                for f in range(width):
                    key = at * self.bins + binned[:, f]
                    gs = np.bincount(key, g, nodes * self.bins).reshape(nodes, -1).cumsum(axis=1)
                    hs = np.bincount(key, h, nodes * self.bins).reshape(nodes, -1).cumsum(axis=1)
                    ga, ha = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + LAMBDA) + (ga - gs) ** 2 / (ha - hs + LAMBDA) - ga**2 / (ha + LAMBDA)
                    gain[(hs < LEAST / 4) | (ha - hs < LEAST / 4)] = -1
                    gain = gain[:, : len(self.edges[f])]
                    if not gain.shape[1]:
                        continue
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(nodes), top]
                    for k in np.flatnonzero(value > best):
                        best[k], chosen[k] = value[k], (f, int(top[k]))
                step = np.zeros(n, dtype=np.int64)
                for k, (f, b) in enumerate(chosen):
                    if b is not None:
                        self.feature[t, first + k], self.cut[t, first + k] = f, self.edges[f][b]
                        mine = at == k
                        step[mine] = binned[mine, f] > b
                at = 2 * at + step
            gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
            self.leaf[t] = self.rate * gs / (hs + LAMBDA)
            raw += self.leaf[t][at]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= cut[at])
            raw += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-raw))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> BoostedTrees:
    """A model from at most fit_rows distinct rows that aren't held out; `labels` may name a doc_id twice, each counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    known = sample(known.where(~held_out(F.col("doc_id"))).distinct(), fit_rows, SEED)
    known = stored(known, "known")
    rows = documents(docs).join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")  # at most fit_rows numbers
    # A doc_id can have any number of rows: they are bounded once more, where they have their labels.
    labelled = stored(statistics(rows).join(known, "doc_id").select("doc_id", "features", "quality"), "labelled")
    features = sample(labelled, fit_rows, SEED).orderBy("doc_id", "quality").select("features", "quality").toPandas()
    drop(docs.sparkSession, known, labelled)
    x = np.array(features["features"].tolist(), dtype=float)
    return BoostedTrees().fit(x, features["quality"].to_numpy(dtype=float))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each of docs.

    Null text: as empty, and scored. Null doc_id: not held out. Without labels of both kinds every
    score is the share of good labels (0.5 if there are none). Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = column(batch, "doc_id")
        scores = shared.value.score(np.array([measure(t)[1] for t in column(batch, "text")], dtype=float))
        held = [d is not None and zlib.crc32(str(d).encode()) % FOLDS == 0 for d in ids]
        return batch_of(doc_id=(ids, pa.int64()), held_out=(held, pa.bool_()), score=(scores, pa.float64()), predicted=((scores >= CUT).astype(np.int32), pa.int32()))

    return arrow_map(documents(docs), kernel, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, columns as they were: each row is judged where it lies, without a shuffle.

    Null text: judged as empty. Rows without a doc_id and repeated rows are judged by their text like others. Without labels of both kinds
    every score is the share of good labels, so that all rows stay unless that share is under CUT. Empty table: no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))

    @F.pandas_udf(BooleanType())
    def is_good(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([measure(t or "")[1] for t in texts], dtype=float)) >= CUT)

    return docs.where(is_good(F.col(text_col).cast("string")))
