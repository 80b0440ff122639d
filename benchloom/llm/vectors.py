"""What the operators on embeddings share: which vectors count, and components as bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """False for null vectors and such with a null or non-finite component."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad, F.lit(False))


def as_doubles(vectors: list[list[float]], dims: int) -> np.ndarray:
    """A row for each vector; shorter ones end in zeros."""
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out
