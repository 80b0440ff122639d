"""All pairs of different labels in the entries of a table, in tiles of bounded size: an entry of any number of rows is many tasks and makes no pairs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import by_shuffle

#: Rows of a tile's part on average, what tells tiles apart.
TILE, TILE_KEY = 256, ("table", "key", "kind", "lo", "hi")


def tiles_of(rows: DataFrame) -> DataFrame:
    """rows(table, key, rep, label) of entries that hold several components, dealt into tiles: (table, key, kind, lo, hi, part, rep, label).

    Only classes of different components need to be held against each other. So an entry's largest component and its other classes are each dealt into parts
    of about TILE; a tile holds a part of either (kind 0) or two parts of the others, or one with itself (kind 1).
    """
    entry = ["table", "key"]
    sizes = rows.groupBy(*entry, "label").agg(F.count(F.lit(1)).alias("n")).groupBy(*entry)
    mixed = sizes.agg(F.max(F.struct("n", "label")).alias("lead"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
    held = rows.join(by_shuffle(mixed), entry)
    first, others = (F.ceil(F.col(c) / TILE).cast("long") for c in ("lead.n", "outside"))
    is_first = F.col("label") == F.col("lead.label")
    part = F.pmod(F.xxhash64("rep"), F.when(is_first, first).otherwise(others))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    tile = lambda kind, lo, hi, part: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), part.alias("part"))
    own, far = F.col("own"), F.lit(-1).cast("long")
    of_first = F.transform(upto(others), lambda j: tile(0, own, j, far))
    of_others = F.concat(F.transform(upto(first), lambda i: tile(0, i, own, own)), F.transform(upto(others), lambda j: tile(1, F.least(own, j), F.greatest(own, j), own)))
    placed = held.withColumn("own", part).select(*entry, "rep", "label", F.explode(F.when(is_first, of_first).otherwise(of_others)).alias("tile"))
    return placed.select(*entry, "tile.*", "rep", "label")


def tiles(rows: Iterator[dict]) -> Iterator[tuple[list[dict], np.ndarray]]:
    """The rows of each tile, and which pairs of them it is to compare: of different labels, and of its two parts if it has two."""
    for (*_, kind, lo, hi), held in groupby(rows, key=lambda r: tuple(r[c] for c in TILE_KEY)):
        held = sorted(held, key=lambda r: (r["part"], r["rep"]))
        part, label = (np.array([r[c] for r in held]) for c in ("part", "label"))
        wanted = label[:, None] != label[None, :]
        if kind == 0 or lo != hi:
            wanted &= part[:, None] != part[None, :]
        if wanted.any():
            yield held, wanted
