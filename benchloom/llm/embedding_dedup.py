"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction, and a vector passes it if their inner product exceeds a threshold: then it lies in the cap around that direction. Directions are the words of structured random
product codes: a rotated vector is cut into two halves, each half has a code of random unit vectors, and every pair of a codeword of either code is a direction. So a vector is
list-decoded to all exceeding directions from 2 * words inner products: codewords of one half that could exceed with the best of the other are joined, and sums under the
threshold go. There are ROTATIONS codes, each with a rotation of its own, and the threshold is such that a vector passes LIST directions of each.

Vectors meet in the filters that both pass. At a cosine of 0.95 they share some 40 of 80 on average; in a simulation at 64 dimensions none of 1,500 pairs shared fewer than 3.
Equal vectors are one class. Classes close to a common center are a ball: any two of them are linked, which needs no comparison. All others of a filter are compared in tiles, as a
matrix product in double precision, so that a filter of any number of classes is many tasks and makes no pairs: of a tile come each class's number
of links, and a link to the least class of its component in the tile. A pair that meets in several filters counts in the least of them, which the tile sees as it
holds the filters that its classes share with any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.clusters import connected_components
from .common import arrow_map, batch_of, column, components_of, drop, stored, stream
from .tiles import TILE_KEY, tiles, tiles_of
from .vectors import as_doubles, usable

#: Least cosine of a link.
COSINE = 0.95

#: Codes, directions of each that a vector passes on average, vectors of a filter on average (SHARE) if none are alike, and the
#: fewest and most codewords of a half: beyond 1.3 million vectors filters fill in proportion, where results stay whole.
ROTATIONS, LIST, SHARE, FEWEST, MOST = 16, 5, 0.1, 16, 8192

#: Vectors are padded to this many dimensions at least; vectors decoded at once.
DIMS, DECODED, SEED = 16, 256, 42

#: Classes of a filter from which on it has a center, classes that this is the middle of, least cosine of centers that stand for each other, and by how much the cosine
#: to a center must exceed that of half a link's angle.
HOT, MIDDLE, CLOSE, SURE = 64, 32, 0.99, 1e-9


def codewords(n: int) -> int:
    """Codewords of a half for n vectors."""
    return min(MOST, max(FEWEST, math.ceil(math.sqrt(LIST * n / SHARE))))


def threshold(share: float, dims: int) -> float:
    """The inner product with a unit vector that this share of random unit vectors exceeds, by the density (1 - x^2)^((dims - 3) / 2)."""
    x = np.linspace(0, 1, 100_001)
    tail = np.cumsum(((1 - x * x) ** ((dims - 3) / 2))[::-1])[::-1]
    return float(x[np.searchsorted(-tail / tail[0] / 2, -share)])


class Codes:
    """The rotations and codes for vectors of one length."""

    def __init__(self, dims: int, words: int) -> None:
        self.words, self.dims = words, max(DIMS, dims + dims % 2)
        rng = np.random.default_rng([SEED, self.dims, words])
        half = self.dims // 2
        self.rotations = [np.linalg.qr(rng.standard_normal((self.dims, self.dims)))[0] for _ in range(ROTATIONS)]
        self.codes = [[(c / np.linalg.norm(c, axis=1)[:, None]).T.astype("f4") for c in (rng.standard_normal((words, half)), rng.standard_normal((words, half)))] for _ in range(ROTATIONS)]
        # A direction's halves have length 1, so that the whole has sqrt(2).
        self.least = threshold(min(0.5, LIST / words**2), self.dims) * math.sqrt(2)

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """The numbers of all directions that each unit vector passes, in order."""
        half = self.dims // 2
        padded = np.zeros((len(units), self.dims))
        padded[:, : units.shape[1]] = units
        rows, found = [], []
        for r, (rotation, (left, right)) in enumerate(zip(self.rotations, self.codes, strict=True)):
            turned = (padded @ rotation).astype("f4")
            a, b = turned[:, :half] @ left, turned[:, half:] @ right
            at, i = np.nonzero(a >= self.least - b.max(axis=1)[:, None])
            other, j = np.nonzero(b >= self.least - a.max(axis=1)[:, None])
            begin, count = np.searchsorted(other, at, side="left"), np.bincount(other, minlength=len(units))[at]
            left_at = np.repeat(np.arange(len(at)), count)
            right_at = np.arange(len(left_at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
            passed = a[at[left_at], i[left_at]] + b[other[right_at], j[right_at]] >= self.least
            left_at, right_at = left_at[passed], right_at[passed]
            rows.append(at[left_at])
            found.append((r * self.words + i[left_at].astype(np.int64)) * self.words + j[right_at])
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, rows))
        return np.split(found[order], np.cumsum(np.bincount(rows, minlength=len(units)))[:-1])


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Of non-zero vectors; first by the largest component, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def passed_filters(classes: DataFrame, words: int) -> DataFrame:
    """classes(c, embedding) to (c, dims, unit binary, filters array<long>)."""
    codes: dict[int, Codes] = {}

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, vectors = column(batch, "c"), column(batch, "embedding")
        units, filters = [b""] * len(ids), [[]] * len(ids)
        lengths = np.array([len(v) for v in vectors])
        for dims in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == dims)
            if dims not in codes:
                codes[dims] = Codes(dims, words)
            for part in np.array_split(mine, -(-len(mine) // DECODED)):
                unit = unit_vectors(as_doubles([vectors[k] for k in part], dims))
                for k, u, f in zip(part.tolist(), unit, codes[dims].decode(unit), strict=True):
                    units[k], filters[k] = u.astype("<f8").tobytes(), f
        return batch_of(c=(ids, pa.int64()), dims=(lengths.tolist(), pa.int64()), unit=(units, pa.binary()), filters=(filters, pa.list_(pa.int64())))

    return arrow_map(classes.select("c", "embedding"), kernel, "c long, dims long, unit binary, filters array<long>")


def _compared(rows: Iterator[dict]) -> Iterator[dict]:
    """Tiles to (c, links, hub): how many vectors a class is linked to by pairs whose least shared filter is this one, and the least class that it reaches in the tile."""
    for held, wanted in tiles(rows):
        units = np.stack([np.frombuffer(r["unit"], dtype="<f8") for r in held])
        near = (units @ units.T >= COSINE) & wanted
        if not near.any():
            continue
        lists = [np.frombuffer(r["shared"], dtype="<i8") for r in held]
        lists = [f[f < held[0]["key"]] for f in lists]
        first = near
        if known := sorted(set(np.concatenate(lists).tolist())):
            marks = np.zeros((len(held), len(known)), dtype="f4")
            for k, f in enumerate(lists):
                marks[k, np.searchsorted(known, f)] = 1
            first = near & (marks @ marks.T == 0)
        links = first @ np.array([r["weight"] for r in held], dtype=np.int64)
        for k, hub in enumerate(components_of(near).tolist()):
            if links[k] or hub != k:
                yield {"c": held[k]["rep"], "links": int(links[k]), "hub": held[hub]["rep"]}


def _centers(rows: Iterator[dict]) -> Iterator[dict]:
    for (dims, number), some in groupby(rows, key=lambda r: (r["dims"], r["filter"])):
        total = np.sum([np.frombuffer(r["unit"], dtype="<f8") for r in some], axis=0)
        if (length := np.linalg.norm(total)) > 0:
            yield {"dims": dims, "filter": number, "embedding": (total / length).tolist()}


@F.pandas_udf(DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of unit vectors as bytes."""
    return pd.Series([float(np.frombuffer(x, dtype="<f8") @ np.frombuffer(y, dtype="<f8")) for x, y in zip(a, b, strict=True)], dtype="float64")


def balls(shared: DataFrame, decoded: DataFrame, words: int) -> DataFrame:
    """(c, ball): classes within half the angle of a link of a common center, stored. Any two of a ball are linked then, by the triangle inequality.

    Centers are the middle of a few classes of each filter that over HOT classes pass. As those of one group of near copies lie close together, each gives way to the
    first one that passes a filter with it and is close enough. Which centers there are decides only what has to be compared, not what is linked.
    """
    spark = shared.sparkSession
    dense = shared.where(F.col("n") > HOT).select("dims", "filter", "c")
    order = Window.partitionBy("dims", "filter").orderBy(F.xxhash64("c"), "c")
    some = dense.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MIDDLE).join(decoded.select("c", "unit"), "c")
    made = stream(some.repartition("dims", "filter").sortWithinPartitions("dims", "filter"), _centers, "dims long, filter long, embedding array<double>")
    made = stored(made.withColumn("b", F.monotonically_increasing_id()), "centers")
    centers = stored(passed_filters(made.select(F.col("b").alias("c"), "embedding"), words).select(F.col("c").alias("b"), "dims", "unit", "filters"), "decoded")
    met = stored(centers.select("b", "dims", F.explode("filters").alias("met")), "met")
    firsts = stored(met.groupBy("dims", "met").agg(F.min("b").alias("hub")), "firsts")
    pairs = met.join(firsts, ["dims", "met"]).select("b", "hub").distinct().where("hub < b")
    pairs = pairs.join(centers.select("b", F.col("unit").alias("b_unit")), "b").join(centers.select(F.col("b").alias("hub"), F.col("unit").alias("hub_unit")), "hub")
    hubs = pairs.where(cosine("b_unit", "hub_unit") >= CLOSE).groupBy("b").agg(F.min("hub").alias("hub"))
    hubs = stored(made.select("b", "dims", "filter").join(hubs, "b", "left").select("dims", "filter", F.coalesce("hub", "b").alias("hub")), "hubs")
    near = stored(dense.join(hubs, ["dims", "filter"]).select("c", "hub").distinct(), "near")
    held = near.join(decoded.select("c", "unit"), "c").join(centers.select(F.col("b").alias("hub"), F.col("unit").alias("hub_unit")), "hub")
    out = stored(held.where(cosine("unit", "hub_unit") >= math.cos(math.acos(COSINE) / 2) + SURE).groupBy("c").agg(F.min("hub").alias("ball")), "balls")
    drop(spark, made, centers, met, firsts, hubs, near)
    return out


def linked(decoded: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(c, links, hub) from all filters that several classes pass, and from balls; any number of rows for a class.

    decoded: (c, dims, unit, filters); classes: (c, weight).
    """
    spark = decoded.sparkSession
    passed = decoded.select("dims", "c", F.explode("filters").alias("filter"))
    sizes = stored(passed.groupBy("dims", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    shared = stored(passed.join(sizes, ["dims", "filter"]), "shared")
    in_balls = balls(shared, decoded, words)
    # Of a class, the filters that it shares, in order.
    lists = shared.groupBy("c").agg(F.sort_array(F.collect_list("filter")).alias("filters"))

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [np.array(f, dtype="<i8").tobytes() for f in column(batch, "filters")]
        return batch_of(rep=(batch.column(0), pa.int64()), unit=(batch.column(1), pa.binary()), weight=(batch.column(2), pa.int64()), shared=(raw, pa.binary()))

    full = decoded.select("c", "unit").join(classes.select("c", "weight"), "c").join(lists, "c").select(F.col("c").alias("rep"), "unit", "weight", "filters")
    full = stored(arrow_map(full, packed, "rep long, unit binary, weight long, shared binary"), "full")
    # Labels: a ball's number as a negative one, else the class itself.
    label = F.coalesce(-1 - F.col("ball"), F.col("c"))
    rows = stored(shared.join(in_balls, "c", "left").select(F.col("dims").cast("int").alias("table"), F.col("filter").alias("key"), F.col("c").alias("rep"), label.alias("label")), "labelled")
    placed = tiles_of(rows).join(full, "rep").repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    found = stored(stream(placed, _compared, "c long, links long, hub long", most=20_000), "linked")
    whole = stored(in_balls.join(classes.select("c", "weight"), "c"), "members")
    of_ball = whole.groupBy("ball").agg(F.sum("weight").alias("all"), F.min("c").alias("hub"))
    inside = whole.join(of_ball, "ball").select("c", (F.col("all") - F.col("weight")).alias("links"), "hub")
    out = stored(found.unionByName(inside), "links")
    drop(spark, sizes, shared, in_balls, full, rows, found, whole)
    return out


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors; links are pairs with a cosine of COSINE or more.

    component_id is the smallest vec_id reachable over links, itself included; kept: whether that is the row's own. Null and zero vectors and such
    with null or non-finite components have no links and are kept; so are empty vectors. Rows that repeat a vec_id are vectors of their own and link if they are alike. A
    null vec_id is never a component_id unless its component has no other. Vectors of different lengths don't link. Empty table: no rows.
    """
    spark = vectors.sparkSession
    v = F.col(embedding)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable(v) & F.exists(v, lambda x: x != 0), F.transform(v, lambda x: x.cast("double"))).alias("embedding"))
    grouped = rows.where("embedding is not null").groupBy("embedding").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("c"), "*"), "classes")
    words = codewords(classes.count())
    decoded = stored(passed_filters(classes, words), "decoded")
    found = linked(decoded, classes, words)
    drop(spark, decoded)
    labels = connected_components(found.where("c <> hub").select(F.col("c").alias("a"), F.col("hub").alias("b")).distinct())
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    labelled = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").select("c", "embedding", "weight", "least", F.coalesce("label", "c").alias("label"))
    names = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(names, "label").join(links, "c", "left")
    named = stored(named.select("embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "named")
    drop(spark, classes, found, labels)
    own = F.col("embedding").isNull()
    out = rows.join(named.withColumnRenamed("embedding", "same"), F.col("embedding") == F.col("same"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(own, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT n.vec_id, coalesce(n_links, 0) AS n_links, component_id, n.vec_id = component_id AS kept FROM named n LEFT JOIN counted c USING (vec_id)"""
