"""Hard negatives by a block matrix multiplication in two dimensions.

Anchors and rows are dealt into shards, and each shard's matrix is cut into chunks of dimensions. The block of anchor shard i and chunk k goes to all cells (i, *, k),
the block of row shard j and chunk k to all cells (*, j, k); a cell multiplies its two blocks to a tile of partial scores in whole numbers; the tiles of
(i, j) are shuffled together and added. Nothing but the best few scores of a tile leaves it.

There are two multiplications. The first multiplies anchors by the rows of their own label only and keeps each anchor's best as its positives. Their scores
set the windows in which the second, of anchors by all rows, keeps the best rows of other labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, drop, stored, stream
from .vectors import as_doubles, usable

#: Anchors and rows of a shard on average, dimensions of a chunk: a tile has 4 MB. A score is a whole number of 64 bits.
ANCHORS, ROWS, CHUNK = 512, 1024, 32

#: Components are cut down to multiples of 1 / SCALE. Positives of an anchor, negatives of a positive, and the window's least share of the positive's score in percent.
SCALE, POSITIVES, NEGATIVES, LEAST = 256, 5, 5, 80

#: Squared length from which on scores might not fit into 64 bits.
LONGEST = 2.0**62

TILE = "g long, i long, j long, anchors binary, anchor_ids binary, anchor_labels binary, windows binary, ids binary, labels binary, rows binary, tile binary"


def quantised(vectors: DataFrame, vec_id: str, label: Column, embedding: str) -> DataFrame:
    """(n, vec_id, label, q): usable rows with a number of their own and whole components, as doubles."""
    q = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    rows = vectors.where(usable(F.col(embedding)) & label.isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), q.alias("q"))
    length = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    fits = F.when(length < LONGEST, F.lit(True)).otherwise(F.raise_error(F.lit("a vector is too long for scores of 64 bits")).cast("boolean"))
    return rows.where(fits).select(F.monotonically_increasing_id().alias("n"), "*")


def _int64(values: list) -> bytes:
    return np.array(values, dtype="<i8").tobytes()


def _cut(rows: Iterator[dict]) -> Iterator[dict]:
    """Shards (g, shard, dims, held) to their blocks, one for each chunk of dimensions; rows in order of vec_id."""
    for shard in rows:
        held = sorted(shard["held"], key=lambda r: (NO_ID if r["vec_id"] is None else r["vec_id"], r["n"]))
        matrix = as_doubles([r["q"] for r in held], shard["dims"]).astype("<i8")
        own = {"g": shard["g"], "shard": shard["shard"], "ns": _int64([r["n"] for r in held]), "ids": _int64([NO_ID if r["vec_id"] is None else r["vec_id"] for r in held]), "labels": _int64([r["label"] for r in held])}
        own["windows"] = np.array([[*r["scores"], *[np.iinfo("<i8").min] * (POSITIVES - len(r["scores"]))] for r in held], dtype="<i8").tobytes() if "scores" in held[0] else None
        for k in range(0, max(shard["dims"], 1), CHUNK):
            yield own | {"k": k // CHUNK, "block": np.ascontiguousarray(matrix[:, k : k + CHUNK]).tobytes()}


def blocks(rows: DataFrame, dims: int, scores: bool = False) -> DataFrame:
    """rows(g, shard, n, vec_id, label, q[, scores]) as blocks (g, shard, k, ...). A shard has a bounded number of rows."""
    held = F.struct("n", "vec_id", "label", "q", *(["scores"] if scores else []))
    shards = rows.groupBy("g", "shard").agg(F.collect_list(held).alias("held")).withColumn("dims", F.lit(dims))
    return stream(shards, _cut, "g long, shard long, k long, ns binary, ids binary, labels binary, windows binary, block binary", size=lambda r: len(r["block"]))


def _multiplied(rows: Iterator[dict]) -> Iterator[dict]:
    """Cells to tiles of partial scores."""
    for cell in rows:
        a, b = (np.frombuffer(cell[c], dtype="<i8").reshape(len(cell[n]) // 8, -1) for c, n in (("a_block", "anchors"), ("b_block", "rows")))
        most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * a.shape[1]
        # Doubles hold whole numbers exactly up to 2^53, and multiply matrices many times faster.
        tile = (a.astype("f8") @ b.T.astype("f8")).astype("<i8") if most < 1 << 53 else a @ b.T
        yield {c: cell[c] for c in ("g", "i", "j", "anchors", "anchor_ids", "anchor_labels", "windows", "ids", "labels", "rows")} | {"tile": tile.tobytes()}


def tiles(anchors: DataFrame, rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Partial tiles of anchor blocks by row blocks of the same g, sorted so that those of (g, i, j) follow each other.

    shards: (g, anchor_shards, row_shards). Each block goes to every shard of the other side in its g.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = anchors.join(shards, "g").select("g", F.col("shard").alias("i"), every("row_shards").alias("j"), "k", F.col("ns").alias("anchors"), F.col("ids").alias("anchor_ids"), F.col("labels").alias("anchor_labels"), "windows", F.col("block").alias("a_block"))
    b = rows.join(shards, "g").select("g", F.col("shard").alias("j"), every("anchor_shards").alias("i"), "k", F.col("ns").alias("rows"), "ids", "labels", F.col("block").alias("b_block"))
    parts = stream(a.join(b, ["g", "i", "j", "k"]), _multiplied, TILE, size=lambda r: len(r["tile"]))
    return parts.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def _summed(rows: Iterator[dict]) -> Iterator[tuple[dict, np.ndarray]]:
    """Each whole tile: the sum of its parts, of which one is held at a time."""
    for _, parts in groupby(rows, key=lambda r: (r["g"], r["i"], r["j"])):
        first = next(parts)
        total = np.frombuffer(first["tile"], dtype="<i8").copy()
        for part in parts:
            total += np.frombuffer(part["tile"], dtype="<i8")
        own = {c: np.frombuffer(first[c], dtype="<i8") for c in ("anchors", "anchor_ids", "anchor_labels", "ids", "labels", "rows")}
        own["windows"] = None if first["windows"] is None else np.frombuffer(first["windows"], dtype="<i8").reshape(len(own["anchors"]), -1)
        yield own, total.reshape(len(own["anchors"]), len(own["ids"]))


def _id(value: int) -> int | None:
    return None if value == NO_ID else int(value)


def _nearest(rows: Iterator[dict]) -> Iterator[dict]:
    """The best POSITIVES rows of each tile's anchors, the anchor itself aside."""
    for own, tile in _summed(rows):
        # Columns are in order of vec_id, so that a stable order by score settles ties.
        order = np.argsort(-tile, axis=1, kind="stable")[:, : POSITIVES + 1]
        for a, columns in enumerate(order):
            others = [c for c in columns if own["rows"][c] != own["anchors"][a]][:POSITIVES]
            for c in others:
                yield {"anchor": int(own["anchors"][a]), "score": int(tile[a, c]), "vec_id": _id(own["ids"][c]), "n": int(own["rows"][c])}


def _windowed(rows: Iterator[dict]) -> Iterator[dict]:
    """The best NEGATIVES rows of another label in the window of each of a tile's anchors and positives."""
    for own, tile in _summed(rows):
        order = np.argsort(-tile, axis=1, kind="stable")
        for a in range(len(tile)):
            columns = order[a][own["labels"][order[a]] != own["anchor_labels"][a]]
            scores = tile[a, columns]
            for p, top in enumerate(own["windows"][a]):
                if top == np.iinfo("<i8").min:
                    break
                begin = int(np.searchsorted(-scores, -top, side="left"))
                for c, score in zip(columns[begin : begin + NEGATIVES], scores[begin : begin + NEGATIVES].tolist(), strict=True):
                    if 100 * score >= LEAST * int(top):
                        yield {"anchor": int(own["anchors"][a]), "place": p, "score": score, "vec_id": _id(own["ids"][c]), "n": int(own["rows"][c])}


def best(rows: DataFrame, key: list[str], most: int, name: str) -> DataFrame:
    """The first rows of each key by score, then vec_id, numbered from 1. Spark cuts each task's rows to that many before they are dealt out."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "n")
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def hard_negatives(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", label: Column | str = "label", embedding: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which `anchor` (of vec_id and label) is true.

    A score is the inner product of whole numbers floor(SCALE * x); a shorter vector ends in zeros. Null or non-finite vectors and null labels take no part. A null
    vec_id comes last among equal scores and can be a positive or a negative. Rows that repeat a vec_id are rows of their own, also as anchors, and positives of each
    other. An anchor without positives, or a positive without a row in its window, gives no row. Empty table: no rows. Vectors of a
    squared length of 2^62 or more, in whole numbers, are an error.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, vec_id, F.col(label) if isinstance(label, str) else label, embedding).withColumn("anchor", F.coalesce(anchor, F.lit(False)))
    rows = stored(rows, "rows")
    per_label = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a"), F.max(F.size("q")).alias("dims"))
    per_label = stored(per_label, "labels")
    total = per_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("dims"), F.lit(0)).alias("dims")).first()
    count = lambda n, most: F.ceil(F.col(n) / most).cast("long")
    dealt = lambda shards: F.pmod(F.xxhash64("n"), F.col(shards) if isinstance(shards, str) else F.lit(shards))
    own = per_label.where("a > 0").select(F.col("label").alias("g"), count("a", ANCHORS).alias("anchor_shards"), count("n", ROWS).alias("row_shards"))
    with_label = rows.withColumn("g", F.col("label")).join(own, "g")
    a = blocks(with_label.where("anchor").withColumn("shard", dealt("anchor_shards")), total.dims)
    b = blocks(with_label.withColumn("shard", dealt("row_shards")), total.dims)
    found = stream(tiles(a, b, own), _nearest, "anchor long, score long, vec_id long, n long")
    positives = stored(best(found, ["anchor"], POSITIVES, "place").withColumn("place", F.col("place") - 1), "positives")
    windows = positives.groupBy(F.col("anchor").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    n = windows.count()
    shards = spark.range(1).select(F.col("id").alias("g"), F.lit(-(-n // ANCHORS)).cast("long").alias("anchor_shards"), F.lit(-(-total.n // ROWS)).cast("long").alias("row_shards")).where("anchor_shards > 0")
    g = F.lit(0).cast("long").alias("g")
    searching = rows.where("anchor").join(windows, "n").select(g, dealt(max(1, -(-n // ANCHORS))).alias("shard"), "n", "vec_id", "label", "q", "scores")
    a = blocks(searching, total.dims, scores=True)
    b = blocks(rows.select(g, dealt(max(1, -(-total.n // ROWS))).alias("shard"), "n", "vec_id", "label", "q"), total.dims)
    found = stream(tiles(a, b, shards), _windowed, "anchor long, place int, score long, vec_id long, n long")
    negatives = best(found, ["anchor", "place"], NEGATIVES, "rank")
    pairs = negatives.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = pairs.join(positives.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "place"])
    names = rows.where("anchor").select(F.col("n").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    drop(spark, per_label)
    return pairs.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The query's anchors, and its labels with noise put into them.
ANCHOR = "vec_id % 100 = 0"


def noisy_label() -> Column:
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""
