"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits in two segments of 32, and each segment has a table from its value to the fingerprints that have it.
Of two fingerprints within 2 bits either the first segments are within 1 bit, or the second ones are equal: so a
fingerprint looks up the ball of radius 1 around its first segment (33 values) and its second segment itself, fetches what the tables
hold there, and verifies the whole distance.

Entries of a table can hold any number of fingerprints, as of thousands of near copies. What is in an entry of over HOT fingerprints is
indexed again by segments of its other bits, 2 of 16 and then 2 of 8, and a probe goes on there with the bits that it has left to
differ in. An entry of the last level holds at most 256 fingerprints, whatever the data: nothing is capped.

`near_duplicates` looks for texts whose five-word shingles have a similarity of 0.8 or more. Their
fingerprints differ in 4 to 14 bits, too many for small balls (README), so that to the fingerprints' links
it adds index tables over the segments (bands) of a MinHash signature of the same shingles. The whole
signatures only sort out what is far from similar; the rest is verified on whole sets of shingles.

There, an entry's classes are held against its first one. In entries that still hold several components every two classes of
different components are compared, in tiles: entries of thousands of texts on one template make many tiles, and no pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.clusters import connected_components
from .common import LOWER, arrow_map, batch_of, by_shuffle, column, components_of, documents, drop, stored, stream
from .tiles import TILE_KEY, tiles, tiles_of

#: Bits of a fingerprint, bits in which linked ones may differ, fingerprints in an entry from which on it is indexed again.
BITS, RADIUS, HOT, SEED = 64, 2, 64, 42

#: Near duplicates: words a shingle, least similarity, bands of a signature and values in a band. A pair at
#: 0.8 meets in a band with probability 1 - (1 - 0.8^6)^32 = 0.9999; the standard error of an
#: estimate at 0.8 is sqrt(0.8 * 0.2 / 192) = 0.029. Candidates are verified exactly unless their estimate is
#: more than SLACK (5 standard errors) under the similarity.
SHINGLE, SIMILARITY, BANDS, ROWS, SLACK = 5, 0.8, 32, 6, 0.15

#: Columns of an incidence matrix held at once.
COLUMNS = 4096


def votes(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes: a bit is set if it is in over half of them."""
    if not len(hashes):
        return 0
    count = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * count > len(hashes)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every `size`-word shingle, repeats included; fewer words: of the whole sequence; none: empty."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(words) - size + 1)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; a null or blank text has fingerprint 0."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [votes(shingle_hashes(t, shingle)) for t in column(batch, "text")]
        return batch_of(doc_id=(batch.column(0), pa.int64()), fp=(fps, pa.int64()))

    rows = documents(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, kernel, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def segments(level: int) -> list[tuple[int, int]]:
    """(bits already fixed, bits of the segment) of each table of a level, as masks.

    Level 0 has the two halves of all bits. Each table's other bits are halved again for the tables of the next level.
    """
    if not level:
        return [(0, (1 << BITS // 2) - 1), (0, (1 << BITS) - (1 << BITS // 2))]
    out = []
    for fixed, own in segments(level - 1):
        free = [b for b in range(BITS) if not (fixed | own) >> b & 1]
        halves = free[: len(free) // 2], free[len(free) // 2 :]
        out += [(fixed | own, sum(1 << b for b in half)) for half in halves]
    return out


def ball(own: int, radius: int) -> list[int]:
    """0, and with radius 1 every one-bit mask of a segment, as signed numbers."""
    return [0] + [_signed(1 << b) for b in range(BITS) if radius and own >> b & 1]


def table_rows(rows: DataFrame, level: int, parents: bool) -> DataFrame:
    """rows(fp, rep[, table]) as rows of the level's tables: (fp, rep, table, key). With parents, of the children of their table."""
    at = [F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(fixed | own))).alias("key")) for t, (fixed, own) in enumerate(segments(level))]
    mine = F.array(*at)
    if parents:
        mine = F.filter(mine, lambda x: F.shiftright(x["table"], 1) == F.col("table"))
    return rows.select("fp", "rep", F.explode(mine).alias("at")).select("fp", "rep", "at.*")


def probes(rows: DataFrame, level: int, parents: bool) -> DataFrame:
    """rows(fp, rep[, table, flip, left]) to their lookups (fp, rep, table, key, flip, left) in the level's tables.

    left: bits that may still differ outside of what the key holds; flip: the bits in which the key differs. Of two segments that differ in
    `left` bits together, with 2 left the first is within 1 or the second is equal; with 1 left either is equal.
    """
    left, flip = (F.col("left"), F.col("flip")) if parents else (F.lit(RADIUS), F.lit(0).cast("long"))
    lookups = []
    for t, (fixed, own) in enumerate(segments(level)):
        for mask in ball(own, 1 - t % 2):
            wanted = (left == RADIUS) if mask else F.lit(True)
            if parents:
                wanted = wanted & (F.col("table") == t // 2)
            used = flip.bitwiseXOR(F.lit(mask))
            lookup = F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseXOR(used).bitwiseAND(F.lit(_signed(fixed | own))).alias("key"), used.alias("flip"), (left - (1 if mask else 0)).alias("left"))
            lookups.append(F.when(wanted, lookup))
    made = rows.select("fp", "rep", F.explode(F.filter(F.array(*lookups), lambda x: x.isNotNull())).alias("at"))
    return made.select("fp", "rep", "at.*")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def verified(lookups: DataFrame, entries: DataFrame) -> DataFrame:
    """(a, bit, b): of all fingerprints fetched within RADIUS bits of a's and differing from it in this bit, the least rep b.

    Fingerprints that are one bit from the same value are all within 2 bits of each other, and each of them meets all others of them
    under the bit that parts it from that value. So the least ones hold such a clique together, and a fingerprint of thousands of
    neighbours gives at most 64 rows.
    """
    fetched = lookups.select("table", "key", "fp", "rep").join(by_shuffle(entries.select("table", "key", F.col("fp").alias("other"), F.col("rep").alias("b"))), ["table", "key"])
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    near = fetched.where((F.col("fp") != F.col("other")) & (distance(F.col("fp"), F.col("other")) <= RADIUS)).select("rep", "b", differ.alias("differ"))
    # The least number is its own negative, which ANSI arithmetic refuses.
    low = F.col("differ").bitwiseAND(F.coalesce(F.try_subtract(F.lit(0), F.col("differ")), F.col("differ")))
    bits = F.array_distinct(F.array(low, F.when(low == F.col("differ"), low).otherwise(F.col("differ").bitwiseXOR(low))))
    return near.select(F.col("rep").alias("a"), F.explode(bits).alias("bit"), "b").groupBy("a", "bit").agg(F.min("b").alias("b"))


def near_links(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links of classes(fp long, rep long), one row for each fp, that join all fingerprints within RADIUS bits."""
    spark = classes.sparkSession
    levels = 3
    held, asked, parents = classes, classes, False
    found = []
    for level in range(levels):
        entries, lookups = table_rows(held, level, parents), probes(asked, level, parents)
        crowded = None
        if level + 1 < levels:
            crowded = stored(entries.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("table", "key"), "crowded")
            if not crowded.take(1):
                drop(spark, crowded)
                crowded = None
        cold = entries.join(by_shuffle(crowded), ["table", "key"], "left_anti") if crowded is not None else entries
        found.append(stored(verified(lookups, cold), "links"))
        if crowded is None:
            break
        held, asked = (stored(rows.join(by_shuffle(crowded), ["table", "key"], "left_semi"), "crowded") for rows in (entries, lookups))
        parents = True
    return reduce(DataFrame.unionByName, found).select("a", "b").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id), one row for each row of docs.

    component_id is the smallest doc_id reachable over links of 2 bits or fewer. Rows with equal
    doc_id are one node. A null doc_id takes its fingerprint's component and is never one (null if
    nothing else has that fingerprint). Null text: as empty. Empty table: no rows.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    labels = connected_components(near_links(classes.where("rep is not null")))
    named = stored(classes.join(by_shuffle(labels), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("label", "rep").alias("component_id")), "named")
    drop(docs.sparkSession, classes, labels)
    return prints.join(by_shuffle(named), "fp", "left").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_key(text: bytes) -> bytes:
    """A hash of 128 bits of the lower-cased words: texts with the same one count as equal."""
    return xxhash.xxh3_128_digest(b" ".join(text.translate(LOWER).split()), SEED)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp, bands array<long>, signature binary) for every row.

    bands: a hash of the least of the shingles' hashes under each of BANDS * ROWS permutations, ROWS of them in a band; signature: a byte
    of each of these least hashes; fp: the shingles' SimHash; text_key: a hash of the lower-cased words.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rng, size = np.random.default_rng(SEED), BANDS * ROWS
        odd, add = rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, size, dtype=np.uint64)
        keys, fps, bands, signatures = [], [], [], []
        for text in column(batch, "text"):
            keys.append(text_key(text))
            hashes = shingle_hashes(text, shingle)
            fps.append(votes(hashes))
            least = np.full(size, 2**64 - 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for at in range(0, len(hashes), 400):
                    np.minimum(least, (hashes[at : at + 400, None] * odd + add).min(axis=0), out=least)
            values = (least >> np.uint64(32)).astype("<u4")
            signatures.append(values.astype(np.uint8).tobytes())
            raw = values.tobytes()
            digests = np.array([xxhash.xxh64_intdigest(raw[at : at + 4 * ROWS], b) for b, at in enumerate(range(0, 4 * size, 4 * ROWS))], dtype=np.uint64)
            bands.append(digests.view(np.int64))
        return batch_of(doc_id=(batch.column(0), pa.int64()), text_key=(keys, pa.binary()), fp=(fps, pa.int64()), bands=(bands, pa.list_(pa.int64())), signature=(signatures, pa.binary()))

    rows = documents(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, kernel, "doc_id long, text_key binary, fp long, bands array<long>, signature binary")


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """From the share of places where two signatures agree an unbiased estimate of the shingles' similarity: unlike hashes share a byte once in 256."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series(((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256))


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(rep, shingles binary): the sorted distinct hashes of all shingles of the text of wanted(rep, text_key); one row for each rep."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, t) for i, k, t in zip(column(batch, "rep"), column(batch, "text_key"), column(batch, "text"), strict=True) if text_key(t) == k]
        sets = [np.unique(shingle_hashes(t, shingle)).astype("<u8").tobytes() for _, t in rows]
        return batch_of(rep=([i for i, _ in rows], pa.int64()), shingles=(sets, pa.binary()))

    rows = documents(docs).join(by_shuffle(wanted), F.col("doc_id") == F.col("rep")).select("rep", "text_key", F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, kernel, "rep long, shingles binary").dropDuplicates(["rep"])


@F.pandas_udf(DoubleType())
def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """The similarity of two sets that are given as sorted distinct hashes; of two empty sets 1."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0)
    return pd.Series(out, dtype="float64")


def similar(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs(a, b) whose texts have sets of shingles of that similarity or more, stored. reps: (rep, text_key, signature)."""
    spark = docs.sparkSession
    left = reps.select(F.col("rep").alias("a"), F.col("signature").alias("signature_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("signature").alias("signature_b"))
    held = stored(pairs.join(by_shuffle(left), "a"), "held")
    near = stored(held.join(by_shuffle(right), "b").where(agreement("signature_a", "signature_b") >= similarity - SLACK).select("a", "b"), "near")
    drop(spark, held)
    if not near.take(1):
        return near
    ends = near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct()
    sets = stored(shingle_sets(docs, reps.select("rep", "text_key").join(by_shuffle(ends), "rep"), shingle), "sets")
    held = stored(near.join(by_shuffle(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("shingles_a"))), "a"), "held")
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("shingles_b"))
    links = stored(held.join(by_shuffle(right), "b").where(jaccard("shingles_a", "shingles_b") >= similarity).select("a", "b"), "verified")
    drop(spark, near, sets, held)
    return links


def _may_be_similar(least: float) -> Callable[[Iterator[dict]], Iterator[dict]]:
    def kernel(rows: Iterator[dict]) -> Iterator[dict]:
        for held, wanted in tiles(rows):
            signatures = np.frombuffer(b"".join(r["signature"] for r in held), dtype=np.uint8).reshape(len(held), -1)
            keep = np.zeros(len(held), dtype=bool)
            for k in range(len(held)):
                share = ((signatures[k + 1 :] == signatures[k]).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                mates = np.flatnonzero(wanted[k, k + 1 :] & (share >= least)) + k + 1
                keep[mates] = True
                keep[k] |= len(mates) > 0
            for k in np.flatnonzero(keep):
                yield {c: held[k][c] for c in (*TILE_KEY, "part", "rep", "label")}

    return kernel


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements every two of these sets of distinct numbers share: a product of their incidence matrix, some columns at a time."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    often = np.bincount(column, minlength=len(values)) > 1  # what one set alone has, no two share
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        marks = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        marks[row[a:b], column[a:b] - at] = 1
        out += marks @ marks.T
    return out


def _joined_by_similarity(similarity: float) -> Callable[[Iterator[dict]], Iterator[dict]]:
    def kernel(rows: Iterator[dict]) -> Iterator[dict]:
        for held, wanted in tiles(rows):
            sets = [np.frombuffer(r["shingles"], dtype="<u8") for r in held]
            sizes = np.array([len(s) for s in sets], dtype=float)
            both = overlaps(sets).astype(float)
            either = sizes[:, None] + sizes[None, :] - both
            near = wanted & (np.divide(both, either, out=np.ones_like(both), where=either > 0) >= similarity)
            for k, hub in enumerate(components_of(near).tolist()):
                if hub != k:
                    yield {"a": held[k]["rep"], "b": held[hub]["rep"]}

    return kernel


def links_across(rows: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links that join all classes of different components which share an entry of rows(table, key, rep, label) and are similar, stored.

    Every such pair is compared, in tiles, so that entries of any number of classes make no pairs: first by their signatures, which drops classes without any
    likely partner in the tile, then by their whole sets of shingles. Of a tile come links from each class to the first of its component there.
    reps: (rep, text_key, signature).
    """
    spark = docs.sparkSession
    shape = "table int, key long, kind int, lo long, hi long, part long, rep long, label long"
    placed = tiles_of(rows).join(by_shuffle(reps.select("rep", "signature")), "rep").repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    likely = stored(stream(placed, _may_be_similar(similarity - SLACK), shape, most=10_000), "likely")
    sets = stored(shingle_sets(docs, reps.select("rep", "text_key").join(by_shuffle(likely.select("rep").distinct()), "rep"), shingle), "sets")
    placed = likely.join(by_shuffle(sets), "rep").repartition(*TILE_KEY).sortWithinPartitions(*TILE_KEY)
    links = stored(stream(placed, _joined_by_similarity(similarity), "a long, b long", most=10_000).distinct(), "across")
    drop(spark, likely, sets)
    return links


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, component_id): exact and near copies share the smallest doc_id they reach.

    Texts with the same lower-cased words are one class, whose smallest doc_id stands for it. Classes
    are linked if they meet in an entry of a table and the sets of their shingles have a similarity (Jaccard) of
    `similarity` or more. In an entry each class is first held against the entry's first class, so that a hot entry makes no
    pairs; entries of even bands are in the order of doc_id (an original mostly comes before its copies), those of
    odd bands in an order of their own. Classes of different components that share an entry are then held against each other
    (`links_across`), so that an unlike first class hides no link. Blank and null texts are one class. A null doc_id takes its class's component.
    """
    spark = docs.sparkSession
    sketched = stored(sketches(docs, shingle), "sketches")
    keys = stored(sketched.select("doc_id", "text_key"), "keys")
    classes = stored(keys.where("doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("rep")), "classes")
    # The rows of a class's smallest doc_id have one text: one of them is kept, where the join has brought them together.
    reps = sketched.join(by_shuffle(classes.select(F.col("text_key").alias("key"), "rep")), (F.col("text_key") == F.col("key")) & (F.col("doc_id") == F.col("rep")))
    reps = stored(reps.dropDuplicates(["key", "rep"]).select("rep", "text_key", "fp", "bands", "signature"), "reps")
    drop(spark, sketched)
    prints = stored(reps.groupBy("fp").agg(F.min("rep").alias("hub")), "fingerprints")
    by_print = near_links(prints.select("fp", F.col("hub").alias("rep")))
    same_print = reps.select("fp", "rep").join(by_shuffle(prints), "fp").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    members = reps.select("rep", F.posexplode("bands").alias("table", "key"))
    # The first class of each entry that several share; both sides of the join are stored or scanned, so that Spark can split a hot entry.
    order = F.struct(F.when(F.col("table") % 2 == 0, F.col("rep")).otherwise(F.xxhash64("rep", "table")).alias("order"), "rep")
    hubs = stored(members.groupBy("table", "key").agg(F.min(order).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("table", "key", F.col("hub.rep").alias("hub")), "hubs")
    shared = stored(members.join(by_shuffle(hubs), ["table", "key"]), "shared")
    pairs = shared.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    pairs = pairs.unionByName(by_print).unionByName(same_print).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, "candidates")
    links = similar(pairs, reps, docs, shingle, similarity)
    drop(spark, prints, hubs, pairs)
    labels = connected_components(links)
    rows = shared.join(by_shuffle(labels), F.col("rep") == F.col("node"), "left").select("table", "key", "rep", F.coalesce("label", "rep").alias("label"))
    rows = stored(rows, "labelled")
    more = links_across(rows, reps, docs, shingle, similarity)
    drop(spark, shared, rows)
    if more.take(1):
        drop(spark, labels)
        labels = connected_components(links.unionByName(more))
    named = stored(classes.join(by_shuffle(labels), F.col("rep") == F.col("node"), "left").select("text_key", F.coalesce("label", "rep").alias("component_id")), "named")
    drop(spark, classes, reps, links, more, labels)
    return keys.join(by_shuffle(named), "text_key", "left")


def keep_one(docs: DataFrame, **options: float) -> DataFrame:
    """docs without all but the row with the smallest doc_id of each near-duplicate component; columns as they were.

    Of rows that repeat that doc_id one stays. Rows with a null doc_id can't be told apart by it and all stay. Null and blank
    texts are copies of each other. Columns of docs can have any names. Empty table: no rows.
    """
    found = near_duplicates(docs, **options)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    # All columns travel in one struct, so that none can clash with a name used here.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("kept"))
    named = own.where("kept is not null").join(by_shuffle(kept), "kept", "left_semi").dropDuplicates(["kept"])
    return named.unionByName(own.where("kept is null")).select("row.*")
