"""Removal of repeated passages: seed and extend.

Seeds are winnowed anchors: of the 8-word grams in every 20-word window the one with the least hash, so
that any two equal windows have the same anchor at the same place. Seeds found more than once are joined by hash and
extended both ways, over the windows that they anchor:

1. Seeds whose whole extension (from the first anchored window's start to the last one's end) is the same are one class.
   All but its first occurrence match that one over the whole extension.
2. An anchor with several classes stands in different surroundings. The first occurrence of each class is held against the anchor's
   first occurrence and extended word by word to the left and right as long as both agree; a window inside the match starts earlier.
3. Windows beyond that match can only equal others beyond it. They are compared by their own hash, and all but the first are repeats.

Matches of neighbouring seeds that overlap or touch make up the maximal repeats, of 20 words or more. A window is removed
if, and only if, its word sequence starts somewhere earlier.

Every step is a star from a first occurrence, by minima taken before the shuffle and joins of stored tables: no pairs are
emitted, and the rows at each step are at most the seeds or the windows of a document set.
Words are compared by two independent 64-bit hashes: the first finds, and both must be equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, arrow_map, batch_of, column, documents, drop, gram_hashes, mix, signed, stored, word_hashes

#: Words in a window that must repeat, and in an anchor.
WINDOW, ANCHOR = 20, 8

#: Bits for a gram's place: documents of up to 268 million words.
_PLACE = np.uint64(2**28 - 1)


def seeds(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, first window, windows) for each winnowed anchor of a word sequence."""
    if len(hashes) < window:
        return (np.empty(0, dtype=np.int64),) * 3
    # The least of every window's grams: their hashes' upper bits, and below them the place, so that the first of equals wins.
    grams, span = gram_hashes(hashes, anchor), window - anchor + 1
    least, size = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: size - span], least[span - size :])
    at = (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.diff(np.r_[first, len(at)])


def extended(hashes: np.ndarray, at: np.ndarray, first: np.ndarray, count: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of each seed's extension: the words from its first window's start to its last window's end, and the seed's place."""
    n, base = len(hashes), 0xD6E8FEB86659FD93
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)]) for b in (base, pow(base, -1, 2**64)))
        sums = np.r_[np.uint64(0), np.add.accumulate(hashes * up[:-1])]
        value = (sums[first + count + window - 1] - sums[first]) * down[first]
        return mix(value + (count * 64 + at - first).astype(np.uint64) * np.uint64(base))


def _seed_rows(with_places: bool):
    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners, anchors, extensions, checks, starts, counts, offsets = [], [], [], [], [], [], []
        for row, text in enumerate(column(batch, "text")):
            hashes = word_hashes(text)
            at, first, count = seeds(hashes)
            if len(at):
                anchors.append(gram_hashes(hashes, ANCHOR)[at])
                if with_places:
                    owners.append(np.full(len(at), row))
                    extensions.append(extended(hashes, at, first, count))
                    checks.append(extended(word_hashes(text, 1), at, first, count))
                    starts.append(first)
                    counts.append(count)
                    offsets.append(at - first)
        joined = lambda parts, kind: np.concatenate(parts).astype(kind, copy=False) if parts else np.empty(0, dtype=kind)
        out = {"anchor": (signed(joined(anchors, np.uint64)), pa.int64())}
        if with_places:
            rows = pa.array(joined(owners, np.int64))
            out |= {k: (batch.column(batch.schema.get_field_index(k)).take(rows), pa.int64()) for k in ("doc", "version")}
            out |= {"extension": (signed(joined(extensions, np.uint64)), pa.int64()), "extension_check": (signed(joined(checks, np.uint64)), pa.int64())} | {k: (joined(v, np.int32), pa.int32()) for k, v in (("start", starts), ("count", counts), ("offset", offsets))}
        return batch_of(**out)

    return kernel


def _window_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The hashes of the windows that each listed seed of a document anchors."""
    owners, found, windows, checks = [], [], [], []
    for row, (text, places) in enumerate(zip(column(batch, "text"), column(batch, "places"), strict=True)):
        grams, second = (signed(gram_hashes(word_hashes(text, which), WINDOW)) for which in (0, 1))
        owners += [row] * len(places)
        found += places
        windows += [grams[p["start"] : p["start"] + p["count"]] for p in places]
        checks += [second[p["start"] : p["start"] + p["count"]] for p in places]
    rows = pa.array(owners, type=pa.int64())
    out = {k: (batch.column(batch.schema.get_field_index(k)).take(rows), pa.int64()) for k in ("doc", "version")}
    out |= {k: ([p[k] for p in found], t) for k, t in (("anchor", pa.int64()), ("start", pa.int32()), ("offset", pa.int32()), ("is_hub", pa.bool_()))}
    return batch_of(**out, windows=(windows, pa.list_(pa.int64())), checks=(checks, pa.list_(pa.int64())))


def _cut(batch: pa.RecordBatch, with_text: bool) -> pa.RecordBatch:
    totals, removed, digests, repeats, kept_texts = [], [], [], [], []
    for text, places in zip(column(batch, "text"), column(batch, "places"), strict=True):
        words = text.split()
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        if places:
            first = np.array([p["start"] for p in places])
            count = np.array([p["count"] for p in places])
            np.add.at(gone, first, 1)
            np.add.at(gone, first + count + WINDOW - 1, -1)
        stay = np.cumsum(gone)[:-1] == 0
        kept = b" ".join([words[i] for i in np.flatnonzero(stay)]) if places else b" ".join(words)
        totals.append(len(words))
        removed.append(int(len(words) - stay.sum()))
        digests.append(hashlib.sha256(kept).hexdigest())
        if with_text:
            kept_texts.append(kept.decode())
            edges = np.flatnonzero(np.diff(np.r_[True, stay, True].astype(np.int8)))
            repeats.append([{"start": int(x), "end": int(y)} for x, y in edges.reshape(-1, 2)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    out = {"kept_text": (kept_texts, pa.string()), "repeats": (repeats, kind)} if with_text else {}
    return batch_of(doc_id=(batch.column(batch.schema.get_field_index("doc_id")), pa.int64()), n_words=(totals, pa.int64()), n_removed=(removed, pa.int64()), kept_sha256=(digests, pa.string()), **out)


def surroundings(firsts: DataFrame) -> DataFrame:
    """Of firsts(extension, anchor, first): those whose anchor has several extensions, as (anchor, doc, version, start, count, offset, is_hub)."""
    hubs = firsts.groupBy("anchor").agg(F.min("first").alias("hub"), F.count(F.lit(1)).alias("n"))
    # Stored first, so that the join is between two plain shuffles that Spark can split at a hot anchor.
    hubs = stored(hubs.where("n > 1").select("anchor", "hub"), "hubs")
    out = stored(firsts.join(hubs, "anchor").select("anchor", "first.*", (F.col("first") == F.col("hub")).alias("is_hub")), "classes")
    drop(firsts.sparkSession, hubs)
    return out


def matched(grams: DataFrame) -> DataFrame:
    """grams(doc, version, anchor, start, offset, windows, checks, is_hub) to (doc, version, start, windows, checks, same array<boolean>): every seed but its
    anchor's first, and which of its windows are inside the match with that one."""
    hubs = grams.where("is_hub").select("anchor", F.col("offset").alias("hub_offset"), F.col("windows").alias("hub_windows"), F.col("checks").alias("hub_checks")).dropDuplicates(["anchor"])
    # Stored first, as in surroundings(): a hot anchor's seeds are then split over tasks.
    hubs = stored(hubs, "hubs")
    held = grams.where("not is_hub").join(hubs, "anchor")
    # Equal windows have the anchor at the same place, so that a window faces the first occurrence's window at the same distance from it.
    facing = lambda i: i + F.col("hub_offset") - F.col("offset")
    equal = lambda hub, w, i: F.coalesce(F.get(hub, F.greatest(facing(i), F.lit(0))) == w, F.lit(False))
    same = F.transform("windows", lambda w, i: (facing(i) >= 0) & equal("hub_windows", w, i) & equal("hub_checks", F.get("checks", i), i))
    out = stored(held.select("doc", "version", "start", "windows", "checks", same.alias("same")), "matched")
    drop(grams.sparkSession, hubs)
    return out


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc, version, start, count): runs of windows, `count` from word `start` on, that also start earlier; docs(doc, version, text)."""
    spark = docs.sparkSession
    texts = docs.select("doc", "version", "text")
    anchors = arrow_map(docs.select("text"), _seed_rows(False), "anchor long")
    common = stored(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    found = arrow_map(texts, _seed_rows(True), "anchor long, doc long, version long, extension long, extension_check long, start int, count int, offset int")
    found = stored(found.join(common, "anchor", "left_semi"), "seeds")
    drop(spark, common)
    order = F.struct("doc", "version", "start", "count", "offset")
    firsts = stored(found.groupBy("extension", "extension_check").agg(F.min(order).alias("first"), F.min("anchor").alias("anchor")), "firsts")
    # Seeds that have the extension of an earlier one.
    first = firsts.select("extension", "extension_check", *(F.col("first").getField(c).alias(f"first_{c}") for c in ("doc", "version", "start")))
    is_first = (F.col("doc") == F.col("first_doc")) & (F.col("version") == F.col("first_version")) & (F.col("start") == F.col("first_start"))
    whole = stored(found.select("extension", "extension_check", "doc", "version", "start", "count").join(first, ["extension", "extension_check"]).where(~is_first).select("doc", "version", "start", "count"), "whole")
    drop(spark, found)
    # Anchors in several surroundings: the windows of each class's first occurrence.
    classes = surroundings(firsts)
    drop(spark, firsts)
    places = classes.groupBy("doc", "version").agg(F.collect_list(F.struct("anchor", "start", "count", "offset", "is_hub")).alias("places"))
    grams = arrow_map(texts.join(places, ["doc", "version"]), _window_rows, "doc long, version long, anchor long, start int, offset int, is_hub boolean, windows array<long>, checks array<long>")
    grams = stored(grams, "windows")
    drop(spark, classes)
    held = matched(grams)
    drop(spark, grams)
    at = lambda wanted: F.filter(F.transform("same", lambda s, i: F.when(s == F.lit(wanted), i)), lambda i: i.isNotNull())
    inside = held.select("doc", "version", "start", at(True).alias("at")).where("size(at) > 0")
    inside = inside.select("doc", "version", (F.col("start") + F.col("at")[0]).alias("start"), F.size("at").alias("count"))
    beyond = held.select("doc", "version", "start", "windows", "checks", F.explode(at(False)).alias("i"))
    beyond = stored(beyond.select("doc", "version", (F.col("start") + F.col("i")).alias("start"), F.get("windows", F.col("i")).alias("gram"), F.get("checks", F.col("i")).alias("gram_check")), "beyond")
    # Rows that repeat a doc_id and a text give the same window twice: neither is earlier.
    earliest = beyond.groupBy("gram", "gram_check").agg(F.min(F.struct("doc", "version", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "gram_check", "first")
    later = beyond.join(earliest, ["gram", "gram_check"]).where(F.struct("doc", "version", "start") != F.col("first")).select("doc", "version", "start", F.lit(1).alias("count"))
    out = stored(whole.unionByName(inside).unionByName(later), "repeats")
    drop(spark, whole, held, beyond)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text, repeats]), one row for each row of docs.

    A word goes if a 20-word window that covers it also starts earlier (smaller doc_id, or the same
    document and an earlier start). repeats: the maximal runs of removed words, ends exclusive. Null text: no words. A null
    doc_id counts as the largest. Rows with equal doc_id (or none) and equal text are one document, and each gets its result;
    different texts of one doc_id, or without one, come in the order of xxhash64(text), a signed number. Other columns are left out. Empty table: no rows.
    """
    base = documents(docs, id_col, text_col)
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("version"), F.col("text").cast("binary").alias("text"))
    places = repeated_windows(base).groupBy("doc", "version").agg(F.collect_set(F.struct("start", "count")).alias("places"))
    rows = base.join(places, ["doc", "version"], "left").select("doc_id", "text", "places")
    return arrow_map(rows, lambda batch: _cut(batch, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, repeats array<struct<start:int,end:int>>" * with_text)
