"""Benchmark decontamination: pigeonhole edit matching.

A test item of n words may be edited in e = floor(RATE * n) words (none if it has under LEAST_WORDS words: short phrases match as they are). Cut into e + 1 pieces, at least one piece of it
is untouched in any passage within that budget. Piece hits are found exactly, by an Aho-Corasick pass over the
document's words; around each hit the whole item is compared with Myers' bit-parallel edit distance over
words, free at both ends of the passage. In scripts without blanks each character is a word.

The items are a stated query set. They are taken in blocks of about BLOCK_BYTES of text (more only for a single item that is longer),
each sent to all executors and held against all documents, so that a task's memory doesn't grow with the benchmark.
"""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import arrow_map, batch_of, column, documents, prepare

#: Edited words allowed for each word of an item; words under which an item has to be found as it is; bytes of a block.
RATE, LEAST_WORDS, BLOCK_BYTES = 0.2, 8, 4_000_000

_BREAKS = re.compile(r"[\W_]+")

# Blocks of scripts that are written without blanks (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Chinese characters).
_UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def normal(text: str) -> str:
    """Small letters and digits; whatever stands between words becomes one blank, and characters of unspaced scripts are words."""
    return _BREAKS.sub(" ", _UNSPACED.sub(r" \1 ", text.lower())).strip()


def budget(words: int, rate: float = RATE, least: int = LEAST_WORDS) -> int:
    return int(rate * words + 1e-9) if words >= least else 0


def pieces(words: list[str], edits: int) -> list[tuple[int, list[str]]]:
    """(place, words) of each of edits + 1 pieces, as even as can be."""
    parts = edits + 1
    cuts = [i * len(words) // parts for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(pattern: list[str], text: list[str]) -> int:
    """The least edit distance of pattern to any run of text, by Myers' bit-parallel recurrence over words."""
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score = full, 0, len(pattern)
    best = score
    for w in text:
        equal = masks.get(w, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(across | plus)), plus & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        best = min(best, score)
    return best


class Matcher:
    """Finds items in a text: {item: least distance} for those within their budget."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, least: int = LEAST_WORDS):
        self.items: dict[int, tuple[int, list[str], int]] = {}
        hits: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            words = normal(text).split()
            if not words:
                continue
            key, edits = len(self.items), budget(len(words), rate, least)
            self.items[key] = (item, words, edits)
            for place, part in pieces(words, edits):
                hits.setdefault(f" {' '.join(part)} ", []).append((key, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in hits.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.any = bool(hits)
        if hits:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        found: dict[int, int] = {}
        if not self.any:
            return found
        padded = f" {normal(text)} "
        words: list[str] | None = None
        seen: set[tuple[int, int]] = set()
        verified: dict[int, tuple[int, int]] = {}  # the last place of an item and its distance there
        counted = blanks = 0
        for last, (width, where) in self.automaton.iter(padded):
            at = last - width + 1
            if at >= counted:
                blanks += padded.count(" ", counted, at)
                number = blanks
                counted = at
            else:
                number = blanks - padded.count(" ", at, counted)
            words = words if words is not None else padded.split()
            for key, place in where:
                item, own, slack = self.items[key]
                start = number - place
                if found.get(item) == 0 or (key, start) in seen:
                    continue
                seen.add((key, start))
                # A place that is k words away shares all but k words of the verified one: its distance is at most k less.
                near = verified.get(key)
                if near and near[1] - abs(start - near[0]) > min(slack, found.get(item, slack)):
                    continue
                d = distance(own, words[max(0, start - slack) : start + len(own) + slack])
                verified[key] = start, d
                if d <= slack:
                    found[item] = min(d, found.get(item, d))
        return found


def sent_items(items: DataFrame) -> list[Broadcast]:
    """The items in blocks, each sent to all executors."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    return [items.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in b.orderBy("item_id", "text").collect()]) for b in item_blocks(items)]


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """items(item_id, text), without repeated rows, dealt by a hash of both into blocks of about block_bytes or less."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, item_words): each item found in a document, with its least distance in words.

    Items of fewer than `least` words must stand in the text word for word. Null or empty items and null texts match nothing. Rows of the same
    doc_id are reported each; two items of one item_id are reported as one, of the least distance. Either table empty: no rows.
    """
    spark, rows, schema = docs.sparkSession, documents(docs, id_col, text_col), "doc_id long, item_id long, distance int, item_words int"

    def block(sent: Broadcast) -> DataFrame:
        made: list[Matcher] = []

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not made:
                made.append(Matcher(sent.value, rate, least))
            matcher = made[0]
            lengths = {item: len(words) for item, words, _ in matcher.items.values()}
            out = [(d, i, n, lengths[i]) for d, t in zip(column(batch, "doc_id"), column(batch, "text"), strict=True) for i, n in sorted(matcher.find(t).items())]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return batch_of(**{n: ([r[k] for r in out], kinds[k]) for k, n in enumerate(("doc_id", "item_id", "distance", "item_words"))})

        return arrow_map(rows, kernel, schema)

    blocks = [block(b) for b in sent_items(items)]
    return reduce(DataFrame.unionByName, blocks) if blocks else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST_WORDS, text_col: str = "text") -> DataFrame:
    """docs without the rows in which an item is found; columns as they were. Each row is judged where it lies, without a shuffle.

    Null and empty texts hold no item and stay; repeated rows go or stay together; ids aren't looked at. Either table empty: docs as it is.
    """
    prepare(docs.sparkSession)

    def clean_of(sent: Broadcast):
        made: list[Matcher] = []

        @F.pandas_udf(BooleanType())
        def is_clean(texts: pd.Series) -> pd.Series:
            if not made:
                made.append(Matcher(sent.value, rate, least))
            return pd.Series([not made[0].find(t or "") for t in texts], dtype=bool)

        return is_clean

    return reduce(lambda rows, sent: rows.where(clean_of(sent)(F.col(text_col).cast("string"))), sent_items(items), docs)
