"""Statistics of a whole text that the quality rules and the quality classifier share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, column, gram_hashes, word_bounds, word_hashes

#: Words in a window whose repeats count.
REPEAT = 8

# Characters that count as symbols, and frequent function words of the languages at hand.
SYMBOLS = b"#*$%&|<>"
FUNCTION_WORDS = frozenset(
    b"the of and to in is for on that by with as at are was be this from or it an not "
    b"der die das und ist von mit den im auf ein eine zu des dem nicht als auch es "
    b"le la les de des et en un une du que qui est pour dans par sur pas au ce "
    b"el los las del y se por con una su al lo como para es no".split()
)

FEATURES = (
    "log_words", "word_length", "word_length_spread", "long_words", "short_words", "symbols", "capitals", "digits", "letters", "not_ascii", "exclamations",
    "bars", "commas", "points", "function_words", "distinct_words", "top_word", "duplicate_lines", "repeated_words", "words_a_line", "short_lines",
)

_FUNCTION_WORDS = np.unique(word_hashes(b" ".join(sorted(FUNCTION_WORDS))))

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))


def repeated_words(hashes: np.ndarray, window: int = REPEAT) -> int:
    """Words in windows that occur twice or more in the text, the first one's included."""
    grams = gram_hashes(hashes, window)
    ordered = np.sort(grams)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(grams, twice))
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], FEATURES' values)."""
    raw = text.encode()
    starts, ends = word_bounds(raw)
    n, size = len(starts), max(1, len(raw))
    blanks = sum(map(raw.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    chars = len(text) - blanks
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    duplicates = len(lines) - len(set(lines))
    repeats = repeated_words(word_hashes(raw)) if n > REPEAT else 0
    base = [n, chars, symbols, duplicates, repeats]
    if not n:
        return base, [0.0] * len(FEATURES)
    lengths = ends - starts
    distinct, counts = np.unique(word_hashes(raw.lower()), return_counts=True)
    common = counts[np.isin(distinct, _FUNCTION_WORDS, assume_unique=True)].sum()
    without = lambda kind: (len(raw) - len(raw.translate(None, kind))) / size
    return base, [
        float(np.log1p(n)), chars / n, float(lengths.std()), float((lengths > 12).mean()), float((lengths <= 3).mean()), symbols / size, without(_UPPER), without(_DIGITS), without(_LETTERS), (len(raw) - len(text)) / size, raw.count(b"!") / n,
        raw.count(b"|") / n, raw.count(b",") / n, raw.count(b".") / n, int(common) / n, float(np.log(len(counts) + 1) / np.log(n + 1)), int(counts.max()) / n, duplicates / len(lines), repeats / n, min(n / len(lines), 200.0), sum(len(x.split(None, 4)) < 4 for x in lines) / len(lines),
    ]


def statistics(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text) to (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features array<double>)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t) for t in column(batch, "text")]
        base = {name: ([f[0][i] for f in found], pa.int64()) for i, name in enumerate(names)}
        return batch_of(doc_id=(batch.column(0), pa.int64()), **base, features=([f[1] for f in found], pa.list_(pa.float64())))

    return arrow_map(rows.select("doc_id", "text"), kernel, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", features array<double>")


def sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """The `most` distinct rows whose columns hash least: the same ones however the rows are dealt out.

    Of many rows only those under a hash that lets about a third more through are ordered, so that no task sends many more than
    `most`. Rows that repeat count once, so that a hot one neither fills the sample nor empties it.
    """
    order = F.xxhash64(*rows.columns, F.lit(seed))
    n = rows.agg(F.approx_count_distinct(order, 0.02)).first()[0]
    if n > 2 * most:
        rows = rows.where(order < -(2**63) + int(2**64 * 1.3 * most / n))
    return rows.distinct().orderBy(order).limit(most)
