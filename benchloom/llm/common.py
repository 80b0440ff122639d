"""What the corpus operators share: stored intermediates, Arrow maps, hashing of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import BATCH_BYTES, BATCH_ROWS, ship
from ..storage import by_shuffle, drop, stored  # noqa: F401  the operators take them from here

#: ASCII capitals to small letters; everything else stays.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Largest key that stands for a missing doc_id.
NO_ID = 2**63 - 1


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): only these two, so that other columns can have any name; a missing text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors and bounds Arrow batches; for plans made after it."""
    ship(spark)


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """kernel over every Arrow batch of df, batches kept small enough for long texts."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield kernel(batch)

    return df.mapInArrow(run, schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of a partition one by one; lists of numbers travel better as binary columns."""
    for batch in batches:
        yield from batch.to_pylist()


def in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = BATCH_ROWS, size: Callable[[dict], int] = lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of at most `most` rows and about BATCH_BYTES / 4 bytes, as size tells them."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= most or total > BATCH_BYTES >> 2:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def stream(df: DataFrame, kernel: Callable[[Iterator[dict]], Iterator[dict]], schema: str, **options: int | Callable[[dict], int]) -> DataFrame:
    """kernel over each partition's rows, in their order; what it gives is sent in bounded batches (options: of in_batches)."""
    prepare(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: in_batches(kernel(rows_of(batches)), arrow, **options), schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batch_of(**columns: tuple[list | np.ndarray, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def components_of(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row that it reaches."""
    label, n = np.arange(len(adjacent)), len(adjacent)
    while True:
        new = np.minimum(label, np.where(adjacent, label[None, :], n).min(axis=1, initial=n))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


#: Bytes hashed at once; longer texts are parted between words.
BLOCK = 1 << 22

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bases of two hashes that are independent of each other, and for each the powers of it and of its inverse so far.
_BASES = (0xD1342543DE82EF95, 0xA0761D6478BD642F)
_powers: list[list[np.ndarray]] = [[np.ones(1, dtype=np.uint64)] * 2 for _ in _BASES]


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text starts and ends, in bytes."""
    blank = _SPACE[np.frombuffer(raw, dtype=np.uint8)]
    if not len(blank):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    bounds = np.concatenate([[0][: not blank[0]], edges, [len(blank)][: not blank[-1]]]).astype(np.int64)
    return bounds[::2], bounds[1::2]


def word_hashes(raw: bytes, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every word of a text: differences of one running polynomial over its bytes, brought to the same power. which: 0 or 1, of two hashes."""
    found = []
    while len(raw) > BLOCK and (cut := max(raw.rfind(blank, 0, BLOCK) for blank in (b" ", b"\n", b"\t", b"\r"))) > 0:
        found.append(_block_hashes(raw[:cut], which))
        raw = raw[cut:]
    return np.concatenate([*found, _block_hashes(raw, which)])


def _block_hashes(raw: bytes, which: int) -> np.ndarray:
    n, powers = len(raw), _powers[which]
    if len(powers[0]) <= n:
        for k, b in enumerate((_BASES[which], pow(_BASES[which], -1, 2**64))):
            steps = np.full(2 * n + 1, b, dtype=np.uint64)
            steps[0] = 1
            powers[k] = np.multiply.accumulate(steps)
    starts, ends = word_bounds(raw)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.add.accumulate((np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * powers[0][:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * powers[1][starts] + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing steps that spread a 64-bit hash evenly."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive word hashes (none if there are fewer), by joining grams of doubled length."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    power = lambda e: np.uint64(pow(base, e, 2**64))
    with np.errstate(over="ignore"):
        out, done, part, size = None, 0, words, 1
        while True:
            if k & size:
                out = part if out is None else out[: len(out) - size] * power(size) + part[done:]
                done += size
            if done == k:
                return mix(out)
            part = part[:-size] * power(size) + part[size:]
            size *= 2


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
