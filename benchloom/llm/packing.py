"""Packing of tokenised documents into sequences: best-fit decreasing.

Overlong documents are first cut into full windows; each of these is a sequence of its own. The rests are
dealt by a hash into groups of about GROUP rests and packed there, longest first, each
into the open window with the least room that still holds it. A segment tree indexed by remaining
capacity finds that window. A group's size doesn't depend on the number of documents, so neither does a
task's memory; the loss from packing groups apart is at most a few windows for each.
"""

from __future__ import annotations

import zlib
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import arrow_map, batch_of, column, documents, stored

#: Tokens in a sequence, id that ends a document, rests in a group.
LENGTH, END_ID, GROUP = 2048, 1, 20_000

# Marks that may stand after a word; the characters that stand for bytes in byte-level vocabularies (those that
# are printable in Latin-1 stand for themselves, the others for the next ones from 256 on).
_MARKS = ".,;:!?*$%&#"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

_encoders: dict[str, "Encoder"] = {}


#: The tokenizer whose ids are those of its chunks; others are run over whole texts.
CHUNKED = "word_bpe_49k.json"


class Encoder(dict):
    """The ids of each white-space separated chunk as little-endian 32-bit bytes, remembered within `limit` bytes.

    White space never takes part in the ids of CHUNKED, so a text's ids are its chunks' ids in turn. With any
    other tokenizer nothing is parted or remembered.
    """

    def __init__(self, path: str, limit: int = 1 << 26, longest: int = 128):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.longest, self.held = Tokenizer.from_file(path), limit, longest, 0
        self.chunked = Path(path).name == CHUNKED

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        core = text.rstrip(_MARKS)
        if core != text and core.isalpha() and core.lower().isalpha():
            # Letters, and the marks after them, are tokens apart.
            out = self[core.encode()] + self[text[len(core) :].encode()]
        elif core == text and text.isalpha() and "\u03a3" not in text and is_normalized("NFC", text):
            # One run of letters is one word for the model, in small letters and byte by byte.
            small = text.lower()
            out = self.word(text) if small == text else self[small.encode()] if small.isalpha() else self.ids(text)
        else:
            out = self.ids(text)
        if len(chunk) <= self.longest:
            self.held += len(chunk) + len(out) + 150  # and what Python keeps for an entry
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self[chunk] = out
        return out

    def word(self, letters: str) -> bytes:
        if not is_normalized("NFC", letters):
            return self.ids(letters)
        spelt = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTES)
        return np.array([t.id for t in self.tokenizer.model.tokenize(spelt)], dtype="<u4").tobytes()

    def encode(self, text: bytes) -> bytes:
        if not self.chunked or b"<|" in text:  # special tokens may be written out in it
            return self.ids(text.decode())
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Windows:
    """Open windows by remaining capacity, with a segment tree over capacities: its leaves count open windows."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, window: int, room: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of `need` or more: (window, room)."""
        tree, at = self.tree, need + self.size
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                at += not tree[at]
        room = at - self.size
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit(lengths: list[int], length: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length, which must come longest first."""
    windows, place, offset, made = Windows(length), [], [], 0
    for n in lengths:
        found = windows.tightest(n)
        window, room = found or (made, length)
        made += not found
        place.append(window)
        offset.append(length - room)
        if room > n:
            windows.put(window, room - n)
    return place, offset


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids and the end id, cut into full windows and a rest."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(tokenizer).encode
        docs, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
        for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
            tokens = encode(text) + end
            for at in range(0, len(tokens), 4 * length):
                part = tokens[at : at + 4 * length]
                docs.append(doc)
                starts.append(at // 4)
                lengths.append(len(part) // 4)
                crcs.append(zlib.crc32(part))
                totals.append(len(tokens) // 4)
                ids.append(part)
        out = {"doc_id": (docs, pa.int64()), "start": (starts, pa.int64()), "length": (lengths, pa.int64()), "ids_crc32": (crcs, pa.int64()), "doc_tokens": (totals, pa.int64())}
        return batch_of(**out, **({"ids": (ids, pa.binary())} if with_ids else {}))

    rows = documents(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, kernel, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row for each piece, in any tokenizer's ids.

    Null and empty texts have the end id alone; a null doc_id and repeated rows are packed like others. Ties go by
    doc_id and start. Sequence ids are distinct, not consecutive. Empty table: no rows.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), length, end_id, id_col, text_col), "pieces")
    groups = max(1, -(-made.where(F.col("length") < length).count() // group))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        place, offset = best_fit(frame["length"].tolist(), length)
        number = int(frame["bin"].iloc[0])
        return frame.drop(columns="bin").assign(sequence_id=[2 * ((number << 32) + p) for p in place], offset=offset)

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rests = made.where(F.col("length") < length)
    # Rows are dealt by their place in the stored table too, so that repeated ones spread over all groups.
    rests = rests.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast(IntegerType()))
    fitted = rests.groupBy("bin").applyInPandas(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    # A full window is a sequence by itself, with an odd number; its rows are numbered where they lie.
    full = made.where(F.col("length") == length).select(*columns, (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return fitted.unionByName(full)
