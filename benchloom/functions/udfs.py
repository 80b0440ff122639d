"""Arrow functions for what Spark's own functions can't express: Unicode forms, canonical JSON digests, tolerant parsing.

All are vectorised over Arrow batches; each takes and returns whole columns.
"""

from __future__ import annotations

import ast
import difflib
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, MapType, StringType, StructField, StructType


def _texts(function: Callable[[str], object], kind) -> Callable:
    """A one-column Arrow function from a function of a text; null stays null."""

    @F.pandas_udf(kind)
    def apply(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else function(v))

    return apply


_nfc = _texts(lambda t: t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t), StringType())


def nfc(text: Column | str) -> Column:
    """The text in Unicode's form C. ASCII is in it already and isn't sent to Python."""
    text = F.col(text) if isinstance(text, str) else text
    other = F.when(F.char_length(text) != F.octet_length(text), text)
    return F.coalesce(_nfc(other), text)


nfkc_casefold = _texts(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()).casefold(), StringType())
casefold = _texts(str.casefold, StringType())


def to_ascii_digits(text: str) -> str:
    return "".join(str(unicodedata.decimal(c)) if unicodedata.category(c) == "Nd" else c for c in text)


ascii_digits = _texts(to_ascii_digits, StringType())

#: The three JSON spellings that identities are hashed over: (separators, whether non-ASCII is escaped).
DIGESTS = {"spaced": ((", ", ": "), False), "compact": ((",", ":"), False), "escaped": ((", ", ": "), True)}


def canonical_digest(value: object, mode: str = "spaced") -> str:
    separators, escaped = DIGESTS[mode]
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=escaped, separators=separators).encode()).hexdigest()


def digest(mode: str = "spaced") -> Callable:
    """SHA-256 of a JSON text respelt with sorted keys in one of the DIGESTS."""
    return _texts(lambda t: canonical_digest(json.loads(t), mode), StringType())


_KEY = re.compile(r"\[\[([^\]]+)\]\]")


def bind_template(template: str, labels: dict[str, str]) -> str:
    """Every [[key]] replaced at once, so that values that look like keys stay; a missing key is an error."""
    missing = [k for k in _KEY.findall(template) if k not in labels]
    if missing:
        raise ValueError(f"unbound placeholder {missing[0]}")
    return _KEY.sub(lambda m: labels[m[1]], template)


@F.pandas_udf(StringType())
def bind(template: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else bind_template(t, dict(v or {})) for t, v in zip(template, labels, strict=True)], dtype=object)


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, as difflib counts it (an edit distance is not the same); null for a null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def forbidden_path(text: str, banned: frozenset[str]) -> str | None:
    """The first path in a JSON document under a banned key, at any depth."""
    todo = [("", json.loads(text))]
    while todo:
        path, value = todo.pop()
        items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for key, inner in items:
            if isinstance(value, dict) and key in banned:
                return f"{path}/{key}"
            todo.append((f"{path}/{key}", inner))
    return None


def forbidden_key(banned: set[str]) -> Callable:
    names = frozenset(banned)
    return _texts(lambda t: forbidden_path(t, names), StringType())


def literals(source: str, names: tuple[str, ...] = ("BASE_ID", "LANGUAGE", "DATA", "LABELS")) -> list[tuple[str, str]]:
    """(name, JSON of its value) for module-level literal assignments; the source is parsed, never run."""
    found = {}
    for node in ast.parse(source).body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and node.targets[0].id in names:
            found[node.targets[0].id] = json.dumps(ast.literal_eval(node.value), ensure_ascii=False, sort_keys=True)
    return sorted(found.items())


python_literals = _texts(lambda t: dict(literals(t)), MapType(StringType(), StringType()))

# Drawing methods and the chart kind that each shows.
CHART_CALLS = {
    "plot": "line", "bar": "bar", "barh": "bar", "scatter": "scatter", "fill_between": "area", "fill_betweenx": "area", "pie": "pie", "hist": "histogram", "boxplot": "box", "violinplot": "violin", "imshow": "heatmap_or_image",
    "pcolormesh": "heatmap", "contour": "contour", "contourf": "contour", "errorbar": "error_bar", "hexbin": "hexbin",
}


def chart_kinds(source: str) -> list[str]:
    calls = {n.func.attr for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)}
    return sorted({CHART_CALLS[c] for c in calls & CHART_CALLS.keys()})


renderer_charts = _texts(chart_kinds, ArrayType(StringType()))


def repair_json(text: str) -> str | None:
    """A JSON text with surplus or missing closing brackets outside strings put right; null if that isn't enough."""
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    out, open_, closes = [], [], {"{": "}", "[": "]"}
    for part in re.findall(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|[^"\[\]{}]+|"', text, re.S):
        if part in closes:
            open_.append(closes[part])
        elif part in ("]", "}"):
            if not open_ or open_[-1] != part:
                continue
            open_.pop()
        out.append(part)
    fixed = "".join(out) + "".join(reversed(open_))
    try:
        json.loads(fixed)
    except ValueError:
        return None
    return fixed


json_repaired = _texts(repair_json, StringType())

@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Width and height from the header of a PNG, GIF or JPEG; null for others."""
    return pd.DataFrame([size_of(bytes(c)) if c is not None else (None, None) for c in content], columns=["width", "height"], dtype="Int32")


def size_of(data: bytes) -> tuple[int | None, int | None]:
    big = lambda a, b: int.from_bytes(data[a:b], "big")
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return big(16, 20), big(20, 24)
    if data[:4] == b"GIF8":
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                return big(at + 7, at + 9), big(at + 5, at + 7)
            at += 2 + big(at + 2, at + 4)
    return None, None


@F.pandas_udf(BooleanType())
def is_contained(path: pd.Series, root: pd.Series) -> pd.Series:
    """Whether a relative path stays inside its root."""
    from posixpath import join, normpath

    return pd.Series([p is not None and (normpath(join(r, p)) + "/").startswith(normpath(r) + "/") for p, r in zip(path, root, strict=True)], dtype=bool)
