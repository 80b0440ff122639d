"""Parsers of HTML tables, merged-cell grids and Markdown tables."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

CELL = StructType([StructField("text", StringType()), StructField("rowspan", IntegerType()), StructField("colspan", IntegerType())])
ROWS = ArrayType(ArrayType(CELL))
POSITIONS = ArrayType(StructType([StructField("row", IntegerType()), StructField("column", IntegerType()), *CELL.fields]))


class _Table(HTMLParser):
    """Collects the cells of the only table of a document."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[dict]] = []
        self.open_cell: dict | None = None
        self.inside = self.seen = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.seen += 1
            self.inside += 1
            if self.seen > 1:
                raise ValueError("exactly one table, not nested, is expected")
        elif tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            given = dict(attrs)
            self.open_cell = {"text": "", "rowspan": int(given.get("rowspan") or 1), "colspan": int(given.get("colspan") or 1)}
            self.rows[-1].append(self.open_cell)
        elif tag == "br" and self.open_cell is not None:
            self.open_cell["text"] += "\n"

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.open_cell = None
        elif tag == "table":
            self.inside -= 1

    def handle_data(self, data: str) -> None:
        if self.open_cell is not None:
            self.open_cell["text"] += data


def html_table(document: str) -> list[list[dict]]:
    parser = _Table()
    parser.feed(document)
    parser.close()
    return parser.rows


class _Outside(HTMLParser):
    """Text outside tables, scripts and styles, and captions' text."""

    def __init__(self) -> None:
        super().__init__()
        self.stack = {"table": 0, "script": 0, "style": 0, "caption": 0}
        self.outside: list[str] = []
        self.caption: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.stack:
            self.stack[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.stack.get(tag):
            self.stack[tag] -= 1

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if not text or self.stack["script"] or self.stack["style"]:
            return
        if self.stack["caption"]:
            self.caption.append(text)
        elif not self.stack["table"]:
            self.outside.append(text)


def outside_text(document: str) -> tuple[list[str], str]:
    parser = _Outside()
    parser.feed(document)
    parser.close()
    return parser.outside, " ".join(parser.caption)


@F.pandas_udf(StructType([StructField("outside", ArrayType(StringType())), StructField("caption", StringType())]))
def html_outside(documents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([outside_text(d or "") for d in documents], columns=["outside", "caption"])


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def html_element(document: Column, tag: str) -> Column:
    """The text of the first such element, without its markup, character references as they stand."""
    inner = F.regexp_extract(document, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.trim(F.regexp_replace(inner, r"<[^>]+>", ""))


def grid_positions(rows: list[list[dict]]) -> list[dict]:
    """Absolute places of cells with spans. Overlaps, spans past the last row and ragged grids are errors."""
    taken: dict[tuple[int, int], bool] = {}
    placed, width = [], 0
    for r, cells in enumerate(rows):
        c = 0
        for cell in cells:
            while (r, c) in taken:
                c += 1
            down, across = int(cell.get("rowspan") or 1), int(cell.get("colspan") or 1)
            if down < 1 or across < 1 or r + down > len(rows):
                raise ValueError("invalid span")
            area = [(y, x) for y in range(r, r + down) for x in range(c, c + across)]
            if any(a in taken for a in area):
                raise ValueError("overlapping cells")
            taken.update(dict.fromkeys(area, True))
            placed.append({"row": r, "column": c, "text": cell["text"], "rowspan": down, "colspan": across})
            c += across
            width = max(width, c)
    if not width or len(taken) != width * len(rows):
        raise ValueError("ragged grid")
    return placed


@F.udtf(returnType="row int, column int, text string, rowspan int, colspan int, error string")
class HtmlGrid:
    """Rows for each cell of an HTML table with its absolute place; one row with the error if it has none."""

    def eval(self, document: str) -> Iterator[tuple]:
        try:
            for cell in grid_positions(html_table(document or "")):
                yield (*cell.values(), None)
        except ValueError as e:
            yield (None, None, None, None, None, str(e))


def register(spark) -> None:
    spark.udtf.register("html_grid", HtmlGrid)


def markdown_rows(text: Column) -> Column:
    """array<array<string>> of a pipe table's cells, without the separator row."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    return F.filter(cells, lambda row: ~F.forall(row, lambda c: c.rlike(r"^:?-+:?$")))


def markdown_blocks(text: Column) -> Column:
    """Pipe-table blocks in a text, in its order."""
    return F.regexp_extract_all(text, F.lit(r"(?m)(?:^[ \t]*\|[^\n]*(?:\n|$))+"), F.lit(0))


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())]))
_BLOCK = re.compile(r"(?m)(?:^[ \t]*\|[^\n]*(?:\n|$))+")


@F.pandas_udf(SPANS)
def markdown_spans(texts: pd.Series) -> pd.Series:
    """Pipe-table blocks with their places in the text, in code points."""
    return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "text": m[0]} for m in _BLOCK.finditer(t or "")])


def label_keys(cells: DataFrame, text: str, order: str) -> DataFrame:
    """cells with label_key: one key for each distinct text that isn't a number, numbered by first occurrence."""
    numeric = F.trim(F.col(text)).rlike(r"^[\s$€£¥+−\-0-9.,%eE()]*$")
    firsts = cells.where(~numeric).groupBy(F.col(text).alias("__text")).agg(F.min(order).alias("__first"))
    # Ranks over the few distinct labels of a table set.
    from pyspark.sql import Window

    keyed = firsts.select("__text", F.format_string("label_%03d", F.row_number().over(Window.orderBy("__first", "__text")) - 1).alias("label_key"))
    return cells.join(keyed, F.col(text) == F.col("__text"), "left").drop("__text")


_NUMBER_CELL = re.compile(r"[\s$€£¥+−\-0-9.,%eE()]*")


def table_spec(rows: list[list[dict]]) -> list[list[dict]]:
    """Cells with label_key None where they read as numbers; texts stay verbatim."""
    keys: dict[str, str] = {}
    return [[{**c, "label_key": None if _NUMBER_CELL.fullmatch(c["text"]) else keys.setdefault(c["text"], f"label_{len(keys):03d}")} for c in row] for row in rows]
