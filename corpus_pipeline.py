"""From raw documents to packed sequences: five stages, each on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each
stage's result as Parquet to the shared folder and reads it again for the next. All but the last stage return the columns of
documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from benchloom.llm import decontaminate, line_dedup, packing, quality_model, simhash
from benchloom.llm.common import drop, stored
from benchloom.llm.queries import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, scores under its cut go.

    Null and empty texts are judged as empty texts, repeated rows each by itself, rows without a doc_id by their text. Empty table: no rows.
    """
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, where near copies count as one document; every document stays, if need be with an empty text.

    Null texts stay null; repeated rows get the same text; rows without a doc_id are classed by their text. Empty table: no rows.
    """
    return line_dedup.remove_spread(docs, simhash.near_duplicates)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of exact and near copies (five-word shingles, similarity 0.8) the one with the smallest doc_id stays.

    Null, empty and blank texts are copies of each other. Of rows that repeat a doc_id one stays; rows without a doc_id all stay. Empty table: no rows.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows go or stay together. Empty table: no rows.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised and packed into sequences of 2048.

    Null and empty texts have the end id alone; repeated rows and rows without a doc_id are packed like others. Empty table: no rows.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Not expressible in SQL: the classifier, SimHash, edit distance and tokenizer stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir), name), docs
        if name != STAGES[0][0]:
            drop(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
