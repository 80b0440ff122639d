"""Filters and row rules that evaluation runs and releases share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes and phrases by which providers report an exhausted quota.
QUOTA_CODES = ("insufficient_user_quota", "insufficient_quota", "insufficient_balance", "account_quota_exhausted", "credit_balance_exhausted", "insufficient_credits")
QUOTA_PHRASES = ("credit limit is insufficient", "insufficient credit", "insufficient balance", "credit balance is too low", "quota is running low", "quota has been exhausted", "余额不足", "额度不足", "余额已耗尽", "额度已用尽")

# The fields that references are released with, and those that a rerun must agree on to be reused.
REFERENCE_FIELDS = (
    "id", "base_id", "case_id", "split", "query", "answer", "image_path", "image_sha256", "code_path", "query_language", "image_language", "answer_language", "visual_kind", "visual_family", "source", "configuration", "task_tags",
    "answer_type", "provenance", "reference_correction_id", "upstream_answer_sha256", "source_context", "input_condition",
)
REUSE_FIELDS = ("base_id", "case_id", "query", "answer", "image_sha256", "query_language", "image_language", "answer_language", "source_context", "provenance")


def eligible(rows: DataFrame, rules: dict[str, Column], source: str = "source") -> DataFrame:
    """Rows that their source's rule lets in; sources without a rule are left out."""
    allowed = reduce(lambda case, kv: case.when(F.col(source) == kv[0], kv[1]), list(rules.items())[1:], F.when(F.col(source) == next(iter(rules)), next(iter(rules.values()))))
    return rows.where(F.coalesce(allowed, F.lit(False)))


def is_accepted(status: Column) -> Column:
    return status.eqNullSafe("accepted")


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin("completed", "failed"), F.lit(False))


def is_format_failure(mode: Column, error_type: Column, error: Column) -> Column:
    """An answer that came but couldn't be read; plain answers can't fail so."""
    unread = error_type.isin("JSONDecodeError", "AnswerFormatError") | ((error_type == "ValueError") & (error == "Invalid answer schema"))
    return F.coalesce((mode.isNull() | (mode != "plain")) & unread, F.lit(False))


def is_retryable(transport_error: Column, http_status: Column, mode: Column) -> Column:
    again = transport_error | (http_status == 429) | (http_status >= 500)
    return F.coalesce(again, F.lit(False)) & F.coalesce(mode != "plain", F.lit(True))


def hit_token_limit(status: Column, error: Column) -> Column:
    return F.coalesce((status == "failed") & error.contains("MAX_TOKENS"), F.lit(False))


def reusable(old: str, new: str, fields: tuple[str, ...] = REUSE_FIELDS) -> Column:
    """Whether two structs agree on all fields; missing equals missing."""
    return reduce(Column.__and__, (F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")) for f in fields))


def quota_exhausted(codes: Column, messages: Column) -> Column:
    """From arrays of the error objects' codes and messages."""
    text = F.lower(F.array_join(messages, " "))
    phrase = reduce(Column.__or__, (text.contains(p) for p in QUOTA_PHRASES))
    return F.coalesce(F.arrays_overlap(F.transform(codes, F.lower), F.array(*map(F.lit, QUOTA_CODES))), F.lit(False)) | F.coalesce(phrase, F.lit(False))


def pending(rows: DataFrame, done: DataFrame, key: str = "id", only: list | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """Rows not done yet; some ids only, and the first few of them, if asked for."""
    rows = rows.join(done.select(key), key, "left_anti")
    rows = rows.where(F.col(key).isin(only)) if only is not None else rows
    return rows.orderBy(order).limit(limit) if limit is not None else rows


def smoke_rows(rows: DataFrame, order: str) -> DataFrame:
    """The first English chart asked in English and the first Chinese table asked in Chinese."""
    wanted = F.when((F.col("visual_family") == "chart") & (F.col("image_language") == "en") & (F.col("query_language") == "en"), "chart").when((F.col("visual_family") == "table") & (F.col("image_language") == "zh") & (F.col("query_language") == "zh"), "table")
    rows = rows.withColumn("__kind", wanted).where("__kind is not null")
    return rows.groupBy("__kind").agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*").drop("__kind")


def needs_second_look(confidence: Column, ambiguities: Column, least: float = 0.8) -> Column:
    return F.coalesce(confidence < least, F.lit(True)) | (F.coalesce(F.size(ambiguities), F.lit(0)) > 0)


def answer_outliers(rows: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Rows of some answer types, by type, source row and case; an unknown row and row 0 both come first."""
    place = F.when(F.coalesce("row_index", F.lit(0)) == 0, -1).otherwise(F.col("row_index"))
    return rows.where(F.col("answer_type").isin(*types)).orderBy("answer_type", place, "case_id")


def allowed_context(rows: DataFrame) -> DataFrame:
    """(case_id, id, text, source_field, source_index): the paragraphs that may be shown, never answers.

    Reads `paragraph` of ChartQAPro rows, split at newlines with blanks kept, and pre_text and post_text of FinQA rows.
    """
    blank = F.coalesce(F.trim("paragraph"), F.lit("")) == ""
    document = rows.where((F.col("source") == "ChartQAPro") & ~blank).select("case_id", F.posexplode(F.split("paragraph", "\n")).alias("source_index", "text"), F.lit("Paragraph").alias("source_field"), F.lit("document").alias("kind"))
    parts = [rows.where("source = 'MMTU' and dataset = 'FinQA'").select("case_id", F.posexplode(f"{k}_text").alias("source_index", "text"), F.lit(f"metadata.{k}_text").alias("source_field"), F.lit(k).alias("kind")) for k in ("pre", "post")]
    found = reduce(DataFrame.unionByName, parts, document)
    return found.select("case_id", F.format_string("%s_%03d", "kind", "source_index").alias("id"), "text", "source_field", "source_index")


def clean_references(rows: DataFrame, fields: tuple[str, ...] = REFERENCE_FIELDS) -> DataFrame:
    """Allow-listed fields only, with the audit's public part."""
    audit = [F.struct(*(F.col(f"audit.{f}").alias(f) for f in ("status", "human_verified", "source_fidelity"))).alias("audit")] if "audit" in rows.columns else []
    return rows.select(*(f for f in fields if f in rows.columns), *audit)
