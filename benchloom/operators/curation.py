"""From raw records of several sources to identified candidates, and from release to release."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, udfs
from .identity import short_id

# The tags that make a question hard, or of medium difficulty.
HARD_TAGS = ("multi_step", "approximate_reading")
MEDIUM_TAGS = ("comparison", "counting", "extrema_ranking", "difference", "sum_aggregation", "ratio_percentage", "mean_median", "conditional_filter", "intersection_threshold")

# The policy of shown context, and the sentences of a prompt that it changes.
CONTEXT_POLICY = "source_context_in_query_language_v1"
CONTEXT_SENTENCES = (("Use only the supplied image and question.", "Use only the supplied image, source context, and question."), ("If the image does not support an answer", "If the image and source context do not support an answer"))

# Characters that set the direction of text, and operators that an edit must keep.
BIDI_CONTROLS = "[‪‫‭‮‬⁦⁧⁨⁩]"
OPERATORS = "[<>≤≥≠=±%‰]"
BARE_NUMBER = r"(?U)[-+−]?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?"

#: Chart kinds' and tables' bins: upper edges and names.
PANEL_BINS = ([(2, "1"), (5, "2-4"), (10, "5-9")], "10+")
TABLE_BINS = ([(1000, "<1000"), (5000, "1000-4999")], "5000+")


def by_source(rules: dict[str, Column], source: str = "source") -> Column:
    """The expression of the row's source; null for sources without one."""
    return reduce(lambda c, kv: c.when(F.col(source) == kv[0], kv[1]), list(rules.items())[1:], F.when(F.col(source) == next(iter(rules)), next(iter(rules.values()))))


def stratum(parts: dict[str, list[Column]], source: str = "source") -> Column:
    """source/part/part, the parts chosen by source."""
    return by_source({s: F.concat_ws("/", F.col(source), *(p.cast("string") for p in columns)) for s, columns in parts.items()}, source)


def upstream(pairs: dict[str, tuple[Column, Column]], source: str = "source") -> Column:
    """struct(question, answer) of the record itself, by source."""
    return by_source({s: F.struct(q.cast("string").alias("question"), a.cast("string").alias("answer")) for s, (q, a) in pairs.items()}, source)


def turn(values: Column, slot: Column) -> Column:
    """The element of an array that a slot like turn_3 names."""
    return F.get(values, F.element_at(F.split(slot, "_"), -1).cast("int"))


def candidates(rows: DataFrame, question: Column, answers: Column, slot: Column, hint: Column | None = None, banned_answers: tuple[str, ...] = text.BANNED_ANSWERS) -> DataFrame:
    """rows(file, row_index) as candidates: id, question, answers, slot and task_hint; unsuitable questions are left out."""
    found = rows.withColumns({"question": question, "answers": answers, "slot": slot})
    found = found.where(text.is_normal_question(F.col("question"), F.col("answers"), banned_answers))
    return found.withColumns({"id": short_id(F.col("file"), F.col("row_index"), F.col("slot")), "task_hint": hint if hint is not None else text.first_match(F.col("question"))})


def base_id(source: Column, anchor: Column, question: Column, slot: Column) -> Column:
    """qa_ and a digest of what a question is, not of where it lies. anchor: JSON of its native ids, or of its picture's hash."""
    row = F.concat(F.lit("["), _json(source), F.lit(","), anchor, F.lit(","), _json(question), F.lit(","), _json(slot), F.lit("]"))
    return F.concat(F.lit("qa_"), udfs.digest("compact")(row))


def _json(value: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]\z", 1)


def keyed_digest(prefix: str, *values: Column) -> Column:
    """prefix and the digest of a JSON array of texts: pair, visual-question, input and exchange ids."""
    return F.concat(F.lit(prefix), udfs.digest("spaced")(F.concat(F.lit("["), F.concat_ws(",", *map(_json, values)), F.lit("]"))))


def fingerprint(*structs: str) -> Column:
    """A digest of whole structs in order: what a judgment was made from."""
    return udfs.digest("spaced")(F.concat(F.lit("["), F.concat_ws(",", *(F.to_json(s, {"ignoreNullFields": "false"}) for s in structs)), F.lit("]")))


def difficulty(tags: Column) -> Column:
    return text.difficulty(tags, HARD_TAGS, MEDIUM_TAGS)


def aspect(width: Column, height: Column) -> Column:
    ratio = width / height
    return F.when(ratio > 1.5, "wide").when(ratio < 0.67, "tall").otherwise("balanced")


def context_prompt(prompt: Column, has_context: Column, notice: str) -> Column:
    changed = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), CONTEXT_SENTENCES, prompt)
    return F.when(has_context, F.concat(changed, F.lit(notice))).otherwise(prompt)


def input_text(query: Column, paragraphs: Column) -> Column:
    """The question, with its context as JSON if there is any."""
    packed = F.to_json(F.struct(paragraphs.alias("source_context"), query.alias("question")))
    return F.when(F.size(F.coalesce(paragraphs, F.array().cast("array<string>"))) > 0, packed).otherwise(query)


def context_errors(language: Column, query_language: Column, policy: Column) -> Column:
    return F.when((language != query_language) | (policy != CONTEXT_POLICY), "invalid_source_context_policy")


def undecided(old: Column, new: Column, least: float) -> Column:
    """Whether two texts have to be matched to tell if their similarity reaches `least`: equal ones and such with too few characters in common don't."""
    return (old != new) & (text.similarity_bound(old, new) >= least)


def less_similar(old: Column, new: Column, least: float) -> Column:
    """Whether the share of matching blocks is under `least`. Matching takes the product of the lengths, so that only undecided pairs reach it."""
    match = undecided(old, new, least)
    return F.when(match, udfs.similarity_ratio(F.when(match, old), F.when(match, new)) < least).otherwise(old != new)


def run_key(settings: dict[str, Column]) -> Column:
    """The digest that names a run: of all its settings, by name."""
    return udfs.digest("spaced")(F.to_json(F.struct(*(c.alias(k) for k, c in sorted(settings.items()))), {"ignoreNullFields": "false"}))


def edit_issues(old: Column, new: Column, least_similar: float = 0.55) -> Column:
    """What a copy edit changed that it may not: placeholders, numbers, operators, direction marks, or too much."""
    numbers = lambda c: F.sort_array(F.regexp_extract_all(F.regexp_replace(c, r"\[\[[^\]]+\]\]", ""), F.lit(BARE_NUMBER), F.lit(0)))
    operators = lambda c: F.sort_array(F.regexp_extract_all(c, F.lit(OPERATORS), F.lit(0)))
    checks = [
        ("placeholder_changed", F.sort_array(text.placeholders(old)) != F.sort_array(text.placeholders(new))),
        ("number_changed", numbers(old) != numbers(new)),
        ("operator_changed", operators(old) != operators(new)),
        ("empty_query", text.strip(new) == ""),
        ("bidi_control", new.rlike(BIDI_CONTROLS)),
        ("extensive_rewrite", less_similar(old, new, least_similar)),
    ]
    return F.array_compact(F.array(*(F.when(c, n) for n, c in checks)))


def unused_groups(rows: DataFrame, used: DataFrame, groups: str = "groups", key: str = "id") -> DataFrame:
    """Rows none of whose groups is in used(group)."""
    met = rows.select(key, F.explode(groups).alias("group")).join(used.select("group"), "group", "left_semi").select(key)
    return rows.join(met, key, "left_anti")


def membership(pool: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """pool with membership from members(id, membership), available by default."""
    return pool.join(members.select(key, F.col("membership").alias("__m")), key, "left").withColumn("membership", F.coalesce("__m", F.lit("available"))).drop("__m")


def in_list_order(ids: list[str], *relations: DataFrame) -> DataFrame:
    """Relations joined on id for a fixed list of ids, in its order."""
    joined = reduce(lambda a, b: a.join(b, "id"), (r.where(F.col("id").isin(ids)) for r in relations))
    return joined.orderBy(F.array_position(F.array(*map(F.lit, ids)), F.col("id")))


def representatives(rows: DataFrame, language: str = "en") -> DataFrame:
    """The row of each case that was both drawn and asked in one language."""
    return rows.where((F.col("image_language") == language) & (F.col("query_language") == language))


def polished(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """rows with their query replaced from queries(case_id, language, query) and the reply instruction put back."""
    q = queries.select("case_id", F.col("language").alias("query_language"), F.col("query").alias("__query"))
    joined = rows.join(q, ["case_id", "query_language"], "left").withColumn("question_without_instruction", F.coalesce("__query", "question_without_instruction"))
    return joined.withColumn("question", text.with_reply(F.col("question_without_instruction"), F.col("answer"), F.col("instruction"))).drop("__query")


def reclassified(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """visual_kind from kinds(case_id, visual_kind); the family stays."""
    k = kinds.select("case_id", F.col("visual_kind").alias("__kind"))
    return rows.join(k, "case_id", "left").withColumns({"visual_family": F.coalesce("visual_family", "visual_kind"), "visual_kind": F.coalesce("__kind", "visual_kind")}).drop("__kind")


def corrected(rows: DataFrame, corrections: DataFrame, column: str = "answer", key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """(rows with corrected values, change log (key, before, after)) from corrections(key, corrected_answer)."""
    c = corrections.select(key, F.col("corrected_answer").alias("__new"))
    joined = rows.join(c, key, "left")
    changes = joined.where(F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column))).select(key, F.col(column).alias("before"), F.col("__new").alias("after"))
    return joined.withColumn(column, F.coalesce("__new", column)).select(*rows.columns), changes


def corrected_release(cases: DataFrame, variants: DataFrame, references: DataFrame, corrections: DataFrame) -> dict[str, DataFrame]:
    """A correction carried through a release: cases, variants, references, and the log of changed variants.

    corrections(case_id, id, file, row_index, original_answer, corrected_answer) must name their case's record: others are in `errors` and change
    nothing. cases(case_id, file, row_index, answer), variants(variant_id, case_id, answer, source_answer), references(id, case_id, answer, original_answer).
    Every variant's question and image stay, so that predictions can be scored again without being made again.
    """
    record = cases.select("case_id", *(F.col(c).alias(f"own_{c}") for c in ("file", "row_index", "answer")))
    met = corrections.join(record, "case_id", "left")
    fits = F.coalesce((F.col("file") == F.col("own_file")) & (F.col("row_index") == F.col("own_row_index")) & (F.col("original_answer") == F.col("own_answer")), F.lit(False))
    good = met.where(fits).select("case_id", F.col("id").alias("fix_id"), F.col("corrected_answer").alias("fix"))

    def carried(rows: DataFrame, columns: list[str], upstream: str | None = None) -> DataFrame:
        joined = rows.join(good, "case_id", "left")
        before = {upstream: F.when(F.col("fix_id").isNotNull(), F.col(columns[-1]))} if upstream else {}
        changed = {**before, **{c: F.coalesce("fix", c) for c in columns}, "reference_correction_id": F.col("fix_id")}
        return joined.withColumns(changed).drop("fix_id", "fix")

    changed = variants.join(good, "case_id").select(F.col("variant_id").alias("id"), "case_id", F.col("answer").alias("old_answer"), F.col("fix").alias("corrected_answer"), F.lit(True).alias("prediction_reusable"))
    return {
        "cases": carried(cases, ["answer"]),
        "variants": carried(variants, ["answer", "source_answer"], "upstream_source_answer"),
        "references": carried(references, ["answer", "original_answer"], "upstream_original_answer"),
        "changes": changed,
        "errors": met.where(~fits).select("case_id", "id"),
    }


def release_facts(rows: DataFrame) -> DataFrame:
    """One row: whether all texts lie inside, whether each case has one data hash, and the distinct missing glyphs."""
    per_case = rows.groupBy("case_id").agg((F.countDistinct("data_sha256") == 1).alias("one"), F.bool_and("text_inside_canvas").alias("inside"), F.array_distinct(F.flatten(F.collect_set("missing_glyphs"))).alias("glyphs"))
    return per_case.agg(F.bool_and("inside").alias("all_inside"), F.bool_and("one").alias("data_constant"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("glyphs")))).alias("missing_glyphs"))


def language_summary(rows: DataFrame, statuses: list[str]) -> DataFrame:
    return rows.groupBy("language").pivot("status", statuses).count().na.fill(0)


def digitised(pixels: DataFrame, prototypes: list[tuple[str, int, int, int]], x_scale: float, y_zero: float, y_top: float, top_value: float) -> DataFrame:
    """(series, x, y): a curve from coloured pixels(px, py, r, g, b): nearest colour, median of each column, axis scale, median of three."""
    from .windows import group_median, sliding_median

    far = [(F.col("r") - r) ** 2 + (F.col("g") - g) ** 2 + (F.col("b") - b) ** 2 for _, r, g, b in prototypes]
    series = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (d, (n, *_)) in enumerate(zip(far, prototypes, strict=True)))))["n"]
    columns = group_median(pixels.withColumn("series", series), ["series", "px"], "py")
    scaled = columns.select("series", (F.col("px") / x_scale).alias("x"), ((y_zero - F.col("median")) / (y_zero - y_top) * top_value).alias("raw"))
    return sliding_median(scaled, ["series"], ["x"], "raw", 1, "y").select("series", "x", "y")


def inherited(names: list[Column], layers: list[Column], default: Column) -> Column:
    """inherited_setting for rows: the first of several names that any of the layers (maps) gives a text that isn't empty, name by name and layer by layer."""
    return F.coalesce(*(F.nullif(F.try_element_at(layer, name), F.lit("")) for name in names for layer in layers), default)


def inherited_setting(names: list[str], file_values: dict[str, str], default: str | None = None) -> str | None:
    """The first of several settings that is given: each by environment, then by file."""
    for name in names:
        if value := os.environ.get(name) or file_values.get(name):
            return value
    return default
