"""Integrity rules as queries that must return no rows.

Every check gives (check, key, detail). `report` unites checks; `require` fails a job on the first violation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType, TimestampNTZType

from ..functions.text import placeholders, with_reply
from ..storage import by_shuffle
from .sets import key_violations, row_diff

SCHEMA = "check string, key string, detail string"

# What a judgment may say.
VERDICTS = ("equivalent", "different")
COMPLIANCE = ("pass", "fail", "not_applicable", "uncertain")


def violations(name: str, rows: DataFrame, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def where(name: str, rows: DataFrame, bad: Column, key: str, detail: Column | None = None) -> DataFrame:
    """Rows for which a condition holds or can't be told."""
    return violations(name, rows.where(F.coalesce(bad, F.lit(True))), F.col(key), detail if detail is not None else F.lit(None))


def unique(name: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violations(name, found, F.concat_ws("/", *keys), F.concat(F.lit("rows: "), F.col("n")))


def row_count(name: str, rows: DataFrame, expected: int) -> DataFrame:
    found = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    return violations(name, found, F.lit("rows"), F.concat(F.col("n"), F.lit(f", expected {expected}")))


def group_sizes(name: str, rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != expected)
    return violations(name, found, F.concat_ws("/", *keys), F.concat(F.col("n"), F.lit(f", expected {expected}")))


def constant(name: str, rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Groups in which a field has several values, null being one.

    Of numbers and times the least and the greatest tell, in one pass of two values a group; sets of distinct ones are for other types.
    """

    def several(f: str) -> Column:
        null = F.max(F.col(f).isNull().cast("int"))
        if isinstance(rows.schema[f].dataType, (NumericType, DatetimeType, TimestampNTZType, BooleanType)):
            return F.coalesce((F.min(f) != F.max(f)) | (null == 1), F.lit(False)) & F.min(f).isNotNull()
        return F.countDistinct(f) + null > 1

    found = rows.groupBy(*keys).agg(*(several(f).alias(f"__{f}") for f in fields))
    varied = F.array_compact(F.array(*(F.when(F.col(f"__{f}"), f) for f in fields)))
    return violations(name, found.select(*keys, varied.alias("v")).where(F.size("v") > 0), F.concat_ws("/", *keys), F.concat_ws(",", "v"))


def constant_nested(name: str, rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Groups in which a field, of any type, has several values. Missing equals missing: a null, a null inside a value and a column that isn't there."""
    there = [f for f in fields if f in rows.columns]
    parts = [F.countDistinct(F.sha2(F.to_json(F.struct(F.col(f).alias("v"))), 256)).alias(f"__{f}") for f in there]
    if not parts:
        return violations(name, rows.where("false"), F.lit(None), F.lit(None))
    varied = F.array_compact(F.array(*(F.when(F.col(f"__{f}") > 1, f) for f in there)))
    found = rows.groupBy(*keys).agg(*parts).select(*keys, varied.alias("v")).where(F.size("v") > 0)
    return violations(name, found, F.concat_ws("/", *keys), F.concat_ws(",", "v"))


def agrees(name: str, found: DataFrame, published: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys that only one of two relations has, and those where a value differs by more than the tolerance; null equals null."""
    side = lambda df, tag: df.select(*keys, F.struct(*values).alias(tag))
    both = side(found, "a").join(side(published, "b"), keys, "full_outer")
    off = lambda v: ~F.coalesce(F.abs(F.col(f"a.{v}") - F.col(f"b.{v}")) <= tolerance, F.col(f"a.{v}").isNull() & F.col(f"b.{v}").isNull())
    differing = F.concat_ws(",", F.array_compact(F.array(*(F.when(off(v), v) for v in values))))
    detail = F.when(F.col("a").isNull(), "not found").when(F.col("b").isNull(), "not published").when(differing != "", differing)
    return violations(name, both.withColumn("d", detail).where("d is not null"), F.concat_ws("/", *keys), F.col("d"))


def same_keys(name: str, relations: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    return violations(name, key_violations(relations, keys), F.concat_ws("/", *keys), F.concat(F.lit("missing from "), F.concat_ws(",", "missing_from")))


def same_rows(name: str, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return violations(name, row_diff(old, new), F.col(key), F.col("side"))


def fields_allowed(name: str, rows: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    extra = [(name, f, "field not allowed") for f in rows.columns if f not in allowed]
    return rows.sparkSession.createDataFrame(extra, SCHEMA)


def hashes_match(name: str, rows: DataFrame, key: str, expected: str, found: str) -> DataFrame:
    return where(name, rows, ~F.col(expected).eqNullSafe(F.col(found)), key, F.concat_ws(" / ", expected, found))


def references_found(name: str, rows: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Paths in rows that no file has, and paths that leave their root."""
    gone = rows.join(by_shuffle(files.select(F.col("path").alias(path))), path, "left_anti")
    climbing = rows.where(F.col(path).rlike(r"(?:^|/)\.\.(?:/|$)|^/"))
    return violations(name, gone, F.col(path), F.lit("missing")).unionByName(violations(name, climbing, F.col(path), F.lit("outside the root")))


def no_placeholders(name: str, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    left = F.flatten(F.array(*(placeholders(F.coalesce(F.col(f), F.lit(""))) for f in fields)))
    return violations(name, rows.withColumn("__left", left).where(F.size("__left") > 0), F.col(key), F.concat_ws(",", "__left"))


def replies_present(name: str, rows: DataFrame, key: str) -> DataFrame:
    """rows(question, question_without_instruction, answer, instruction)."""
    return where(name, rows, F.col("question") != with_reply(F.col("question_without_instruction"), F.col("answer"), F.col("instruction")), key)


def report(spark: SparkSession, checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks, spark.createDataFrame([], SCHEMA))


def summary(found: DataFrame, names: list[str]) -> DataFrame:
    """(check, violations, passed) for all names, those without violations too."""
    all_names = found.sparkSession.createDataFrame([(n,) for n in names], "check string")
    counts = found.groupBy("check").agg(F.count(F.lit(1)).alias("violations"))
    return all_names.join(counts, "check", "left").select("check", F.coalesce("violations", F.lit(0)).alias("violations"), F.col("violations").isNull().alias("passed"))


def require(found: DataFrame) -> None:
    first = found.first()
    if first is not None:
        raise ValueError(f"{first['check']}: {first['key']} ({first['detail']})")


def release(rows: DataFrame, files: DataFrame | None = None, cases: int = 128, languages: int = 24) -> DataFrame:
    """A full release: sizes, unique ids, all configurations, one image hash for each image, files in place."""
    per_case = 3 * languages - 2
    checks = [
        unique("unique_ids", rows, ["id"]),
        row_count("rows", rows, cases * per_case),
        row_count("cases", rows.select("case_id").distinct(), cases),
        group_sizes("configurations_of_case", rows, ["case_id"], per_case),
        row_count("configurations", rows.select("image_language", "query_language").distinct(), per_case),
        unique("unique_configurations", rows, ["case_id", "image_language", "query_language"]),
        constant("one_hash_for_image", rows, ["case_id", "image_language"], ["image_sha256"]),
    ]
    if files is not None:
        checks.append(references_found("files", rows.select("image_path").distinct(), files, "image_path"))
    return report(rows.sparkSession, checks)


def run(references: DataFrame, predictions: DataFrame, run_key: str | None = None) -> DataFrame:
    """A finished run: unique ids on both sides, the same ids, terminal statuses, one run."""
    checks = [
        unique("unique_references", references, ["id"]),
        unique("unique_predictions", predictions, ["id"]),
        same_keys("complete", {"references": references, "predictions": predictions}, ["id"]),
        where("terminal", predictions, ~F.col("status").isin("completed", "failed"), "id", F.col("status")),
    ]
    if run_key is not None:
        checks.append(where("run_key", predictions, F.col("run_key") != run_key, "id", F.col("run_key")))
    return report(references.sparkSession, checks)


def resume(predictions: DataFrame, current: DataFrame, fields: list[str]) -> DataFrame:
    """Saved predictions whose recorded inputs differ from the current ones."""
    now = current.select("id", *(F.col(f).alias(f"__{f}") for f in fields))
    rows = predictions.join(now, "id", "left")
    changed = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f) for f in fields)))
    return violations("inputs_changed", rows.withColumn("c", changed).where(F.size("c") > 0), F.col("id"), F.concat_ws(",", "c"))


# What the requests of a question may not differ in.
SETTINGS = ("generationConfig", "max_output_tokens", "schema", "model")


def paired(rows: DataFrame, languages: int = 24) -> DataFrame:
    """What a paired analysis rests on, for each case and language asked: all images there, and one question, answer, context, prompt, effective
    reference and setting of the requests. Context and settings may be nested; what no row has isn't compared.
    """
    asked = ["case_id", "query_language"]
    pivots = rows.where(F.col("query_language").isin("en", "zh"))
    held = {"question": ["query", "answer"], "context": ["source_context"], "prompt": ["prompt_sha256"], "reference": ["reference_effective"], "settings": list(SETTINGS)}
    checks = [constant_nested(f"{name}_constant", pivots, asked, fields) for name, fields in held.items()]
    return report(rows.sparkSession, [group_sizes("images_of_question", pivots, asked, languages), *checks])


def paired_scores(metrics: DataFrame, leaderboard: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Scores that a paired analysis has found must be those of the leaderboard."""
    return agrees("leaderboard_agrees", metrics, leaderboard, keys, values, tolerance)


def paired_metrics(rows: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """delta = wrong-to-correct less correct-to-wrong, in every row."""
    return where("delta_identity", rows, F.abs(F.col("delta_pp") - (F.col("wrong_to_correct_pct") - F.col("correct_to_wrong_pct"))) > tolerance, key)


def revision(old: DataFrame, new: DataFrame, allowed: tuple[str, ...], key: str = "id") -> DataFrame:
    """Differences between two revisions other than in fields that may change."""
    from .sets import changed_fields

    fields = violations("field_changed", changed_fields(old, new, key, allowed).where("violation"), F.col(key), F.concat_ws(",", "changed"))
    return same_keys("rows_changed", {"old": old, "new": new}, [key]).unionByName(fields)


def judgments(rows: DataFrame) -> DataFrame:
    """rows(id, verdict, reason, language_compliance, category): known verdicts and compliances, a reason, a category (which may be empty)."""
    checks = [
        where("verdict", rows, ~F.col("verdict").isin(*VERDICTS), "id", F.col("verdict")),
        where("reason", rows, F.trim("reason") == "", "id"),
        where("language_compliance", rows, ~F.col("language_compliance").isin(*COMPLIANCE), "id", F.col("language_compliance")),
        where("category", rows, F.col("category").isNull(), "id"),
    ]
    return report(rows.sparkSession, checks)


def classifications(rows: DataFrame) -> DataFrame:
    """Kinds of tables must agree with their spans, panel counts with layouts, confidences with their range."""
    spans = F.struct(F.col("table_structure.row_spans"), F.col("table_structure.column_spans"))
    expected = F.create_map(*(x for kind, r, c in (("Simple Table", False, False), ("Row-Spanning Table", True, False), ("Column-Spanning Table", False, True), ("Mixed-Spanning Table", True, True)) for x in (F.lit(kind), F.struct(F.lit(r).alias("row_spans"), F.lit(c).alias("column_spans")))))
    wanted = F.try_element_at(expected, F.col("visual_kind"))
    checks = [
        violations("span_class", rows.where(wanted.isNotNull() & ~wanted.eqNullSafe(spans)), F.col("case_id"), F.col("visual_kind")),
        where("confidence", rows, ~F.col("confidence").between(0, 1), "case_id", F.col("confidence")),
        where("panels", rows, (F.col("panel_count") < 1) | ((F.col("layout") == "single") & (F.col("panel_count") != 1)), "case_id", F.col("panel_count")),
    ]
    return report(rows.sparkSession, checks)


def geometry(boxes: DataFrame, cell: int = 256) -> DataFrame:
    """Text boxes (image, box, left, top, right, bottom, width, height) outside their canvas, or over one another.

    Boxes meet only inside the squares of a grid that both touch, so the join is on a key and grows with the boxes.
    """
    b = F.struct("box", "left", "top", "right", "bottom")
    inside = where("inside_canvas", boxes, (F.col("left") < 0) | (F.col("top") < 0) | (F.col("right") > F.col("width")) | (F.col("bottom") > F.col("height")), "image", F.col("box"))
    steps = lambda a, z: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(z) - 1e-9) / cell))
    placed = boxes.where("right > left and bottom > top").select("image", b.alias("b"), F.explode(steps("left", "right")).alias("x"), steps("top", "bottom").alias("ys")).select("image", "b", "x", F.explode("ys").alias("y"))
    other = placed.withColumnRenamed("b", "o")
    met = placed.join(other, ["image", "x", "y"]).where("b.box < o.box and b.left < o.right and o.left < b.right and b.top < o.bottom and o.top < b.bottom")
    pairs = met.select("image", F.concat_ws("/", "b.box", "o.box").alias("pair")).distinct()
    return inside.unionByName(violations("overlap", pairs, F.col("image"), F.col("pair")))


# What an inherited review of a case and one of a language must have passed, and answer types that need a person.
CASE_REVIEWS = ("source_fidelity", "answer_preservation", "normal_qa")
LANGUAGE_REVIEWS = ("translation", "answer_equivalence", "render_readability")
CURATED_ANSWERS = ("long_text", "structured", "list")


def admission(variants: DataFrame, locales: DataFrame, layouts: DataFrame, reviews: DataFrame, language_reviews: DataFrame, new_languages: tuple[str, ...] = ()) -> DataFrame:
    """variants with `reasons`, the checks that keep each from being accepted, and `accepted` where there is none.

    variants(case_id, id, image_language, query_language, answer_type, question, answer, before boolean: accepted already in the last release);
    locales(case_id, language, question, answer, issues array, review_flags array): what should be asked, and what is suspicious in it;
    layouts(case_id, language, inside boolean, missing_glyphs array): of the drawn image; reviews(case_id, CASE_REVIEWS, critical_issues array);
    language_reviews(case_id, language, LANGUAGE_REVIEWS, query_fluency, issues array). What a variant has no row of isn't passed.
    A review or locale counts for the language asked in and the language drawn; new languages must also read fluently.
    """
    empty = lambda c: F.coalesce(F.size(c) == 0, F.lit(False))
    passed = lambda names: F.forall(F.array(*map(F.col, names)), lambda r: r.eqNullSafe(F.lit("pass")))
    fluent = ~F.col("language").isin(*new_languages) | F.col("query_fluency").eqNullSafe(F.lit("pass"))
    texts = locales.select("case_id", F.col("language").alias("query_language"), F.struct(F.col("question").alias("question"), F.col("answer").alias("answer"), empty(F.col("review_flags")).alias("uncurated")).alias("asked"))
    clean = locales.select("case_id", "language", empty(F.col("issues")).alias("clean"))
    spoken = language_reviews.select("case_id", "language", (passed(LANGUAGE_REVIEWS) & fluent & empty(F.col("issues"))).alias("spoken"))
    by_language = clean.join(spoken, ["case_id", "language"], "left").select("case_id", "language", F.struct("clean", F.coalesce("spoken", F.lit(False)).alias("spoken")).alias("good"))
    drawn = layouts.select("case_id", F.col("language").alias("image_language"), (F.coalesce("inside", F.lit(False)) & empty(F.col("missing_glyphs"))).alias("laid_out"))
    whole = reviews.select("case_id", (passed(CASE_REVIEWS) & empty(F.col("critical_issues"))).alias("sound"))
    rows = variants.join(texts, ["case_id", "query_language"], "left").join(drawn, ["case_id", "image_language"], "left").join(whole, "case_id", "left")
    for side in ("query", "image"):
        rows = rows.join(by_language.select("case_id", F.col("language").alias(f"{side}_language"), F.col("good").alias(f"{side}_good")), ["case_id", f"{side}_language"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    both = lambda name: yes(F.col(f"query_good.{name}")) & yes(F.col(f"image_good.{name}"))
    old = ~F.col("query_language").isin(*new_languages) & ~F.col("image_language").isin(*new_languages)
    checks = {
        "not_bound": yes((F.col("question") == F.col("asked.question")) & (F.col("answer") == F.col("asked.answer"))),
        "render_geometry_or_glyphs": yes(F.col("laid_out")),
        "source_review": yes(F.col("sound")),
        "language_review": both("spoken"),
        "localization": both("clean"),
        "needs_curation": yes(F.col("asked.uncurated")) & ~yes(F.col("answer_type").isin(*CURATED_ANSWERS)),
        "not_accepted_before": ~old | yes(F.col("before")),
    }
    reasons = F.array_compact(F.array(*(F.when(~ok, name) for name, ok in checks.items())))
    return rows.select(*variants.columns, reasons.alias("reasons")).withColumn("accepted", F.size("reasons") == 0)


def code_data(rendered: DataFrame, specs: DataFrame) -> DataFrame:
    """Renderers' frozen literals against their specs: rendered(base_id, language, data, labels), specs(base_id, data, label_keys), JSON texts."""
    s = specs.select("base_id", F.col("data").alias("__data"), F.col("label_keys").alias("__keys"))
    rows = rendered.join(s, "base_id", "left")
    keys = F.sort_array(F.json_object_keys("labels"))
    return report(rendered.sparkSession, [
        where("data_changed", rows, ~F.col("data").eqNullSafe(F.col("__data")), "base_id", F.col("language")),
        where("labels_changed", rows, ~keys.eqNullSafe(F.sort_array("__keys")), "base_id", F.col("language")),
        unique("one_renderer", rendered, ["base_id", "language"]),
        constant("data_constant", rendered, ["base_id"], ["data"]),
    ])


def context_inventory(rows: DataFrame, contexts: DataFrame, configurations: int = 70) -> DataFrame:
    """(source, cases, with_context, configurations) of selected cases."""
    with_any = contexts.select("case_id").distinct().withColumn("has", F.lit(1))
    grouped = rows.join(with_any, "case_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("cases"), F.count("has").alias("with_context"))
    return grouped.withColumn("configurations", F.col("with_context") * configurations)


def export(rows: DataFrame, cases: int, languages: int) -> DataFrame:
    """An export: the count that its cases and languages give, unique variants, answers in the language asked in, nothing unbound, replies in place."""
    checks = [
        row_count("configurations", rows, cases * (3 * languages - 2)),
        unique("unique_variants", rows, ["variant_id"]),
        where("answer_language", rows, F.col("answer_language") != F.col("query_language"), "variant_id"),
        no_placeholders("unbound", rows, "variant_id", ["question", "answer"]),
        replies_present("reply", rows, "variant_id"),
    ]
    return report(rows.sparkSession, checks)


def clean_release(rows: DataFrame, views: dict[str, DataFrame], files: DataFrame, allowed: tuple[str, ...], accepted: str = "audit.status <=> 'accepted'", key: str = "id") -> DataFrame:
    """A release that holds nothing but current fields and files, and views that are its complementary parts.

    views: candidates, accepted and needs_review. files(path): what lies in the release, against image_path and code_path.
    """
    expected = {"accepted": rows.where(accepted), "needs_review": rows.where(f"not ({accepted})"), "candidates": rows}
    named = rows.select(F.explode(F.array("image_path", "code_path")).alias("path")).distinct()
    checks = [
        unique("unique_ids", rows, [key]),
        fields_allowed("current_fields", rows, allowed),
        violations("missing_file", named.join(files, "path", "left_anti"), F.col("path"), F.lit(None)),
        violations("unexpected_file", files.join(named, "path", "left_anti"), F.col("path"), F.lit(None)),
        *(same_rows(f"view_{name}", expected[name].select(key), view.select(key), key) for name, view in views.items()),
    ]
    return report(rows.sparkSession, checks)


def disagree(rows: DataFrame, other: DataFrame, on: list[str], fields: dict[str, tuple[list[str], list[str]]], key: str, detail: str | None = None) -> list[DataFrame]:
    """For each name of fields, the rows whose first columns differ, null being a value, from the other relation's second columns; rows that it lacks are left out."""
    theirs = other.select(*on, F.struct(*(F.col(c).alias(c) for c in other.columns if c not in on), F.lit(1).alias("there_")).alias("theirs_"))
    joined = rows.join(by_shuffle(theirs), on)
    same = lambda mine, his: reduce(Column.__and__, (F.col(f"`{a}`").eqNullSafe(F.col("theirs_").getField(b)) for a, b in zip(mine, his, strict=True)))
    return [violations(name, joined.where(~same(mine, his)), F.col(key), F.col(detail) if detail else F.lit(None)) for name, (mine, his) in fields.items()]


def absent(name: str, rows: DataFrame, other: DataFrame, on: list[str], key: str, detail: str | None = None) -> DataFrame:
    """Rows that another relation has no partner of."""
    return violations(name, rows.join(by_shuffle(other.select(*on).distinct()), on, "left_anti"), F.col(key), F.col(detail) if detail else F.lit(None))


def source_alignment(cases: DataFrame, records: DataFrame) -> list[DataFrame]:
    """cases(case_id, file, row_index, slot, question, answer, record, image_sha256) against the records(file, row_index, question, answer, record, image_sha256) read anew."""
    from .identity import short_id

    rows = cases.withColumn("expected_", short_id(F.col("file"), F.col("row_index"), F.col("slot")))
    return [
        unique("duplicate_case_ids", cases, ["case_id"]),
        absent("source_rows_missing", cases, records, ["file", "row_index"], "case_id", "file"),
        where("source_locator_id_mismatch", rows, F.col("case_id") != F.col("expected_"), "case_id", F.col("expected_")),
        *disagree(cases, records, ["file", "row_index"], {"raw_record_mismatch": (["record"], ["record"]), "raw_qa_mismatch": (["question", "answer"], ["question", "answer"])}, "case_id"),
        *disagree(cases.where("image_sha256 is not null"), records, ["file", "row_index"], {"raw_image_mismatch": (["image_sha256"], ["image_sha256"])}, "case_id"),
    ]


def request_alignment(links: DataFrame, requests: DataFrame) -> list[DataFrame]:
    """links(case_id, request_sha256, payload_sha256) of what cases say they were made by, against requests(request_sha256, case_id, sha256, payload_sha256).

    A request that isn't there any more is a warning: see `unavailable`.
    """
    named = links.where("request_sha256 is not null").withColumn("named", F.col("request_sha256"))
    own = requests.select("request_sha256", F.col("case_id").alias("asked_for"), F.col("sha256").alias("found"), F.col("payload_sha256").alias("asked_with"))
    fields = {"api_case_id_mismatch": (["case_id"], ["asked_for"]), "api_fingerprint_mismatch": (["named"], ["found"]), "request_input_mismatch": (["payload_sha256"], ["asked_with"])}
    return disagree(named, own, ["request_sha256"], fields, "case_id", "request_sha256")


def unavailable(links: DataFrame, requests: DataFrame) -> DataFrame:
    """Warnings: requests that cases name and that are no longer kept."""
    return absent("historical_api_request_unavailable", links.where("request_sha256 is not null"), requests, ["request_sha256"], "case_id", "request_sha256")


def correction_alignment(cases: DataFrame, answers: DataFrame, corrections: DataFrame) -> list[DataFrame]:
    """corrections(case_id, original_answer, file, row_index, corrected_answer) against cases(case_id, answer, file, row_index) and normalised answers(case_id, answer, answer_template)."""
    return [
        *disagree(corrections, cases, ["case_id"], {"adjudication_source_mismatch": (["original_answer", "file", "row_index"], ["answer", "file", "row_index"])}, "case_id"),
        *disagree(corrections, answers, ["case_id"], {"adjudication_output_mismatch": (["corrected_answer", "corrected_answer"], ["answer", "answer_template"])}, "case_id"),
    ]


def output_alignment(locales: DataFrame, outputs: DataFrame, specs: DataFrame, answers: DataFrame) -> list[DataFrame]:
    """Locales against what translators said and what they started from.

    locales(case_id, language, question, question_original, answer_template, labels, polished: the polished question or null); outputs(case_id, language, question, answer_template,
    labels), what the requests of a locale gave; specs(case_id, labels); answers(case_id, question, answer_template). Labels are JSON texts.
    """
    first = locales.withColumn("said", F.coalesce("question_original", "question"))
    english = first.where("language = 'en'")
    translated = {"translation_qa_output_mismatch": (["said", "answer_template"], ["question", "answer_template"]), "translation_labels_output_mismatch": (["labels"], ["labels"])}
    return [
        *disagree(first, outputs, ["case_id", "language"], translated, "case_id", "language"),
        *disagree(english, specs, ["case_id"], {"english_locale_labels_mismatch": (["labels"], ["labels"])}, "case_id"),
        *disagree(english, answers, ["case_id"], {"english_locale_source_mismatch": (["said", "answer_template"], ["question", "answer_template"])}, "case_id"),
        where("query_polish_output_mismatch", locales.where("polished is not null"), F.col("question") != F.col("polished"), "case_id", F.col("language")),
    ]


def drawing_alignment(renderers: DataFrame, specs: DataFrame, locales: DataFrame, bases: DataFrame) -> list[DataFrame]:
    """Frozen renderers(case_id, folder_language, base_id, language, data, labels) against specs(case_id, data, drawn_data), locales' labels and bases(case_id, base_id)."""
    named = locales.select("case_id", F.col("language").alias("folder_language"), F.col("labels").alias("own_labels"))
    return [
        where("render_data_changed", specs, ~F.col("data").eqNullSafe(F.col("drawn_data")), "case_id"),
        absent("renderer_missing", named, renderers, ["case_id", "folder_language"], "case_id", "folder_language"),
        where("exported_code_language_mismatch", renderers, F.col("language") != F.col("folder_language"), "case_id", F.col("folder_language")),
        *disagree(renderers, bases, ["case_id"], {"exported_code_base_mismatch": (["base_id"], ["base_id"])}, "case_id", "folder_language"),
        *disagree(renderers, specs, ["case_id"], {"exported_code_data_mismatch": (["data"], ["drawn_data"])}, "case_id", "folder_language"),
        *disagree(renderers, named, ["case_id", "folder_language"], {"exported_code_labels_mismatch": (["labels"], ["own_labels"])}, "case_id", "folder_language"),
    ]


def variant_alignment(variants: DataFrame, cases: DataFrame, localized: DataFrame, images: DataFrame, corrections: DataFrame | None = None, pivots: tuple[str, ...] = ("en", "zh")) -> list[DataFrame]:
    """variants(case_id, variant_id, base_id, image_language, query_language, answer_language, question, answer, source_question, source_answer, image_path, image_sha256)
    against cases(case_id, base_id, question, answer), localized(case_id, query_language, question, answer), images(case_id, image_language, path, sha256)."""
    from .identity import variant_id

    expected = variant_id(F.col("base_id"), F.col("image_language"), F.col("query_language"))
    asked = F.col("query_language").isin(*pivots) | (F.col("query_language") == F.col("image_language"))
    if corrections is not None:
        fixed = corrections.select("case_id", F.col("corrected_answer").alias("fixed_"))
        cases = cases.join(fixed, "case_id", "left").withColumn("answer", F.coalesce("fixed_", "answer")).drop("fixed_")
    return [
        unique("duplicate_variant_ids", variants, ["variant_id"]),
        where("variant_identity_mismatch", variants, (F.col("variant_id") != expected) | (F.col("answer_language") != F.col("query_language")) | ~asked, "variant_id"),
        *disagree(variants, cases, ["case_id"], {"variant_base_mismatch": (["base_id"], ["base_id"]), "variant_original_qa_mismatch": (["source_question", "source_answer"], ["question", "answer"])}, "variant_id"),
        absent("variant_locale_missing", variants, localized, ["case_id", "query_language"], "variant_id", "query_language"),
        *disagree(variants, localized, ["case_id", "query_language"], {"variant_localized_qa_mismatch": (["question", "answer"], ["question", "answer"])}, "variant_id"),
        absent("variant_image_missing", variants, images, ["case_id", "image_language"], "variant_id", "image_language"),
        *disagree(variants, images, ["case_id", "image_language"], {"variant_image_mismatch": (["image_path", "image_sha256"], ["path", "sha256"])}, "variant_id"),
    ]


def validation_alignment(references: DataFrame, variants: DataFrame) -> list[DataFrame]:
    """references(id, case_id, query, answer, image_language, query_language, image_path, image_sha256) against the variants that they were made of."""
    own = variants.withColumnRenamed("variant_id", "id")
    qa = ["case_id", "question", "answer", "image_language", "query_language"]
    return [
        same_keys("validation_variant_set_mismatch", {"references": references, "variants": own}, ["id"]),
        *disagree(references, own, ["id"], {"validation_qa_mismatch": (["case_id", "query", *qa[2:]], qa), "validation_image_mismatch": (["image_path", "image_sha256"],) * 2}, "id"),
    ]


def run_alignment(snapshot: DataFrame, requests: DataFrame, references: DataFrame) -> list[DataFrame]:
    """A run's snapshot of references and its requests(id, question, image_path, image_sha256) against the references now."""
    columns = [c for c in references.columns if c != "id"]
    fields = ["query", "image_path", "image_sha256"]
    return [
        absent("evaluation_snapshot_unknown", snapshot, references, ["id"], "id"),
        *disagree(snapshot, references, ["id"], {"evaluation_snapshot_mismatch": (columns, columns)}, "id"),
        absent("evaluation_request_unknown", requests, references, ["id"], "id"),
        *disagree(requests, references, ["id"], {"evaluation_request_mismatch": (["question", *fields[1:]], fields)}, "id"),
    ]


def semantic_flags(references: DataFrame) -> DataFrame:
    """(case_id, variants): cases that a review failed or doubted; references(case_id, id, audit struct of CASE_REVIEWS)."""
    doubted = F.exists(F.array(*(F.col(f"audit.{f}") for f in CASE_REVIEWS)), lambda r: r.isin("fail", "uncertain"))
    return references.where(F.coalesce(doubted, F.lit(False))).groupBy("case_id").agg(F.count(F.lit(1)).alias("variants"))


def dependencies(references: DataFrame, affected: DataFrame, images: DataFrame, languages: int) -> DataFrame:
    """What must hold before context is added to affected(case_id) cases: all their configurations, images as recorded, one finite numeric answer.

    references(id, case_id, query_language, image_language, answer, image_path, image_sha256), images(image_path, found_sha256).
    """
    mine = references.join(affected.select("case_id").distinct(), "case_id", "left_semi")
    counted = mine.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_language").alias("asked"), F.countDistinct("answer").alias("answers"), F.min("answer").alias("answer"))
    number = F.col("answer").try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))) & F.col("answer").rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\z")
    return report(references.sparkSession, [
        absent("affected_case_unknown", affected, references, ["case_id"], "case_id"),
        where("incomplete_affected_configuration_coverage", counted, (F.col("n") != 3 * languages - 2) | (F.col("asked") != languages), "case_id", F.col("n")),
        *disagree(mine, images, ["image_path"], {"affected_image_changed": (["image_sha256"], ["found_sha256"])}, "id", "image_path"),
        where("affected_answers_need_language_review", counted, F.col("answers") > 1, "case_id", F.col("answers")),
        where("affected_non_numeric_answer_requires_translation_review", counted.where("answers = 1"), ~finite, "case_id", F.col("answer")),
    ])


def weighted_means(rows: DataFrame, parts: str, value: str = "mean", weight: str = "n", by: list[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Groups whose parts' weighted mean isn't the whole's: rows(by, parts, mean, n), the whole where `parts` is null."""
    keys = by or []
    whole, part = F.col(parts).isNull(), F.col(parts).isNotNull()
    found = rows.groupBy(*keys).agg(F.max(F.when(whole, F.col(value))).alias("whole"), F.try_divide(F.sum(F.when(part, F.col(value) * F.col(weight))), F.sum(F.when(part, F.col(weight)))).alias("parts"))
    key = F.concat_ws("/", *keys) if keys else F.lit("all")
    return violations("subgroups_equal_whole", found.where(~F.coalesce(F.abs(F.col("whole") - F.col("parts")) <= tolerance, F.lit(False))), key, F.concat_ws(" / ", "parts", "whole"))


def alignment(references: DataFrame, sources: DataFrame, rendered: DataFrame) -> DataFrame:
    """The part of the alignment that a release alone allows: references against the records they come from and the renderers that draw them.

    references(id, case_id, base_id, source, row_index, query, upstream_question, upstream_answer, image_language),
    sources(base_id, source, row_index, question, answer), rendered(base_id, language, data, labels). With a build's files, unite the
    lists of source_, request_, correction_, output_, drawing_, variant_, validation_ and run_alignment by `report`.
    """
    drawn = rendered.withColumnRenamed("language", "image_language")
    fields = {"source_changed": (["source"], ["source"]), "row_changed": (["row_index"], ["row_index"]), "question_changed": (["upstream_question"], ["question"]), "answer_changed": (["upstream_answer"], ["answer"])}
    checks = [
        unique("unique_ids", references, ["id"]),
        absent("source_missing", references, sources, ["base_id"], "id", "base_id"),
        *disagree(references, sources, ["base_id"], fields, "id"),
        absent("renderer_missing", references, drawn, ["base_id", "image_language"], "id", "image_language"),
        constant("data_constant", rendered, ["base_id"], ["data"]),
        no_placeholders("unbound", references, "id", ["query"]),
    ]
    return report(references.sparkSession, checks)


def bindings(rows: DataFrame, pairs: dict[str, tuple[str, str]], key: str = "id") -> DataFrame:
    """Recorded input hashes against those of the current inputs: {name: (recorded column, current column)}."""
    return report(rows.sparkSession, [hashes_match(f"{name}_binding", rows, key, a, b) for name, (a, b) in pairs.items()])


def subset(rows: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """A packaged subset: its rows are rows of the whole, unchanged, each once."""
    checks = [unique("unique_ids", chosen, [key]), violations("not_in_release", chosen.exceptAll(rows.select(*chosen.columns)), F.col(key), F.lit(None))]
    return report(rows.sparkSession, checks)
