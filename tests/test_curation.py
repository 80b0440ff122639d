"""Identities, context, edits and release audits."""

import json

from pyspark.sql import functions as F

from benchloom.functions import udfs
from benchloom.operators import audit, curation
from benchloom.session import ship


def test_base_id_ignores_place(spark):
    ship(spark)
    rows = spark.createDataFrame([("f1", 3, "S", '{"paper_id": "é"}', 'a "q"?', "qa"), ("f9", 1, "S", '{"paper_id":"é"}', 'a "q"?', "qa")], "file string, row_index int, source string, anchor string, question string, slot string")
    got = [r[0] for r in rows.select(curation.base_id(F.col("source"), F.col("anchor"), F.col("question"), F.col("slot"))).collect()]
    assert got[0] == got[1] == "qa_" + udfs.canonical_digest(["S", {"paper_id": "é"}, 'a "q"?', "qa"], "compact")


def test_keyed_digests(spark):
    ship(spark)
    r = spark.createDataFrame([("b", "en", 'x "y"\n')], "a string, b string, c string").select(curation.keyed_digest("pair_", F.col("a"), F.col("b"), F.col("c"))).first()[0]
    assert r == "pair_" + udfs.canonical_digest(["b", "en", 'x "y"\n'])


def test_sources(spark):
    rows = spark.createDataFrame([("P", ["q0", "q1"], "turn_1", None), ("C", None, "qa", "q")], "source string, qs array<string>, slot string, query string")
    question = curation.upstream({"P": (curation.turn(F.col("qs"), F.col("slot")), F.lit("a")), "C": (F.col("query"), F.lit("b"))})
    assert [tuple(r[0]) for r in rows.select(question).collect()] == [("q1", "a"), ("q", "b")]
    strata = curation.stratum({"P": [F.lit("Factoid")], "C": [F.col("slot"), F.lit(1)]})
    assert [r[0] for r in rows.select(strata).collect()] == ["P/Factoid", "C/qa/1"]


def test_input_text(spark):
    rows = spark.createDataFrame([("q", ["a", "é"]), ("q", None), ("q", [])], "q string, p array<string>")
    got = [r[0] for r in rows.select(curation.input_text(F.col("q"), F.col("p"))).collect()]
    assert json.loads(got[0]) == {"source_context": ["a", "é"], "question": "q"} and got[1:] == ["q", "q"]


def test_edit_issues(spark):
    ship(spark)
    old = "How much is [[k]] in 2012, at 5%?"
    cases = {"What is [[k]] in 2012, at 5%?": [], "How much is [[j]] in 2012, at 5%?": ["placeholder_changed"], "How much is [[k]] in 2013, at 5%?": ["number_changed"], "How much is [[k]] in 2012, at 5?": ["operator_changed"], old + "‮": ["bidi_control"]}
    rows = spark.createDataFrame([(old, n) for n in cases], "o string, n string")
    got = {r.n: r.i for r in rows.select("n", curation.edit_issues(F.col("o"), F.col("n")).alias("i")).collect()}
    assert got == cases
    empty = spark.createDataFrame([(old, " ")], "o string, n string").select(curation.edit_issues(F.col("o"), F.col("n"))).first()[0]
    assert {"empty_query", "extensive_rewrite", "number_changed"} <= set(empty)


def test_groups_and_membership(spark):
    rows = spark.createDataFrame([("a", ["g1"]), ("b", ["g2", "g3"]), ("c", [])], "id string, groups array<string>")
    used = spark.createDataFrame([("g3",)], "group string")
    assert sorted(r.id for r in curation.unused_groups(rows, used).collect()) == ["a", "c"]
    members = spark.createDataFrame([("b", "selected")], "id string, membership string")
    assert {r.id: r.membership for r in curation.membership(rows, members).collect()} == {"a": "available", "b": "selected", "c": "available"}
    assert [r.id for r in curation.in_list_order(["c", "a"], rows, members.unionByName(rows.select("id", F.lit("x").alias("membership")))).collect()] == ["c", "a"]


def test_corrections_log(spark):
    rows = spark.createDataFrame([("1", "0°"), ("2", "x")], "case_id string, answer string")
    fixes = spark.createDataFrame([("1", "0°、45°"), ("2", "x")], "case_id string, corrected_answer string")
    new, log = curation.corrected(rows, fixes)
    assert {r.case_id: r.answer for r in new.collect()} == {"1": "0°、45°", "2": "x"} and [tuple(r) for r in log.collect()] == [("1", "0°", "0°、45°")]


def export_rows(spark):
    rows = [(f"{v}{q}", v, q, q, "Q\nreply", "Q", "red", "reply", f"{v}.png", f"{v}.py") for v, q in (("en", "en"), ("en", "zh"), ("zh", "en"), ("zh", "zh"))]
    return spark.createDataFrame(rows, "variant_id string, image_language string, query_language string, answer_language string, question string, question_without_instruction string, answer string, instruction string, image_path string, code_path string")


def checks(df):
    return {r.check for r in df.collect()}


def test_export(spark):
    rows = export_rows(spark)
    assert checks(audit.export(rows, 1, 2)) == set()
    assert checks(audit.export(rows.withColumn("answer", F.lit("[[k]]")), 1, 2)) == {"unbound"}
    assert checks(audit.export(rows.withColumn("answer_language", F.lit("en")), 1, 2)) == {"answer_language"}
    assert checks(audit.export(rows.withColumn("question", F.lit("Q")), 1, 2)) == {"reply"}
    assert checks(audit.export(rows.limit(3), 1, 2)) == {"configurations"}


def test_clean_release(spark):
    rows = export_rows(spark).withColumn("audit", F.struct(F.when(F.col("image_language") == "en", "accepted").alias("status"))).withColumn("id", F.col("variant_id"))
    views = {"candidates": rows, "accepted": rows.where("image_language = 'en'"), "needs_review": rows.where("image_language = 'zh'")}
    files = spark.createDataFrame([(f"{v}.{e}",) for v in ("en", "zh") for e in ("png", "py")], "path string")
    fields = tuple(rows.columns)
    assert checks(audit.clean_release(rows, views, files, fields)) == set()
    assert checks(audit.clean_release(rows, views, files.where("path <> 'en.py'"), fields)) == {"missing_file"}
    assert checks(audit.clean_release(rows, views, files.unionByName(spark.createDataFrame([("old.json",)], "path string")), fields)) == {"unexpected_file"}
    assert checks(audit.clean_release(rows, views | {"accepted": rows}, files, fields)) == {"view_accepted"}
    assert checks(audit.clean_release(rows.withColumn("old", F.lit(1)), views, files, fields)) == {"current_fields"}


def test_alignment(spark):
    refs = spark.createDataFrame([("i", "c", "b", "S", 1, "Q", "uq", "ua", "en")], "id string, case_id string, base_id string, source string, row_index int, query string, upstream_question string, upstream_answer string, image_language string")
    src = spark.createDataFrame([("b", "S", 1, "uq", "ua")], "base_id string, source string, row_index int, question string, answer string")
    drawn = spark.createDataFrame([("b", "en", "{}", "{}")], "base_id string, language string, data string, labels string")
    assert checks(audit.alignment(refs, src, drawn)) == set()
    assert checks(audit.alignment(refs, src.withColumn("row_index", F.lit(2)), drawn)) == {"row_changed"}
    assert checks(audit.alignment(refs.withColumn("query", F.lit("[[k]]")), src, drawn)) == {"unbound"}
    assert checks(audit.alignment(refs, src, drawn.withColumn("language", F.lit("zh")))) == {"renderer_missing"}
    assert checks(audit.alignment(refs, src.where("false"), drawn)) == {"source_missing"}


def test_code_data(spark):
    drawn = spark.createDataFrame([("b", "en", '{"v": 1}', '{"k": "x"}'), ("b", "zh", '{"v": 1}', '{"k": "y"}')], "base_id string, language string, data string, labels string")
    specs = spark.createDataFrame([("b", '{"v": 1}', ["k"])], "base_id string, data string, label_keys array<string>")
    assert checks(audit.code_data(drawn, specs)) == set()
    changed = drawn.withColumn("data", F.when(F.col("language") == "zh", '{"v": 2}').otherwise(F.col("data")))
    assert checks(audit.code_data(changed, specs)) == {"data_changed", "data_constant"}


def test_digitised(spark):
    points = [(x, y, *colour) for x in range(9) for colour, base in (((250, 10, 10), 50), ((10, 10, 250), 80)) for y in (base - 1, base + x, base + x)]
    rows = spark.createDataFrame(points, "px int, py int, r int, g int, b int")
    got = curation.digitised(rows, [("red", 255, 0, 0), ("blue", 0, 0, 255)], 2.0, 100.0, 0.0, 1000.0)
    curve = {r.x: r.y for r in got.where("series = 'red'").collect()}
    assert len(curve) == 9 and curve[2.0] == 460.0


def test_settings(monkeypatch):
    monkeypatch.setenv("X_MODEL", "env")
    assert curation.inherited_setting(["X_MODEL", "Y"], {"X_MODEL": "file"}) == "env"
    assert curation.inherited_setting(["Z", "Y"], {"Y": "file"}, "d") == "file" and curation.inherited_setting(["Z"], {}, "d") == "d"


def test_similarity_is_matched_for_undecided_pairs_only(spark):
    import difflib
    import random

    from benchloom.operators import curation

    ship(spark)
    rng, words = random.Random(4), "what is the value of total sales in région 2012 ¿cuál es 数値 🙂".split()
    pairs = [(" ".join(rng.choices(words, k=rng.randrange(12))), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(300)]
    pairs += [(a, a) for a, _ in pairs[:20]] + [("", ""), ("abc", "xyz")]
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", curation.less_similar(F.col("a"), F.col("b"), 0.55).alias("less"), curation.undecided(F.col("a"), F.col("b"), 0.55).alias("matched")).collect()
    assert all(r.less == (difflib.SequenceMatcher(None, r.a, r.b).ratio() < 0.55) for r in got)
    share = sum(r.matched for r in got) / len(got)
    print(f"{share:.0%} of the pairs reach the matcher")
    assert 0.1 < share < 0.9


def test_snapshots(spark, tmp_path):
    from benchloom.operators import snapshots

    path, kind = str(tmp_path / "s"), "id int, row struct<a:string,b:array<int>>"
    put = lambda rows: snapshots.snapshot({"source": spark.createDataFrame(rows, kind)}, path)
    stored = lambda: spark.read.parquet(f"{path}/content").count()
    rows = [(1, ("x", [1, 2])), (2, ("x", [1, 2])), (3, (None, None))]
    put(rows)
    assert stored() == 2
    put(rows)
    assert stored() == 2 and sorted(r.n for r in snapshots.counts(spark, path).collect()) == [1, 2]
    put([*rows[:2], (3, ("y", []))])
    assert stored() == 3 and snapshots.unreferenced(spark, path).count() == 1
    back = snapshots.restored(spark, path, "source", "row struct<a:string,b:array<int>>").collect()
    assert sorted((r.id, r.row.a, r.row.b) for r in back) == [("1", "x", [1, 2]), ("2", "x", [1, 2]), ("3", "y", [])]
