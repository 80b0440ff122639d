"""Texts, numbers and answers: literal cases."""

import unicodedata
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from benchloom import providers
from benchloom.functions import text, udfs
from benchloom.session import ship


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_plain_numbers(spark):
    yes = ["750", "0", "-2", "−2.5", "+3", "0.25", ".5", "1,234.50", "00.10"]
    no = ["50%", "10 kg", "约750", "1, 2", "1/2", "1e3", "一百", "١٢٣", "", "3–5", "12,34", "True", "1.", "1\n"]
    assert column(spark, yes, text.is_plain_number) == [True] * len(yes)
    assert column(spark, [*no, None], text.is_plain_number) == [False] * (len(no) + 1)


def test_canonical_numbers_equal_decimals(spark):
    numbers = ["750", "750.0", "0750", "-0", "0", "+.50", "0.5", "−1,000.00", "-1000", "1" * 40, "1" * 40 + ".0", "-.0", "12", "1,200", "120"]
    pairs = list(product(numbers, numbers))
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = [r[2] for r in rows.select("a", "b", text.same_answer(F.col("a"), F.col("b"))).collect()]
    value = lambda t: Decimal(t.replace(",", "").replace("−", "-"))
    assert got == [value(a) == value(b) for a, b in pairs]


def test_answers(spark):
    ship(spark)
    cases = [("750.0", "750", True), ("−1,000.00", "-1000", True), (" é ", "é", True), ("749", "750", False), ("50", "50%", False), ("Yes", "yes", False), (None, "x", False), ("\u00a0x\u3000", "x", True)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, a string, want boolean")
    got = rows.select("i", "want", text.same_answer(F.col("p"), F.col("a"), udfs.nfc).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_strip_is_pythons(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["\u200b", "\ufeff", "a"]
    values = [f"{s}x{s}" for s in spaces]
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_unicode_forms(spark):
    ship(spark)
    values = ["é", "ﬁ  x\u3000y ", "STRASSE ẞ", "１２", None]
    assert column(spark, values, udfs.nfc) == [v and unicodedata.normalize("NFC", v) for v in values]
    assert column(spark, values, udfs.nfkc_casefold) == ["é", "fi x y", "strasse ss", "12", None]
    assert column(spark, ["١٢٣ a９", "५"], udfs.ascii_digits) == ["123 a9", "5"]


def test_answer_reading(spark):
    cases = [('{"answer":"750"}', False, "750"), ('```json\n{"answer":"1"}\n```', False, "1"), (" 750 ", True, "750"), ("", True, None), (None, True, None), ('{"answer":" a "}', False, " a "), ('```\nb\n```', True, "b")]
    cases += [(bad, False, None) for bad in ('{"answer":1}', '{"answer":""}', '{"answer":" "}', '{"answer":"1","x":2}', "750", "", '["answer"]', '{"answer":"1"} x', '{"Answer":"1"}', '"answer"', "{}", "null")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, raw string, plain boolean, want string")
    for r in rows.select("*", text.read_answer(F.col("raw"), F.col("plain")).alias("r")).collect():
        assert (r.r.answer, r.r.error) == (r.want, None if r.want is not None else "AnswerFormatError"), r.raw
        assert providers.answer_of(r.raw or "", r.plain) == r.want


def test_binding():
    assert udfs.bind_template("Value for [[k]]?", {"k": "纸尿裤"}) == "Value for 纸尿裤?"
    assert udfs.bind_template("[[a]][[b]]", {"a": "[[b]]", "b": "x"}) == "[[b]]x"
    with pytest.raises(ValueError):
        udfs.bind_template("[[c]]", {})


def test_numbers_protected_and_restored(spark):
    source = ["$ 375 million at 5.0% in 2012.", "", "−3 of 4"]
    rows = spark.createDataFrame([(source,)], "p array<string>").select(text.protect_numbers(F.col("p")).alias("m"))
    masked, tokens = rows.select("m.*").first()
    assert masked == ["$ [[N_000000]] million at [[N_000001]] in [[N_000002]].", "", "[[N_000003]] of [[N_000004]]"]
    assert tokens == {"[[N_000000]]": "375", "[[N_000001]]": "5.0%", "[[N_000002]]": "2012", "[[N_000003]]": "−3", "[[N_000004]]": "4"}

    def restored(paragraphs):
        got = spark.createDataFrame([(paragraphs, masked, tokens)], "t array<string>, m array<string>, k map<string,string>")
        return tuple(got.select(text.restore_numbers(F.col("t"), F.col("m"), F.col("k")).alias("r")).select("r.*").first())

    assert restored(masked) == (source, None)
    assert restored(["In [[N_000002]]: [[N_000000]], [[N_000001]]", *masked[1:]])[0][0] == "In 2012: 375, 5.0%"
    assert restored([masked[0].replace("000000", "000001"), *masked[1:]]) == (None, "numeric_placeholder_changed")
    assert restored([masked[0] + " 7", *masked[1:]]) == (None, "unprotected_number_added")
    assert restored([masked[0], "", masked[2] + " ٣"]) == (None, "unprotected_number_added")
    assert restored(["", *masked[1:]]) == (None, "missing_paragraph")
    assert restored(masked[:1]) == (None, "paragraph_ids_or_order_changed")


def test_json_repair():
    assert udfs.repair_json('{"x":[1,2]],"code":"a[0]"}') == '{"x":[1,2],"code":"a[0]"}'
    assert udfs.repair_json('{"x":[1,"}\\""') == '{"x":[1,"}\\""]}'
    assert udfs.repair_json("{x}") is None


def test_json_edits(spark):
    broken = '{"x":[1,2]],"code":"a[0]"}'
    cases = [
        ([("2]],", "2],")], '{"x":[1,2],"code":"a[0]"}', None),
        ([("2]],", "2 ],"), ("2 ],", "2],\u2003")], '{"x":[1,2],\u2003"code":"a[0]"}', "still_invalid"),
        ([("2]],", "3],")], None, "edit_changes_nonpunctuation_content"),
        ([('"a[0]"', '"a0"')], None, "edit_changes_json_string_contents"),
        ([("]", "")], None, "nonunique_edit_anchor"),
        ([("", "]")], None, "nonunique_edit_anchor"),
        ([("absent", "absent")], None, "nonunique_edit_anchor"),
        ([], None, "still_invalid"),
    ]
    rows = spark.createDataFrame([(i, broken, e, w, x) for i, (e, w, x) in enumerate(cases)], "i int, json string, edits array<struct<old:string,new:string>>, want string, error string")
    for r in rows.select("*", text.json_edited(F.col("json"), F.col("edits")).alias("r")).collect():
        assert (r.r.json, r.r.error) == (r.want if r.error is None else None, r.error), r.edits
    odd = spark.createDataFrame([(None, []), ("{}", None), ('"' + "\\\\x" * 20_000 + '"', [])], "json string, edits array<struct<old:string,new:string>>")
    assert sorted(str(r.r.error) for r in odd.select(text.json_edited(F.col("json"), F.col("edits")).alias("r")).collect()) == ["None"] * 3


def test_localized_numbers(spark):
    cases = [("6th", "第6名", True), ("July 11, 2013", "2013年7月11日", True), ("July 11, 2013", "2013年7月12日", False), ("-8", "8", False), ("4-14 (K-8)", "4-14 岁（幼儿园至 8 年级）", True)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    got = rows.select("want", text.same_localized_numbers(F.col("a"), F.col("b")).alias("got")).collect()
    assert [r.got for r in got] == [c[2] for c in cases]


def test_questions(spark):
    cases = [("What is the largest value?", ["5"], True), ("Is it red?", ["5"], False), ("What if it rains?", ["5"], False), ("Explain the trend", ["up"], False), ("How many?", [" Yes. "], False), ("", ["5"], False), ("How many?", [], False), ("Which?\nA) x", ["5"], False), (None, ["5"], False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, q string, a array<string>, want boolean")
    got = rows.select("i", "want", text.is_normal_question(F.col("q"), F.col("a")).alias("got")).orderBy("i").collect()
    assert [r.got for r in got] == [c[2] for c in cases]


def test_tasks_and_hints(spark):
    assert column(spark, ["How many bars are highest?", "what is the total", "x"], text.first_match) == ["comparison", "arithmetic", "lookup_or_other"]
    assert column(spark, ["the average of 3"], lambda c: text.all_matches(c, text.TASK_TAGS))[0] == ["mean_median"]
    hints = column(spark, [["a", "b"], ["$1,000 %"], [" ".join("w" * 31)], ["red"]], text.answer_hint, "array<string>")
    assert hints == ["multiple_values_or_aliases", "numeric", "long_answer_needs_canonicalization", "short_text_or_expression"]


def test_reply_suffix_round_trip(spark):
    rows = spark.createDataFrame([("Q", "5", "Reply"), ("Q", "red", "Reply")], "q string, a string, i string")
    q = rows.withColumn("r", text.with_reply(F.col("q"), F.col("a"), F.col("i")))
    assert [r.r for r in q.collect()] == ["Q", "Q\nReply"]
    suffixed = F.concat("q", F.lit("\n"), "i")
    assert [r[0] for r in rows.select(text.without_reply(suffixed, F.col("a"), F.col("i"))).collect()] == ["Q", "Q\nReply"]


def test_digests():
    import hashlib
    import json

    value = {"b": [1, "é"], "a": None}
    spaced = json.dumps(value, sort_keys=True, ensure_ascii=False)
    assert udfs.canonical_digest(value) == hashlib.sha256(spaced.encode()).hexdigest()
    assert len({udfs.canonical_digest(value, m) for m in udfs.DIGESTS}) == 3


def test_source_as_data():
    code = "import x\nBASE_ID = 'b'\nDATA = {'v': [1, 2]}\nLABELS = {'k': 'é'}\ndef render(d):\n    ax.plot(d); ax.bar(d)\n"
    assert dict(udfs.literals(code)) == {"BASE_ID": '"b"', "DATA": '{"v": [1, 2]}', "LABELS": '{"k": "é"}'}
    assert udfs.chart_kinds(code) == ["bar", "line"]
    with pytest.raises(ValueError):
        udfs.literals("DATA = open('x')")


def test_forbidden_keys():
    assert udfs.forbidden_path('{"a": [{"api_key": 1}]}', frozenset({"api_key"})) == "/a/0/api_key"
    assert udfs.forbidden_path('{"a": "api_key"}', frozenset({"api_key"})) is None
