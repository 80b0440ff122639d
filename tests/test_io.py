import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from benchloom import providers
from benchloom.operators import fanout, identity
from benchloom.sources import keyed, positions, readers, sinks


def test_positions_and_splits(spark, tmp_path):
    for name in ("val-0001", "test-0001", "test-0002"):
        spark.range(3).withColumn("image", F.lit("x")).coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    rows = readers.parquet_tree(spark, str(tmp_path))
    assert "image" not in rows.columns
    assert {(r.split, r["count"]) for r in rows.groupBy("split").count().collect()} == {("validation", 3), ("test", 6)}
    assert {r.row_index for r in rows.collect()} == {0, 1, 2}
    assert {r.split: len(r.files) for r in readers.local_files(spark, str(tmp_path)).collect()} == {"validation": 1, "test": 2}
    wanted = rows.where("split = 'test' and row_index = 1").select("file", "row_index")
    assert readers.wanted_rows(rows, wanted, ["id"]).count() == 2
    assert readers.inventory(rows).count() == 3
    assert readers.marker_counts(spark, str(tmp_path), {"tests": "/test-", "none": "/x-"}).collect() == [("tests", 2), ("none", 0)]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        readers.local_files(spark, str(tmp_path / "empty"))


def test_json_documents_by_path(spark, tmp_path):
    for run, n in (("r1", 1), ("r2", 2)):
        (tmp_path / run).mkdir()
        (tmp_path / run / f"{n:03d}.json").write_text(json.dumps({"x": n}, indent=1))
    got = {(r.path_run, r.path_number, r.x) for r in readers.json_documents(spark, f"{tmp_path}/*/*.json", ("run", "number")).collect()}
    assert got == {("r1", "001", 1), ("r2", "002", 2)}


def test_csv_grid(spark, tmp_path):
    (tmp_path / "g.csv").write_text('a,"b, ""c""",\n1,2,3\n')
    got = [(r.row, r.column, r.text) for r in readers.csv_grid(spark, str(tmp_path / "g.csv")).orderBy("row", "column").collect()]
    assert got == [(0, 0, "a"), (0, 1, 'b, "c"'), (0, 2, ""), (1, 0, "1"), (1, 1, "2"), (1, 2, "3")]
    import csv

    content = 'x;"two\nlines; ""quoted""";\r\n\r\n;;\n"";last;'
    (tmp_path / "h.csv").write_bytes(content.encode())
    want = [(i, j, cell) for i, line in enumerate(r for r in csv.reader(content.splitlines(True), delimiter=";") if r) for j, cell in enumerate(line)]
    got = [(r.row, r.column, r.text) for r in readers.csv_grid(spark, str(tmp_path / "h.csv"), ";").orderBy("row", "column").collect()]
    assert got == want


def test_jsonl_keeps_text(spark, tmp_path):
    rows = spark.createDataFrame([(2, "é"), (1, None)], "i int, t string")
    sinks.write_jsonl(rows, str(tmp_path / "o"), ["i"], single=True)
    lines = next((tmp_path / "o").glob("part-*")).read_text().splitlines()
    assert [json.loads(x) for x in lines] == [{"i": 1, "t": None}, {"i": 2, "t": "é"}] and "é" in lines[1]


def test_replace_and_archive(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_atomically(spark.range(3), path)
    sinks.replace_atomically(spark.range(5), path)
    assert sinks.current(spark, path).count() == 5
    old = sinks.current(spark, path)
    sinks.replace_atomically(spark.range(7), path)
    assert old.count() == 5 and sinks.current(spark, path).count() == 7 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("version-")]) == 2
    images = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", b"2")], "id string, content binary")
    hashed = sinks.archive(images, str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 2
    sinks.archive(spark.range(500).select(F.col("id").cast("string").cast("binary").alias("content")), str(tmp_path / "archive"))
    sinks.archive(spark.range(400, 900).select(F.col("id").cast("string").cast("binary").alias("content")), str(tmp_path / "archive"))
    kept = spark.read.parquet(str(tmp_path / "archive"))
    assert kept.count() == kept.select("sha256").distinct().count() == 900
    spark.createDataFrame([(hashed.first().sha256, b"other")], "sha256 string, content binary").write.mode("append").parquet(str(tmp_path / "archive" / f"prefix={hashed.first().sha256[:2]}"))
    with pytest.raises(ValueError):
        sinks.archive(images, str(tmp_path / "archive"))
    current = hashed.where("id = 'c'").select("sha256", F.lit("now").alias("path"))
    old = hashed.select("sha256", F.lit("archive").alias("path"))
    got = {(r.id, r.path, r.archived) for r in identity.archived_content(hashed, current, old).collect()}
    assert got == {("a", "archive", True), ("b", "archive", True), ("c", "now", False)}


TABLE = "\\toprule\nh\n\\midrule\nA & " + " & ".join(["1"] * 27) + " \\\\\n\\bottomrule\n"


def test_latex_upsert():
    values = [0.25, 100.0, None] + [50.0] * 24
    row = sinks.latex_row("A", values)
    assert row.startswith("A & 0.2 & 100 & \\textemdash & 50.0")
    out = sinks.upsert_row(TABLE, "A", row)
    assert out.count("\nA &") == 1 and sinks.upsert_row(out, "B", sinks.latex_row("B", values)).count(" & ") == 54
    with pytest.raises(ValueError):
        sinks.upsert_row(TABLE, "A", "A & 1")
    with pytest.raises(ValueError):
        sinks.publish(TABLE, "A", row, 1, 2, 70, [1.0])


def test_split_views(spark):
    rows = spark.createDataFrame([("a", ("accepted",)), ("b", ("held",)), ("c", (None,))], "id string, audit struct<status:string>")
    assert {k: v.count() for k, v in sinks.split_views(rows).items()} == {"candidates": 3, "accepted": 1, "needs_review": 2}


def test_zip_manifest(spark):
    data, manifest = sinks.zipped(spark.createDataFrame([("x", b"1"), ("y", b"2")], "path string, content binary"))
    assert data[:2] == b"PK" and len(manifest) == 2
    with pytest.raises(ValueError):
        sinks.zipped(spark.createDataFrame([("x", b"1"), ("y", b"2")], "path string, content binary"), most=1)


def test_provider_cache(spark, tmp_path):
    rows = spark.createDataFrame([("a", "q1"), ("b", "q1"), ("c", "q2")], "id string, request string")
    empty = spark.createDataFrame([], providers.SCHEMA)
    replay = providers.Replay({"q1": "r1"})
    path = str(tmp_path / "cache")
    got = {r.id: (r.status, r.response) for r in providers.ask_missing(rows, empty, replay, path).collect()}
    assert got["a"] == got["b"] == ("completed", "r1") and got["c"][0] == "failed"
    again = {r.id: r.status for r in providers.ask_missing(rows, spark.read.parquet(path), providers.Replay({"q2": "r2"}), path).collect()}
    assert again == {"a": "completed", "b": "completed", "c": "completed"}
    # A cache that lies elsewhere counts too.
    other = spark.createDataFrame([(r.request_sha256, "completed", "known") for r in providers.requests_of(rows, "request").where("id = 'c'").collect()], providers.SCHEMA)
    elsewhere = {r.id: r.response for r in providers.ask_missing(rows, other, replay, str(tmp_path / "new")).collect()}
    assert elsewhere == {"a": "r1", "b": "r1", "c": "known"}


def test_translation_batches():
    got = providers.masked_batches(["x" * 4000, "y" * 600, "x" * 4000, *(str(i) for i in range(200))])
    assert [len(b) for b in got] == [1, 128, 73] and all(sum(map(len, b)) <= 4500 for b in got)


def test_variants(spark):
    cases = spark.createDataFrame([("b1",)], "base_id string")
    for n, expected in ((24, 70), (11, 31)):
        rows = fanout.variants(cases, fanout.languages(spark, fanout.LANGUAGES[:n]))
        assert rows.count() == expected and rows.select("variant_id").distinct().count() == expected
        assert rows.where("configuration = 'monolingual'").count() == n


def test_lineage_and_ancestry(spark):
    p = spark.createDataFrame([("a", "x", 2)], "id string, prediction string, selected_attempt int")
    req = spark.createDataFrame([("a", "q")], "id string, question string")
    att = spark.createDataFrame([("a", 2, "json")], "id string, attempt_number int, answer_mode string")
    resp = spark.createDataFrame([("a", 2, "raw")], "id string, attempt_number int, raw string")
    jud = spark.createDataFrame([("a", "y")], "id string, prediction string")
    r = identity.lineage(p, req, att, resp, jud).first()
    assert (r.has_request, r.has_attempt, r.judged_this, r.response.raw) == (True, True, False, "raw")
    revisions = spark.createDataFrame([("v3", "v2"), ("v2", "v1"), ("v1", None)], "revision string, parent string")
    chain = identity.ancestry(revisions, spark.createDataFrame([("v3",)], "revision string"))
    assert [(r.revision, r.depth) for r in chain.orderBy("depth").collect()] == [("v3", 0), ("v2", 1), ("v1", 2)]
    rows = spark.createDataFrame([("k", "v1", 1), ("k", "v2", 2), ("m", "v0", 3)], "k string, revision string, x int")
    assert [(r.k, r.x) for r in identity.nearest_revision(rows, chain, "k").collect()] == [("k", 2)]


def test_ancestry_of_any_length(spark):
    """A chain of 200, one of 3 into a ring, a ring, a revision of its own, an unknown parent, rows twice; many starts at once."""
    links = [(f"c{k}", f"c{k - 1}") for k in range(1, 200)] * 2 + [("c0", None), ("a2", "a1"), ("a1", "r0"), ("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("s", "s"), ("u", "gone"), (None, "x")]
    revisions = spark.createDataFrame(links, "revision string, parent string")
    starts = spark.createDataFrame([(s,) for s in ("c199", "c57", "c0", "a2", "r1", "s", "u", "unknown", "u", None)], "revision string")
    got = identity.ancestry(revisions, starts).collect()
    chains = {}
    for r in sorted(got, key=lambda r: r.depth):
        chains.setdefault(r.start, []).append("error" if r.error else r.revision)
    want = {"c199": [f"c{k}" for k in range(199, -1, -1)], "c57": [f"c{k}" for k in range(57, -1, -1)], "c0": ["c0"], "u": ["u", "gone"], "unknown": ["unknown"]}
    assert chains == want | {s: ["error"] for s in ("a2", "r1", "s")}


def test_keyed_table(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, n int, at int"
    put = lambda rows, kind=schema: keyed.upsert(spark.createDataFrame(rows, kind), path, ["id"], ["at"])
    seen = lambda **o: sorted(str(tuple(r)) for r in keyed.read(spark, path, ["id"], ["at"], **o).collect())
    put([("a", 1, 1), ("a", 2, 2), ("b", 1, 1), (None, 1, 1)])
    put([("a", 0, 1), ("b", 5, 1), (None, 3, 3)])
    before = keyed.read(spark, path, ["id"], ["at"])
    state = ["('a', 2, 2)", "('b', 5, 1)", "(None, 3, 3)"]
    assert seen() == state and len(keyed.runs(spark, path)) == 2
    keyed.compact(spark, path, ["id"], ["at"])
    assert seen() == state == sorted(str(tuple(r)) for r in before.collect())  # a reader from before the merge still has its runs
    (run,) = keyed.runs(spark, path)
    assert spark.read.parquet(f"{path}/{run}").count() == 3
    assert seen(wanted=[("b",), (None,), ("x",)]) == state[1:]
    for k in range(2 * keyed.MOST_RUNS):
        put([("a", k, 10 + k)])
        assert len(keyed.runs(spark, path)) < keyed.MOST_RUNS
    assert seen() == [f"('a', {2 * keyed.MOST_RUNS - 1}, {9 + 2 * keyed.MOST_RUNS})", *state[1:]]
    assert sum(p.name.startswith("run-") for p in (tmp_path / "t").iterdir()) <= 2 * keyed.MOST_RUNS
    with pytest.raises(FileNotFoundError):
        keyed.read(spark, str(tmp_path / "none"), ["id"], ["at"])


def test_rows_by_place(spark, tmp_path):
    """Two files of 1,000 rows in groups of 100: only groups with wanted rows are read, and the result is that of the join."""
    for name in ("x y", "z"):
        table = pa.table({"v": [f"{name}{i}" for i in range(1000)], "k": list(range(1000)), "image": ["p" * 1000] * 1000})
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=100)
    pq.write_table(pa.table({"v": ["q"], "k": [1], "image": [""]}).slice(0, 0), tmp_path / "empty.parquet")
    path = str(tmp_path)
    index = positions.row_groups(spark, path).cache()
    files = sorted(r.file for r in index.select("file").distinct().collect())
    assert index.groupBy().agg(F.sum("rows")).first()[0] == 2000 and {tuple(r.columns) for r in index.collect()} == {("v", "k", "image")}
    wanted = spark.createDataFrame([(f, k) for f in files for k in (0, 99, 100, 555, 555, 999, 1000, -1)], "file string, row_index long")
    groups = positions.wanted_groups(index, wanted)
    assert groups.count() == 8  # of 20
    got = sorted(tuple(r) for r in positions.rows_at(spark, path, wanted, ["k", "v"], index).collect())
    rows = readers.parquet_tree(spark, path)
    assert got == sorted(tuple(r) for r in rows.join(wanted.distinct(), ["file", "row_index"]).select("file", "row_index", "k", "v").collect()) and len(got) == 10
    assert {(r.file.rsplit("/")[-1], r.rows) for r in positions.inventory(index).collect()} >= {("z.parquet", 1000)}


def test_rings_are_followed_once(spark, monkeypatch):
    sizes = []

    def noted(df, name, stored=identity.stored):
        out = stored(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(identity, "stored", noted)
    # 20 rings of 8, each with a way of 5 into it, whose revisions are greater or less than the ring's; an own parent; a chain.
    links = [(100 * r + i, 100 * r + (i + 1) % 8) for r in range(20) for i in range(8)]
    links += [(sign * (100 * r + 50 + i), sign * (100 * r + 51 + i) if i < 4 else 100 * r + 3) for r in range(20) for i in range(5) for sign in (1, -1)]
    links += [(9001, 9001), (9000, 9001)] + [(10_000 + i, 10_001 + i) for i in range(10)]
    starts = [(a,) for a, _ in links]
    got = identity.ancestry(spark.createDataFrame(links, "revision long, parent long"), spark.createDataFrame(starts, "revision long")).collect()
    wrong = {r.start for r in got if r.error}
    assert wrong == {a for a, _ in links if a < 10_000} and len([r for r in got if r.error]) == len(wrong)
    assert {(r.start, r.revision, r.depth) for r in got if not r.error} == {(10_000 + i, 10_000 + j, j - i) for i in range(10) for j in range(i, 11)}
    assert max(sizes) <= 14 * len(links)
