"""The pipeline's stages on the driver's documents."""

import corpus_pipeline
from benchloom.llm import decontaminate, quality_model, queries, simhash
from benchloom.llm.common import stored


def test_stages(spark, sf_dir):
    documents = queries.table(spark, sf_dir, "documents")
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == documents.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    ids = {r.doc_id for r in documents.collect()}
    good = {r.doc_id for r in quality_model.score(documents, queries.table(spark, sf_dir, "labels")).where("predicted = 1").collect()}
    assert set(kept["quality"]) == good < ids
    assert set(kept["lines"]) == good and any(kept["lines"][d] != t for d, t in kept["quality"].items())
    assert set(kept["near_duplicates"]) < set(kept["lines"])
    assert decontaminate.leaks(docs, queries.table(spark, sf_dir, "benchmark")).count() == 0
    assert simhash.keep_one(docs).count() == docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(kept["decontamination"])
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "one two", "en", None, 7), (None, "one two", "en", None, 7), (4, "word " * 20_000, "en", "s", 1), (4, "word " * 20_000, "en", "s", 1), (5, " \n\t", "de", "t", 3)]
    odd = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, hub long, key string, signature int")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, odd.where("false"), sf_dir)
        assert none.count() == 0 and (name == "packing" or none.columns == odd.columns)
    results = {name: stage(spark, odd, sf_dir) for name, stage in corpus_pipeline.STAGES}
    got = {name: sorted((r.doc_id or 0, (r.text or "")[:9], r.hub, r.key, r.signature) for r in out.collect()) for name, out in results.items() if name != "packing"}
    whole = sorted((d or 0, (t or "")[:9], 1, "k", 2) for d, t, *_ in rows)
    # The classifier was fitted on prose: none of these is.
    assert set(got["quality"]) <= set(whole) and all(got["quality"].count(r) in (0, whole.count(r)) for r in whole)
    assert got["lines"] == got["decontamination"] == whole
    assert [d for d, *_ in got["near_duplicates"]] == [0, 0, 1, 4]
    assert results["lines"].where("doc_id = 1").first().text is None
    pieces = results["packing"].groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {1: 1, 2: 1, 5: 1, 4: 40_002, None: 6}


def test_lines_of_documents_that_are_mostly_boilerplate(spark, sf_dir):
    licence = "All rights reserved under the licence of this network of sites"
    body = "\n".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(20))
    rows = [(k, f"page {k} own\n{licence}", f"site{k}") for k in range(12)]
    rows += [(100 + k, f"{body} last{k}\n{licence}", f"site{k}") for k in range(12)]  # near copies on 12 sites
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, sf_dir).collect()}
    assert got == {d: t.removesuffix("\n" + licence) for d, t, _ in rows}
