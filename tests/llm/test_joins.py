"""Joins of tables that grow with the input: neither side goes whole through the driver, however small Spark takes it for."""

import pytest

from benchloom.llm import line_dedup, simhash, tiles
from benchloom.operators import clusters


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that these modules store."""
    found = []

    def noted(df, name, stored=simhash.stored):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    for module in (simhash, clusters, line_dedup):
        monkeypatch.setattr(module, "stored", noted)
    return found


def texts(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[: 39 - i % 3], f"x{i}", f"y{i}"][i % 2 :])) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_sends_no_table_through_the_driver(spark, plans):
    plans.append(plan(simhash.simhash_components(texts(spark))))
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]


def test_near_duplicates_send_no_table_through_the_driver(spark, plans):
    plans.append(plan(simhash.keep_one(texts(spark))))
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]


def test_tiles_send_no_table_through_the_driver(spark):
    rows = spark.createDataFrame([(0, 1, i, i % 3) for i in range(9)], "table int, key long, rep long, label long")
    assert "Broadcast" not in plan(tiles.tiles_of(rows))


def test_removed_lines_send_no_places_through_the_driver(spark):
    docs = spark.createDataFrame([(i, f"common line\nown line {i}", f"s{i}") for i in range(20)], "doc_id long, text string, source string")
    found = line_dedup.remove_boilerplate(docs)
    assert "Broadcast" not in plan(found) and {r.n_removed for r in found.collect()} == {1}
