"""Questions in any script, judged as the SQL of the queries judges them."""

import itertools
import random

import pytest

from benchloom.plans import catalog

from .compare import database, from_duckdb, from_spark

PARTS = ["is", "Do", "doeſ", "İſ", "ſuppose", "if", "IF", "why", "explain", "ó", "ñ", "é", "ıf", "_", "7", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", " ", "́", "是", "A)", "d.", "general observation", "?"]
REPLIES = ["Yes.", "no", "", " ", "N/A", "a reply", None]


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = ["".join(p) for n in (1, 2) for p in itertools.product(PARTS, repeat=n)] + ["".join(rng.choices(PARTS, k=rng.randint(3, 7))) for _ in range(1500)] + ["", None]
    rows = [r for i, t in enumerate(texts) for r in ((i, 0, "user", t), (i, 1, "assistant", REPLIES[i % 7] if i % 3 else "a reply"))]
    rows += [(10_000 + i, 0, role, "Do ó") for i, role in enumerate(["system", None, "User"])] + [(10_100, 0, "user", "a"), (10_100, 2, "user", "b"), (None, 0, "user", "a")]
    folder = tmp_path_factory.mktemp("questions")
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).toPandas().astype({"conv_id": "Int64"}).to_parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["identified_candidates", "normal_qa_filter"])
def test_equals_sql_on_odd_texts(name, spark, conversations):
    got, want = from_spark(catalog.queries()[name](spark, conversations)), from_duckdb(database(conversations), catalog.oracle_sql()[name])
    assert len(want[1]) > 100 and got == want
