import pytest
from pyspark.sql import functions as F

from benchloom.functions import parsing


def test_table_and_grid():
    rows = parsing.html_table("<table><tr><th rowspan='2'>a</th><td colspan=2>b<br>c</td></tr><tr><td>d</td><td>e</td></tr></table>")
    assert rows[0][1] == {"text": "b\nc", "rowspan": 1, "colspan": 2}
    assert [(c["row"], c["column"]) for c in parsing.grid_positions(rows)] == [(0, 0), (0, 1), (1, 1), (1, 2)]


@pytest.mark.parametrize("page", ["<table><tr><td><table></table></td></tr></table>", "<table></table><table></table>"])
def test_one_table_only(page):
    with pytest.raises(ValueError):
        parsing.html_table(page)


@pytest.mark.parametrize("page", ["<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "<table><tr><td rowspan=2>a</td></tr></table>", "<table></table>", "<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr></table>"])
def test_bad_grids(page):
    with pytest.raises(ValueError):
        parsing.grid_positions(parsing.html_table(page))


def test_outside_text():
    page = "<p>x</p><style>s</style><table><caption>c <b>d</b></caption><tr><td>t</td></tr></table>y<script>z</script>"
    assert parsing.outside_text(page) == (["x", "y"], "c d")


def test_table_spec_keeps_numbers_verbatim():
    spec = parsing.table_spec([[{"text": "Year"}, {"text": "1e3"}], [{"text": "03.00"}, {"text": "Year"}]])
    assert [[c["label_key"] for c in row] for row in spec] == [["label_000", None], [None, "label_000"]]
    assert spec[1][0]["text"] == "03.00"


def test_markdown_blocks_and_spans(spark):
    from benchloom.session import ship

    ship(spark)
    text = "é\n| a | b |\n|---|:-:|\n| 1 | 2 |\nx\n| z |"
    r = spark.createDataFrame([(text,)], "t string").select(parsing.markdown_spans("t").alias("s"), parsing.markdown_blocks(F.col("t")).alias("b"), parsing.markdown_rows(F.col("t")).alias("rows")).first()
    assert [text[x.start : x.end] for x in r.s] == r.b and len(r.b) == 2
    assert r.rows == [["a", "b"], ["1", "2"], ["z"]]


def test_batches_of_pages_are_bounded(spark, tmp_path):
    from pyspark.sql import functions as F
    from pyspark.sql.types import LongType

    from benchloom import session
    from benchloom.plans.catalog import queries

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.range(5000, numPartitions=1).select(F.col("id").alias("page_id"), F.lit("<p>a</p>").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.text for r in queries()["html_text"](spark, str(tmp_path)).collect()} == {"a"}
    sizes = F.pandas_udf(lambda column: column * 0 + len(column), LongType())
    assert spark.range(5000, numPartitions=1).select(F.max(sizes("id"))).first()[0] <= session.BATCH_ROWS
