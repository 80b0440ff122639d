"""Every named query against its SQL."""

import pytest

from benchloom.plans import catalog

from .compare import database, from_duckdb, from_spark

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, sf_dir, db):
    assert from_spark(catalog.queries()[name](spark, sf_dir)) == from_duckdb(db, SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 8
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
