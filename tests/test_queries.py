"""Every registered query against its SQL twin."""

import os

import pytest

from checks import compare, oracles
from checks.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


def test_every_query_but_the_learned_one_has_sql():
    assert set(QUERIES) - set(SQL) == {"learned_classifier"} and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    if name in SQL:
        assert compare.differences(got, con.sql(SQL[name]).df()) == []
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns[0] == "url" and rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
