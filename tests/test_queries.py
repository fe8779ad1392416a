"""Every registered query against its SQL at the smallest scale."""

import pytest
from compare import check, connect

from __spark_entry__ import entry, oracle_sql, queries
from oracle.sql import build
from wellspring.plans import catalog

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SQL, QUERIES = build(), catalog.QUERIES
# Those whose sums and ties need more rows to show a difference.
AT_LARGER = ["silver", "silver_sliced", "rolling_features", "training_set", "time_to_empty", "fix_readings_with_segments"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SQL)
def test_query(spark, con, name):
    found, info = check(spark, con, SF, name, QUERIES[name], SQL[name])
    assert found == [] and info["rows"] > 0


@pytest.mark.parametrize("name", AT_LARGER)
def test_query_on_more_rows(spark, name):
    found, info = check(spark, connect(LARGER), LARGER, name, QUERIES[name], SQL[name])
    assert found == [] and info["rows"] > 0


# Boosted trees have no SQL; tests hold them against a plain loop.
FITTED = {n for n in QUERIES if n.startswith("model_")}


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) - FITTED == set(SQL)
    assert set(queries()) >= set(QUERIES) and set(oracle_sql()) >= set(SQL)


def test_entry(spark):
    assert entry(spark).count() == 24
