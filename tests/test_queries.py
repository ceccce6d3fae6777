"""Every registered query against its SQL, or for presence of rows where SQL has no counterpart."""

import pytest

import __spark_entry__ as entry
from compare import assert_same

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, data, duck):
    assert_same(QUERIES[name](spark, data).toPandas(), duck.execute(SQL[name]).df())


# Trip extraction needs long vehicle days, which the smallest tables do not hold.
MAY_BE_EMPTY = {
    "g02_pair_trips", "g03_choose_shapes", "g04_build_trips", "j02_trips_shapes_stops", "w05_stop_visits", "w02_labelled_visits"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    rows = QUERIES[name](spark, data)
    assert rows.columns
    assert rows.count() > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0
