"""Every named query against its check SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from vigilake.plans.adapter import TABLES

SF_DIR = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()
# slow without a check; their native twins have one, the metric itself is tested in test_greedy_rules and test_streams
COVERED_ELSEWHERE = {"screened_with_history", "group_records", "group_badges", "verified_incidents",
                     "screened_day_articles", "incident_groups"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 9) if isinstance(value, float) else value


def test_every_check_has_its_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_check(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in row) for row in df.select(*columns).collect()), key=str)
    result = duck.execute(CHECKS[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=str)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS) - COVERED_ELSEWHERE))
def test_unchecked_query_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
