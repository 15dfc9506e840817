"""Every registered query with check SQL equals DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)
    return a == b


def sorted_rows(rows):
    return sorted(rows, key=repr)


#: Results whose order is part of them.
ORDERED = ["t2_top_customers", "t4_top_high_risk", "t9_p8_requests_newest_first", "s7_most_recent", "s7_retained_log", "a18_popular_actions", "a15_r3_segment_counts", "t7_preview"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, duck, name):
    df = entry_points.queries()[name](spark, sf)
    columns = sorted(df.columns)
    plain = list if name in ORDERED else sorted_rows
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = plain(tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall())
    assert len(got) == len(want)
    for ours, theirs in zip(got, want):
        assert all(map(same, ours, theirs)), (ours, theirs)


#: Their own tests in tests/llm run them.
ELSEWHERE = ("op", "pipeline")


@pytest.mark.parametrize("name", sorted(n for n in set(entry_points.queries()) - set(SQL) if not n.startswith(ELSEWHERE)))
def test_query_without_sql(spark, sf, name):
    """No SQL can say what a learner finds; the result has rows and no column is empty."""
    rows = entry_points.queries()[name](spark, sf).collect()
    assert rows and all(any(r[c] is not None for r in rows) for c in rows[0].__fields__)


def test_ordered_results_are_registered():
    assert set(ORDERED) <= set(SQL)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5


def test_every_check_has_a_query():
    assert set(SQL) <= set(entry_points.queries())
