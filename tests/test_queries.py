"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    found = duck.execute(entry.oracle_sql()[name])
    expect = rows([c[0] for c in found.description], found.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == expect


def test_queries_without_sql_have_rows(spark, sf):
    rest = set(entry.queries()) - set(entry.oracle_sql())
    for name in sorted(n for n in rest if not n.startswith("op") and n != "pipeline"):
        assert entry.queries()[name](spark, sf).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
