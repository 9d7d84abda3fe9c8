"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import decimal

import duckdb
import pytest

from claimforge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    session = duckdb.connect()
    for name in TABLES:
        session.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return session


def plain(v):
    return round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v


def in_order(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, tables, name):
    df = registry.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert in_order(got) == in_order(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_lists_all(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_exception_message_of_any_order(spark, tmp_path):
    """Keys of 0 and below, and priorities that name a failure, say nothing of an order's run."""
    sql = """SELECT * FROM (VALUES (0, 'O', '2-HIGH'), (-1, 'O', '1-URGENT'), (0, 'F', '5-LOW'), (1, 'P', '5-LOW'), (2, 'O', '失败'), (3, NULL, '5-LOW'), (4, 'F', NULL), (NULL, 'O', '5-LOW')) v(o_orderkey, o_orderstatus, o_orderpriority)"""
    session = duckdb.connect()
    session.sql(f"COPY ({sql}) TO '{tmp_path}/orders.parquet'")
    session.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = [tuple(r) for r in registry.QUERIES["q_exception_message"](spark, str(tmp_path)).select("run_id", "message").collect()]
    assert in_order(got) == in_order(session.sql(registry.ORACLES["q_exception_message"]).fetchall())
