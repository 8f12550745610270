"""Queries beside their DuckDB text, on the smallest tables."""

import os

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
SOME = ["held_set", "order_edges", "edge_evidence", "call_graph", "rta_dispatch", "must_entry_strict", "interproc_edges", "ipc_outgoing", "race_report", "guard_fallback", "line_asof", "alias_closure", "context_window", "flow_order_edges"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = [f"\"{c}\"" for c in sorted(df.columns)]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
