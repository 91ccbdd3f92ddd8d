"""Every query that has SQL gives the same rows in Spark and in DuckDB."""

import glob
import os

import duckdb
import pytest

from pyspark.sql import functions as F

from folioflow.plans import catalog
from folioflow.streaming import loop

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(([r[c] for c in cols] for r in df.collect()), key=str)
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    theirs = sorted(([row[rel.columns.index(c)] for c in cols] for row in rel.fetchall()), key=str)
    assert mine == theirs


def test_entry_is_stable(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["gate", "n"] and len(e.entry(spark).collect()) > 3
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["change_gate", "gate_summary", "recency_filter"])
def test_gated_queries_have_rows(spark, name):
    assert 0 < len(catalog.QUERIES[name](spark, SF).collect()) <= 200


def test_cooldown_counts_fractions_and_orders_ties(spark, tmp_path):
    path = str(tmp_path / "events.parquet")
    con = duckdb.connect()
    rows = "(1, '12:00:00.9', 1), (2, '13:00:00.8', 1), (3, '14:00:00.8', 1), (4, '14:59:59.9', 2), (5, NULL, 2), (6, '15:00:00', 2), (7, '12:00:00', NULL), (8, '12:00:00.1', NULL)"
    con.execute(f"COPY (SELECT id AS event_id, DATE '2024-01-01' + CAST(clock AS TIME) AS ts, user_id FROM (VALUES {rows}) t(id, clock, user_id)) TO '{path}'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    got = sorted(map(tuple, catalog.cooldown_gate(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.ORACLES["cooldown_gate"]).fetchall())
    assert [i for i, deferred in got if deferred] == [2, 6, 8]
    # Of events of one time, the SQL leaves open which is first: it is the smallest id, however rows are dealt.
    same = spark.createDataFrame([(i, 0) for i in (5, 3, 9, 1, 7)], "event_id long, at long").select("event_id", F.timestamp_seconds("at").alias("ts"), F.lit(1).alias("user_id"))
    for order in ("event_id", F.desc("event_id")):
        found = loop.cooled_down(same.orderBy(order), "user_id", "ts", 60, "event_id").where("not deferred")
        assert [r.event_id for r in found.collect()] == [1]
