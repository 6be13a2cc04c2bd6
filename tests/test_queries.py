"""Every registered query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ctxledger.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, int):
        return v
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert rows
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        expect = sorted(repr(tuple(plain(v) for v in r)) for r in found.fetchall())
        assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows) == expect


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_results_of_an_unsupported_model_at_a_page_edge(spark, tmp_path):
    """texts between a full page of the default profile (152 x 184) and one of the slab's (312 x 90), and on either side of both."""
    sizes = [152 * 184 - 1, 152 * 184, 152 * 184 + 1, 28_000, 312 * 90, 312 * 90 + 1, 2 * 28_000, 10]
    texts = [(user + 150 * (k + 1), "x" * n) for user in (0, 8) for k, n in enumerate(sizes)]  # user 8 asks mistral, user 0 claude
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    events = [(i, 1_700_000_000 + i, 8 * (i % 2), "view", 1.0, '{"k": 1}') for i in range(20)]
    rows = spark.createDataFrame(events, "event_id long, s long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    expect = sorted(con.execute(f"SELECT request_id, idx, pages, reason FROM ({registry.ORACLES['compaction_results']})").fetchall())
    found = registry.QUERIES["compaction_results"](spark, str(tmp_path)).collect()
    assert sorted((r["request_id"], r["idx"], r["pages"], r["reason"]) for r in found) == expect
    assert [r[2] for r in expect if r[3] == "unsupported_model"] == [1, 1, 1, 1, 1, 2, 2, 1]
