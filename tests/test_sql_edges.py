"""Queries against their SQL, value for value, on prices of 0, missing prices and ties of rounding."""

import math
from collections import Counter

import duckdb
import pytest

from tidemark.plans import registry

PRICES = [
    [3.0, 0.0, 2.0, 2.5, 0.0, 0.0, 1.0, 9.0, 2.0, 2.1, 5.0, 1.0, 1.5, 1.4],
    [0.0, 3.0, 2.0, 2.5, 8.0, 1.0, 1.2],
    [3.0, 2.0, 2.5, 8.0, 1.0, 0.0],
    [1.0, 1.1, None, 4.0, 4.1, 0.3, 0.31, 2.0],
    [5.0],
    [0.16, 1.4407499999999999, 1.44075, 3.0, 0.08, 0.7203749],
]
LINES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM '/root/testdata/sf0.01/lineitem.parquet' WHERE l_suppkey < 30"
QUERIES = "label_cusum label_sample_weights label_ewm_vol label_triple_barrier stream_cusum cat_price_fundamentals ex_states".split()


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    folder = tmp_path_factory.mktemp("edges")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    for user, prices in enumerate(PRICES):
        con.executemany("INSERT INTO e VALUES (?, TIMESTAMP '2024-01-01' + INTERVAL (?) MINUTE, ?, 'view', ?, '{\"k\": 1}')", [(100 * user + k, k, user, p) for k, p in enumerate(prices)])
    for name, sql in (("events", "FROM e"), ("lineitem", LINES), ("orders", "FROM '/root/testdata/sf0.01/orders.parquet'")):
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    return con, str(folder)


def exact(row):
    return tuple("NaN" if isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", QUERIES)
def test_equal_value_for_value(spark, edges, name):
    con, folder = edges
    found = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    want = Counter(map(exact, found.fetchall()))
    assert Counter(map(exact, registry.queries()[name](spark, folder).select(*names).collect())) == want


def test_bootstrap_broadcasts_no_rows(spark):
    from tidemark.operators import labels

    rows = spark.range(100_000).selectExpr("id % 10 instrument", "cast(id div 10 as int) pos", "id * 1.5 price")
    out = labels.block_bootstrap(rows, 5, 3)
    assert out.count() == 300_000
    out.collect()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
