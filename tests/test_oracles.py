"""Every registered query against its DuckDB twin on the driver's smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([value(v) for v in x])
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.5g}" if abs(float(x)) > 1e-9 else "0"
    return str(x)[:19]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows or got.columns
        return
    out = duck.execute(sql)
    names = [d[0] for d in out.description]
    want = out.fetchall()
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    a = sorted(tuple(value(r[c]) for c in order) for r in rows)
    b = sorted(tuple(value(dict(zip(names, r, strict=True))[c]) for c in order) for r in want)
    assert len(a) == len(b)
    assert a == b
