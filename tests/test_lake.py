import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.sources import store


def test_layout_and_universe(spark, tmp_path):
    lay = store.Layout("/lake/")
    assert lay.path("raw", "x") == "/lake/raw/x" and lay.raw("ab" * 32) == f"/lake/raw/ab/ab/{'ab' * 32}.parquet"
    with pytest.raises(ValueError):
        lay.raw("short")
    (tmp_path / "u.txt").write_text("A\n\n# note\nB # the second\nA\n")
    assert sorted(r[0] for r in store.universe(spark, str(tmp_path / "u.txt")).collect()) == ["A", "B"]


def test_writers_and_readers(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.0), ("B", 3.0)], "ticker string, x double")
    store.write_by_key(df, f"{tmp_path}/k")
    assert sorted(p.name for p in (tmp_path / "k").glob("ticker=*")) == ["ticker=A", "ticker=B"]
    df.write.option("header", True).csv(f"{tmp_path}/p.csv")
    assert store.read_panel(spark, f"{tmp_path}/p.csv").count() == 3
    made = []

    def vendor():
        made.append(1)
        return spark.sql("SELECT TIMESTAMP'2020-01-02 10:00:00' AS ts, 'A' AS instrument, explode(array(1.0D, 0.0D, 2.0D)) AS close")

    for _ in range(2):
        assert store.cached_daily(spark, f"{tmp_path}/daily", vendor).count() == 2
    assert made == [1]
    spark.sql("SELECT explode(array(TIMESTAMP'2020-01-02', TIMESTAMP'2020-01-02')) AS ts").write.parquet(f"{tmp_path}/twice")
    with pytest.raises(ValueError):
        store.load_prices(spark, f"{tmp_path}/twice")


def test_signals(spark, tmp_path):
    good = spark.createDataFrame([("A", 0.1, 0.0, 0.2), ("B", -0.1, -0.2, 0.0)], "ticker string, expected_return double, lower double, upper double")
    manifest = store.write_signal(good, f"{tmp_path}/s", run_id="r1", model_sha="m", as_of="2020-01-01", alpha=0.1, extra={"note": 1})
    back, read = store.read_signal(spark, f"{tmp_path}/s")
    assert read == manifest and back.count() == 2
    for bad, alpha in ((good.unionByName(good), 0.1), (good, 1.0), (good.withColumn("upper", F.lit(-9.0)), 0.1), (good.withColumn("lower", F.lit(float("nan"))), 0.1)):
        with pytest.raises(ValueError):
            store.check_signal(bad, alpha)
    with pytest.raises(ValueError):
        store.write_signal(good, f"{tmp_path}/t", run_id="r", model_sha="m", as_of="x", alpha=0.1, extra={"alpha": 2})


def test_runs_and_journal(spark, tmp_path):
    runs = store.RunStore(spark, f"{tmp_path}/runs")
    assert runs.list().count() == 0
    runs.save({"fills": spark.range(3)}, run_id="a", digest="d", metadata={"k": 1})
    runs.save({"fills": spark.range(2)}, run_id="b", digest="e")
    with pytest.raises(ValueError):
        runs.save({}, run_id="a", digest="d")
    assert [r["run_id"] for r in runs.list().collect()] == ["b", "a"] and runs.load("a")["fills"].count() == 3
    runs.delete("b")
    with pytest.raises(KeyError):
        runs.load("b")
    journal = store.Journal(spark, f"{tmp_path}/j")
    assert journal.read("id long").count() == 0
    journal.append(spark.range(2))
    journal.append(spark.range(2, 5))
    assert sorted(r[0] for r in journal.read("id long").collect()) == [0, 1, 2, 3, 4]


def test_features_are_computed_once_for_what_is_known(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('A', DATE'2020-01-01', TIMESTAMP'2020-01-02', 0L, 1.0D), ('A', DATE'2020-01-01', TIMESTAMP'2020-02-02', 1L, 2.0D) AS t(entity, event_date, knowledge_date, seq, x)")
    registry, calls = store.FeatureRegistry(), []

    def double(prices):
        calls.append(1)
        return prices.read().select("entity", (F.col("x") * 2).alias("y"))

    spec = registry.register("double", "1", double, ("prices",))
    with pytest.raises(ValueError):
        registry.register("double", "1", lambda prices: prices.read(), ("prices",))
    tables = {"prices": (rows, ("entity",))}
    get = lambda at: store.materialize(spark, f"{tmp_path}/f", tables, spec, at).first()["y"]
    assert (get("2020-01-15"), get("2020-01-15"), get("2020-03-01")) == (2.0, 2.0, 4.0) and len(calls) == 2


def test_synthetic_ticks_do_not_depend_on_partitions(spark):
    a = store.synthetic_ticks(spark, 200, seed=3).collect()
    assert a == store.synthetic_ticks(spark, 200, seed=3).orderBy("seq").collect() and a[0]["price"] != store.synthetic_ticks(spark, 200, seed=4).first()["price"]


def test_append_numbers_once_and_keeps_the_order_of_versions(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("entity"), F.lit("2020-01-01").cast("date").alias("event_date"), F.lit("2020-01-02").cast("timestamp").alias("knowledge_date"), F.col("id").alias("x"))
    first = pit.append(None, rows, ["entity"])
    assert sorted(r["seq"] for r in first.select("seq").collect()) == list(range(500))
    known = {r["entity"]: r["x"] for r in pit.as_of(first, ["entity"], "2021-01-01").collect()}
    assert known == {k: max(i for i in range(500) if i % 7 == k) for k in range(7)}
    more = pit.append(first, rows.limit(3), ["entity"])
    assert more.agg(F.max("seq")).first()[0] == 502
    with pytest.raises(ValueError):
        pit.append_checked(first, rows.limit(1), ["entity"])


def test_identities(spark):
    ids = spark.createDataFrame([(1, "A"), (2, "B")], "id long, symbol string")
    got = {r["symbol"]: r["id"] for r in pit.mint(ids, spark.createDataFrame([("A",), ("C",), ("D",), ("C",), (None,)], "symbol string")).collect()}
    assert got["A"] == 1 and {got["C"], got["D"]} == {3, 4} and len(got) == 3
    good, bad = pit.ric_mapping(spark.createDataFrame([("AAPL.O",), ("??",), (None,)], "ric string"), ids)
    assert [r["ric"] for r in good.collect()] == ["AAPL.O"] and bad.count() == 2
    symbology = spark.sql("SELECT * FROM VALUES (10, 'A', DATE'2000-01-01', DATE'2010-01-01'), (11, 'A', DATE'2005-01-01', CAST(NULL AS DATE)), (12, 'E', DATE'2000-01-01', CAST(NULL AS DATE)) AS t(iid, symbol, valid_from, valid_to)")
    rics = spark.createDataFrame([("A.N", "A"), ("Z.N", "Z")], "ric string, symbol string")
    master = pit.unified_master(ids, symbology, rics)
    assert master["overlaps"].count() == 1 and [r["symbol"] for r in master["minted"].collect()] == ["Z"]
    assert {r["iid"]: r["id"] for r in master["instruments"].collect()}[10] == 1
    state = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP'2020-01-01', DATE'2020-01-05', 'member', CAST(NULL AS DOUBLE)), (1L, TIMESTAMP'2020-02-01', DATE'2020-02-05', 'delisted', CAST(NULL AS DOUBLE)) AS t(entity, announced, effective, status, delisting_return)")
    assert pit.membership(state, "2020-01-10").first()["status"] == "member" and pit.membership(state, "2020-03-01").first()["return_missing"]
