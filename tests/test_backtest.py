import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import research as rs
from tidemark.sources import store


def test_positions():
    p = bt.Position().filled(10, 100.0, 1.0).filled(10, 110.0)
    assert (p.qty, p.cost, p.cash) == (20, 105.0, -2101.0)
    p = p.split(2)
    assert (p.qty, p.cost) == (40, 52.5)
    assert p.dividend(0.5).cash == -2081.0
    p = p.filled(-50, 60.0)
    assert (p.qty, p.cost, p.realized) == (-10, 60.0, 300.0) and p.unrealized(50.0) == 100.0
    with pytest.raises(ValueError):
        bt.Position(3, 1.0).split(0.5)


def test_states_report_what_cannot_be(spark):
    schema = "ticker string, ts long, seq long, kind string, qty double, price double, commission double, ratio double, per_share double"
    rows = [("A", 1, 1, "fill", 3.0, 10.0, None, None, None), ("A", 2, 2, "split", None, None, None, 0.5, None), ("A", 3, 3, "split", None, None, None, 2.0, None), ("A", 4, 4, "gift", None, None, None, None, None)]
    got = bt.states(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert [r["position"] for r in got] == [3.0, 3.0, 6.0, 6.0] and [r["error"] is None for r in got] == [True, False, True, False]


def panel(spark, n=60):
    rng = np.random.default_rng(3)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, (n, 3)), axis=0))
    rows = [(f"2020-01-{1 + i:02d}" if i < 31 else f"2020-02-{i - 30:02d}", t, float(px[i, k]) if (i, k) != (5, 1) else None) for i in range(min(n, 60)) for k, t in enumerate("ABC")]
    return spark.createDataFrame(rows, "d string, ticker string, price double").select(F.to_date("d").alias("date"), "ticker", "price")


def test_replay_keeps_the_books(spark):
    prices = panel(spark)
    weights = prices.filter("date IN (DATE'2020-01-01', DATE'2020-02-01')").select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("run_id"), "date", "ticker", F.lit(1 / 3).alias("weight"))
    frames = bt.replay(prices, weights, bt.Constraints(bps=5.0, min_notional=0.0)).orderBy("run_id", "date").toPandas()
    x = frames[frames["run_id"] == "x"].reset_index(drop=True)
    assert len(x) == 60 and x["n_skipped"].sum() == 1 and np.allclose(x["nav"], frames[frames["run_id"] == "y"]["nav"])
    # by hand: first day
    first = prices.filter("date = DATE'2020-01-01'").toPandas()
    qty = np.round((1e6 * 0.98 / 3) / first["price"])
    cost = float((qty * first["price"]).sum() * 5 / 1e4)
    assert np.isclose(x["cost"][0], cost) and np.isclose(x["nav"][0], 1e6 - cost) and np.isclose(x["cash"][0], 1e6 - cost - float((qty * first["price"]).sum()))
    assert np.allclose(x["nav"][1:].to_numpy() / x["nav"][:-1].to_numpy() - 1, x["ret"][1:]) and (x["gross"] <= 1.0).all()
    with pytest.raises(bt.CostsTooLow):
        bt.replay(prices, weights, bt.Constraints(bps=0.0))
    found = bt.run_backtest(prices, weights, benchmark=prices.filter("ticker = 'A'").select("date", F.lit(0.001).alias("bench")))
    table = bt.summary_table(found["report"])
    assert table.startswith("| metric | ") and found["relative"].count() == 2 and bt.tearsheet(found["frames"]).count() == 120


def test_recovery_reconciliation_and_checks(spark):
    schema = "seq long, kind string, order_id long, fill_id long, ticker string, qty double, price double, commission double"
    journal = [(1, "sent", 1, None, "A", 10.0, None, None), (2, "fill", 1, 7, "A", 4.0, 5.0, 0.0), (3, "fill", 1, 7, "A", 4.0, 5.0, 0.0), (4, "sent", 2, None, "B", 5.0, None, None), (5, "fill", 2, 8, "B", 5.0, 2.0, 0.0), (6, "filled", 2, None, "B", None, None, None)]
    found = bt.recovered(spark.createDataFrame(journal, schema))
    assert {r["ticker"]: r["qty"] for r in found["positions"].collect()} == {"A": 4.0, "B": 5.0}
    assert [(r["order_id"], r["left"]) for r in found["pending"].collect()] == [(1, 6.0)] and found["repeats"].count() == 1
    a = spark.createDataFrame([("A", 4.0, 5.0), ("B", 5.0, 2.0)], "ticker string, qty double, avg_cost double")
    bt.assert_reconciled(a, a, 10.0, 10.5)
    with pytest.raises(bt.NotReconciled, match="CASH"):
        bt.assert_reconciled(a, a, 10.0, 20.0)
    with pytest.raises(bt.NotReconciled):
        bt.assert_reconciled(a, a.filter("ticker = 'A'"), 10.0, 10.0)
    bt.assert_reconciled(a, a.filter("ticker = 'A'"), 10.0, 10.0, ignore=("B",))
    one = spark.range(1).select(*(bt.untradeable_weight(p, F.lit(False), F.lit(0.3), F.lit(0.2)).alias(p.value) for p in bt.NoTrade)).first()
    assert (one["hold"], one["flatten"], one["decay"]) == (0.2, 0.0, 0.1)


def test_daily_cycle(spark, tmp_path):
    prices = panel(spark).withColumnsRenamed({"price": "close"}).withColumn("adv", F.lit(1e9))
    signals = prices.select("ticker", "date", F.lit(0.2).alias("weight"), F.lit(0.1).alias("lower"), F.lit(0.3).alias("upper"))
    held = spark.createDataFrame([("A", 10.0, 100.0)], "ticker string, qty double, avg_cost double")
    runs = store.RunStore(spark, f"{tmp_path}/runs")
    out = bt.daily_cycle("2020-02-10", signals=signals, prices=prices, positions=held, broker=held, cash=1e6, broker_cash=1e6, runs=runs, run_id="day", max_weight=0.3, gate={"max_weight": 0.5})
    assert out["fills"].count() == 3 and out["rejected"].count() == 0
    after = {r["ticker"]: r["qty"] for r in out["positions"].collect()}
    fills = {r["ticker"]: r["qty"] for r in out["fills"].collect()}
    assert after["A"] == 10 + fills["A"] and after["B"] == fills["B"] and len(out["digest"].first()["digest"]) == 64
    assert runs.load("day")["fills"].count() == 3
    with pytest.raises(bt.NotReconciled):
        bt.daily_cycle("2020-02-10", signals=signals, prices=prices, positions=held, broker=held, cash=1.0, broker_cash=1e6)


def test_signature_of_a_line_and_of_a_product():
    line = np.array([[0.0, 0.0], [1.0, 2.0], [2.0, 4.0]])
    s = rs.signature(line, 3)
    d = np.array([2.0, 4.0])
    want = np.concatenate((d, np.multiply.outer(d, d).ravel() / 2, np.multiply.outer(np.multiply.outer(d, d), d).ravel() / 6))
    assert np.allclose(s, want)
    bent = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])  # first along x, then along y
    _, _, _, xy, yx, _ = rs.signature(bent, 2)
    assert (xy, yx) == (1.0, 0.0)
    assert rs.augmented(bent, ("leadlag",)).shape == (5, 4) and rs.augmented(bent, ("basepoint", "addtime")).shape == (4, 3)
    assert len(rs.signature_names(["a"], 2, ("addtime",))) == 6


def test_block_length_grows_with_dependence(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k, rho in enumerate((0.0, 0.6, 0.9)):
        x = 0.0
        for t in range(800):
            x = rho * x + rng.normal()
            rows.append((k, t, float(x)))
    got = {r["k"]: r["block"] for r in rs.block_length(spark.createDataFrame(rows, "k long, t long, x double"), "k", ["t"], "x").collect()}
    assert got[0] < got[1] < got[2] <= 400


def test_estimates_and_catalog(spark):
    a = np.random.default_rng(1).normal(size=(300, 5))
    found = rs.estimates(a)
    assert np.allclose(found["sample"], np.cov(a.T)) and all(np.linalg.eigvalsh(c).min() > 0 for c in found.values())
    assert rs.reference_critical_values(200)["sadf"] == 1.40 and rs.reference_critical_values(50)["clamped"]
    assert 1.40 < rs.reference_critical_values(300)["sadf"] < 1.49
    assert [s.name for s in rs.FACTORS.search("SPREAD")] and rs.FACTORS.categories() == ["cross-section", "information", "microstructure"]
    assert callable(rs.FACTORS.get("momentum").resolve()) and all(callable(s.resolve()) for s in rs.FACTORS.list())
    with pytest.raises(ValueError):
        rs.FACTORS.register(rs.FACTORS.get("momentum"))
    assert rs.FACTORS.frame(spark).count() == len(rs.FACTORS.specs)
    assert rs.selected_lag(np.cumsum(np.random.default_rng(2).normal(size=300))) <= 2
    assert rs.code_version("/").commit == "unknown"
    df = spark.range(3)
    from tidemark.operators import provenance

    found = provenance.manifest(df, {}, "c")
    assert rs.manifest_check(found, df, "c")["reproducible"] and rs.manifest_check(found, spark.range(4), "c")["detail"] == "run_id, data"
    assert rs.panels_fingerprint({"a": df}) != rs.panels_fingerprint({"b": df}) and '"id": 2' in rs.as_json(df)


def test_alpha_nco_and_optimal_d(spark):
    rng = np.random.default_rng(5)
    days = spark.sql("SELECT explode(sequence(DATE'2020-01-01', DATE'2020-12-31')) AS date").filter(F.weekday("date") < 5).toPandas()["date"].tolist()
    rows = [(d, a, float(rng.normal(0.001 * a, 0.01))) for d in days for a in range(5)]
    returns = spark.createDataFrame(rows, "date date, asset long, ret double")
    signals = returns.select("date", "asset", (F.col("asset") * 0.001).alias("mu"))
    out = rs.alpha_nco(signals, returns, rs.AlphaNco(lookback=60))
    w = out["weights"].groupBy("rebalance").agg(F.sum(F.abs("weight")).alias("g")).collect()
    assert len(w) >= 10 and all(r["g"] <= 2.0 + 1e-9 for r in w)
    daily = out["daily"].toPandas()
    assert (daily["cost"] >= 0).all() and np.allclose(daily["net"], daily["gross"] - daily["cost"])
    walk = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(np.cumsum(rng.normal(size=600)))], "k long, t long, x double")
    d = rs.optimal_d(walk, "k", ["t"], "x", threshold=1e-3).first()
    assert 0 < d["d"] <= 1 and d["adf"] < -2
