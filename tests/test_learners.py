import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast as fc
from tidemark.operators import learners as ln


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 600
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * a - b + rng.normal(size=n)
    data = [(i % 3, i // 3, i // 3 + 1, i, float(a[i]), float(b[i]), float(y[i]), int(y[i] > 1)) for i in range(n)]
    return spark.createDataFrame(data, "instrument long, t0 long, t1 long, id long, a double, b double, y double, up int")


def columns(rows, *names):
    return rows.orderBy("id").select(*names).toPandas().to_numpy().T


def test_linear_is_least_squares(rows):
    a, b, y = columns(rows, "a", "b", "y")
    want = np.linalg.lstsq(np.column_stack((np.ones(len(a)), a, b)), y, rcond=None)[0]
    model = ln.fit_linear(rows, ["a", "b"], "y")
    assert np.allclose([model.intercept, *model.coef], want)
    got = rows.withColumn("p", model.predict()).orderBy("id").toPandas()["p"]
    assert np.allclose(got, want[0] + want[1] * a + want[2] * b)


def test_logistic_has_no_gradient_left(rows):
    a, b, up = columns(rows, "a", "b", "up")
    model = ln.fit_logistic(rows, ["a", "b"], "up", ridge=0.0)
    x = np.column_stack((np.ones(len(a)), a, b))
    p = 1 / (1 + np.exp(-x @ np.array([model.intercept, *model.coef])))
    assert np.abs(x.T @ (up - p)).max() < 1e-4


def test_quantile_regression_covers(rows):
    a, b, y = columns(rows, "a", "b", "y")
    model = ln.fit_quantile(rows, ["a", "b"], "y", 0.8)
    assert abs(np.mean(y <= model.intercept + model.coef[0] * a + model.coef[1] * b) - 0.8) < 0.02


def test_shuffled_is_a_permutation(rows):
    got = ln.shuffled(rows, "a", 3)
    a, moved = columns(rows, "a")[0], columns(got, "a")[0]
    assert np.allclose(np.sort(a), np.sort(moved)) and np.mean(a == moved) < 0.05


def test_purged_scores_and_importances(rows):
    cv = ln.cv_score(rows, ["a", "b"], "up", n_splits=3, embargo=0.02).collect()
    assert len(cv) == 3 and sum(r["n_test"] for r in cv) == 600 and all(r["n_train"] < 400 for r in cv) and all(r["score"] > -0.5 for r in cv)
    noisy = rows.withColumn("c", F.rand(5))
    mda = {r["feature"]: r["mean"] for r in ln.importance_mda(noisy, ["a", "c"], "up", n_splits=3).collect()}
    sfi = {r["feature"]: r["mean"] for r in ln.importance_sfi(noisy, ["a", "c"], "up", n_splits=3).collect()}
    assert mda["a"] > 0.1 > abs(mda["c"]) and sfi["a"] > 0.1 > abs(sfi["c"])
    assert {r["feature"]: r["mean"] for r in ln.importance_mdi(noisy, ["a", "c"], "up", trees=5).collect()}["a"] > 0.5
    assert ln.FeatureSelector(1).fit(noisy, ["a", "c"], "up").chosen == ["a"]


def test_gate(spark):
    rows = spark.createDataFrame([("mda", "a", 1.0, 0.1), ("sfi", "a", 1.0, 0.1), ("mda", "b", 1.0, 0.1), ("sfi", "b", 0.1, 0.1), ("mda", "c", 0.1, 1.0), ("sfi", "c", 0.1, 1.0)], "method string, feature string, mean double, std double")
    passed = lambda how: {r["feature"] for r in ln.importance_gate(rows, 2, how=how).filter("passed").collect()}
    assert passed("union") == {"a", "b"} and passed("intersection") == {"a"}
    assert ln.importance_gate(rows, 2).first()["open"] and not ln.importance_gate(rows, 3).first()["open"]
    with pytest.raises(ValueError):
        ln.importance_gate(rows.withColumn("method", F.lit("mdi")))


def test_meta_labels_need_a_rationale(rows):
    with pytest.raises(ln.RationaleMissing):
        ln.MetaLabeler(["a"], economic_rationale=" ")
    sided = rows.withColumns({"side": F.lit(1), "ret": F.col("y") - 1})
    got = ln.MetaLabeler(["a", "b"], economic_rationale="momentum", n_splits=3).fit(sided).predict(sided)
    assert got.agg(F.avg(F.when(F.col("position") > 0, F.col("ret")))).first()[0] > got.agg(F.avg("ret")).first()[0] + 0.5


def test_conformal_models_cover(rows):
    cal, test = rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")
    for out in (
        fc.quantile_intervals(cal, cal, test, ["a", "b"], 0.2),
        fc.quantile_intervals(cal, cal, test, ["a", "b"], 0.2, symmetric=False),
        fc.cross_conformal(cal.withColumn("fold", F.col("id") % 4), test, ["a", "b"], 0.2),
        fc.cross_quantiles(cal.withColumn("fold", F.col("id") % 3), test, ["a", "b"], 0.2),
        fc.block_intervals(cal.withColumn("pred", F.col("a") * 2 - F.col("b") + 1), test.withColumn("pred", F.col("a") * 2 - F.col("b") + 1), "instrument", ["id"], 0.2, 1),
    ):
        hit = out.agg(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))).first()[0]
        assert 0.72 < hit < 0.9
    plus = fc.jackknife_plus(cal, test, ["a", "b"], 0.2, folds=4).join(test.select("id", "y"), "id")
    assert plus.agg(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))).first()[0] > 0.7
    assert fc.score_function("absolute") is fc.SCORES[fc.ScoreType.ABSOLUTE]


def test_walk_forward_equals_refits_by_hand(rows):
    got = fc.walk_forward(rows, "instrument", ["id"], ["a", "b"], initial=50, refit=10, embargo=2).filter("instrument = 0").orderBy("id").toPandas()
    x = np.column_stack((np.ones(len(got)), got["a"], got["b"]))
    y, beta, since = got["y"].to_numpy(), None, 0
    for k in range(len(got)):
        if beta is None:
            assert np.isnan(got["pred"][k])
        else:
            assert np.isclose(got["pred"][k], x[k] @ beta)
        since += 1
        if k + 1 >= 50 and (beta is None or since >= 10):
            beta, since = np.linalg.pinv(x[: k - 1].T @ x[: k - 1]) @ x[: k - 1].T @ y[: k - 1], 0
    late = got[got["upper"].notna() & np.isfinite(got["upper"])]
    assert 0.8 < np.mean((late["y"] >= late["lower"]) & (late["y"] <= late["upper"])) <= 1


def test_backtests_and_branches(rows):
    out = fc.alpha_backtest(rows.withColumn("ret", F.col("y") - 1), "instrument", ["id"], ["a", "b"], initial=50)
    branches = fc.compare_branches({"all": out, "none": out.withColumn("pnl", F.lit(0.0))}).collect()
    assert [r["branch"] for r in branches] == ["all", "none"] and branches[0]["mean_pnl"] > 0.5
    metrics = fc.strategy_metrics(out, "instrument", ["id"]).collect()
    assert len(metrics) == 3 and all(r["max_drawdown"] <= 0 for r in metrics)


def test_garch_finds_its_parameters(spark):
    rng = np.random.default_rng(4)
    r, s2 = [], 1.0
    for _ in range(4000):
        r.append(float(rng.normal() * np.sqrt(s2)))
        s2 = 0.05 + 0.1 * r[-1] ** 2 + 0.85 * s2
    got = fc.garch_intervals(spark.createDataFrame([(1, i, x) for i, x in enumerate(r)], "k long, t long, ret double"), "k", ["t"]).first()
    assert abs(got["a"] - 0.1) < 0.06 and abs(got["b"] - 0.85) < 0.1 and got["lower"] < 0 < got["upper"]


def test_rolling_var(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(size=400)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(r)], "k long, t long, ret double")
    for method in ("conformal", "historical", "parametric"):
        got = fc.rolling_var(df, "k", ["t"], 0.95, 100, method).orderBy("t").toPandas()
        assert got["var"].notna().sum() == 300 and 0.01 < got["violation"].dropna().astype(float).mean() < 0.1
        if method == "historical":
            assert np.isclose(got["var"][250], -np.quantile(r[150:250], 0.05))
    assert fc.var_backtest(df, "k", ["t"], 0.95, window=100).count() == 1
