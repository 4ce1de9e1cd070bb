from datetime import date

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import calendar, conformal, entropy, microstructure


def test_calendar(spark):
    assert calendar.easter(2024) == date(2024, 3, 31) and calendar.easter(2000) == date(2000, 4, 23)
    rows = calendar.sessions(spark, "2024-01-01", "2024-12-31").collect()
    assert len(rows) == 252
    days = {r["session"]: r for r in rows}
    assert date(2024, 3, 29) not in days and date(2024, 6, 19) not in days and date(2024, 12, 25) not in days
    assert {d for d, r in days.items() if r["early_close"]} == {date(2024, 7, 3), date(2024, 11, 29), date(2024, 12, 24)}
    assert days[date(2024, 1, 2)]["next"] == date(2024, 1, 3) and days[date(2024, 1, 16)]["previous"] == date(2024, 1, 12)


def test_conformal_extras(spark):
    cal = spark.createDataFrame([(i, [0.6, 0.3, 0.1], 0 if i < 6 else 1 if i < 9 else 2) for i in range(10)], "id int, probs array<double>, label int")
    assert conformal.top_k(cal, 0.1).first()["k"] == 2
    got = cal.select(conformal.regularized_aps(F.col("probs"), F.col("label"), 0.1, 1).alias("s")).collect()
    assert np.allclose(sorted({r["s"] for r in got}), [0.6, 1.0, 1.2])
    scores = spark.createDataFrame([(1, i, float(i)) for i in range(100)], "g int, t int, score double")
    q = conformal.weighted_quantile(scores, "g", ["t"], 0.1, 1.0).first()
    assert q["q"] == 89.0 and round(q["n_eff"]) == 100
    assert conformal.block_maxima(scores, "g", ["t"], 10).count() == 10
    residuals = spark.createDataFrame([(i % 2, float(i)) for i in range(1, 20)], "fold int, r double")
    predictions = spark.createDataFrame([(7, 0, 100.0), (7, 1, 100.0)], "id int, fold int, pred double")
    r = conformal.fold_plus(residuals, predictions, 0.1).first()
    assert (r["lower"], r["upper"]) == (82.0, 118.0)


def test_causal_symbols_do_not_look_ahead(spark):
    rows = spark.createDataFrame([(1, i, float((i * 37) % 101)) for i in range(120)], "g int, t int, x double")
    for fn in (entropy.encode_sigma, entropy.encode_quantile_causal):
        whole = {r["t"]: r["symbol"] for r in fn(rows, "g", ["t"], "x").collect()}
        part = {r["t"]: r["symbol"] for r in fn(rows.filter("t < 80"), "g", ["t"], "x").collect()}
        assert all(whole[t] == part[t] for t in part) and whole[49] is None and whole[60] is not None


def test_vpin_bulk_and_critical_values(spark):
    ticks = spark.createDataFrame([(1, i, i, 100.0 + (i * 7 % 13), 10.0) for i in range(300)], "instrument int, ts int, seq int, price double, size double")
    out = microstructure.vpin_bulk(ticks, 50.0, 5).collect()
    assert len(out) == 60 and all(0 <= r["imbalance"] <= 1 for r in out)
    cv = {r["quantile"]: r["value"] for r in entropy.critical_values(40, n_sim=50, spark=spark).collect()}
    assert cv[0.9] < cv[0.95] < cv[0.99]
