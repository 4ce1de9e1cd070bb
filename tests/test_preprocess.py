import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import cli
from tidemark.operators import preprocess as pp
from tidemark.operators import provenance as pv


def frame(spark):
    x = np.random.default_rng(4).normal(size=(200, 3))
    x[:, 2] = x[:, 0] * 2 + 0.01 * x[:, 2]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "pos int, a double, b double, c double"), x


def test_scalers_learn_on_train_only(spark):
    df, x = frame(spark)
    out = pp.Standard(["a"], None).fit(df.filter("pos < 100")).apply(df).orderBy("pos").toPandas()["a"].to_numpy()
    assert np.allclose(out, (x[:, 0] - x[:100, 0].mean()) / x[:100, 0].std())
    out = pp.Robust(["b"], 1.0).fit(df).apply(df).toPandas()["b"]
    assert out.abs().max() == 1.0 and abs(out.median()) < 1e-9
    q = pp.Quantiles(["a"], 11).fit(df).apply(df).orderBy("pos").toPandas()["a"]
    assert q.between(0, 1).all() and np.corrcoef(q, x[:, 0].argsort().argsort())[0, 1] > 0.99
    missing = df.withColumn("a", F.when(F.col("pos") > 5, F.col("a")))
    assert pp.Impute(["a"], "mean").fit(missing).apply(missing).filter("a IS NULL").count() == 0


def test_pca_and_chain(spark):
    df, x = frame(spark)
    out = pp.Chain([pp.Standard(["a", "b", "c"]), pp.Pca(["a", "b", "c"], 2)]).fit(df).apply(df)
    assert out.columns == ["pos", "pc1", "pc2"]
    assert pp.Pca(["a", "c"], 0.95).fit(df).state["vectors"].__len__() == 1


def test_provenance(spark):
    df, _ = frame(spark)
    assert pv.fingerprint(df) == pv.fingerprint(df.orderBy(F.rand()).select("c", "pos", "b", "a"))
    assert pv.fingerprint(df) != pv.fingerprint(df.filter("pos > 0"))
    found = pv.manifest(df, {"k": 1}, "abc")
    assert pv.verified(found, df, "abc") and not pv.verified(found, df, "abd")
    old = spark.createDataFrame([("x", 1, "a"), ("y", 1, "b")], "name string, found_at int, v string")
    new = spark.createDataFrame([("x", 2, "c")], "name string, found_at int, v string")
    assert {(r["name"], r["v"]) for r in pv.upsert(old, new).collect()} == {("x", "c"), ("y", "b")}


def test_look_ahead_is_found(spark):
    df, _ = frame(spark)
    w = Window.partitionBy(F.lit(1)).orderBy("pos")
    assert pv.looks_ahead(lambda d: d.withColumn("m", F.sum("a").over(w.rowsBetween(-2, 0))), df, "pos", [50]) == []
    assert len(pv.looks_ahead(lambda d: d.withColumn("m", F.lead("a").over(w)), df, "pos", [50])) == 2


def test_cli_lists_queries(capsys):
    assert cli.main(["list", "bars_tick"]) == 0
    assert "bars_tick" in capsys.readouterr().out
