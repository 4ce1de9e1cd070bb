"""Linear learners fitted by sums that merge anywhere, and what is built on them: purged scores, meta-labels, importances.

A fit sends the driver one small matrix for each step; rows stay where they are. A fitted model is an expression, so
scoring stays in the plan. Rows with a null among the inputs, the target or the weight are left out of fits and scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import labels as lb

CLIP = 1e-6
_W = "_weight"


@dataclass(frozen=True)
class Linear:
    """An intercept and one coefficient for each input; `link` is identity or logit."""

    inputs: tuple[str, ...]
    coef: tuple[float, ...]
    intercept: float
    link: str = "identity"

    def margin(self) -> Column:
        out = F.lit(self.intercept)
        for name, c in zip(self.inputs, self.coef, strict=True):
            out = out + F.col(name).cast("double") * c
        return out

    def predict(self) -> Column:
        """The value, or the probability of class 1."""
        return self.margin() if self.link == "identity" else 1 / (1 + F.exp(-self.margin()))


def _whole(rows: DataFrame, inputs: list[str], y: str, weight: str | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    out = rows.select(*(F.col(c).cast("double").alias(c) for c in inputs), F.col(y).cast("double").alias("_y"), w.alias(_W))
    return out.na.drop()


def _sums(rows: DataFrame, inputs: list[str], step: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of step(x, y, w) -> (matrix, vector), x with a leading 1; a partition sends its own sums."""
    k = len(inputs) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((k, k)), np.zeros(k)
        for pdf in batches:
            if len(pdf):
                x = np.column_stack((np.ones(len(pdf)), pdf[inputs].to_numpy(float)))
                da, db = step(x, pdf["_y"].to_numpy(float), pdf[_W].to_numpy(float))
                a, b = a + da, b + db
        yield pd.DataFrame({"i": np.arange(k * k + k), "v": np.concatenate((a.ravel(), b))})

    found = rows.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    if not len(found):
        return np.zeros((k, k)), np.zeros(k)
    return found[: k * k].reshape(k, k), found[k * k :]


def _solved(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    penalty = ridge * np.eye(len(b))
    penalty[0, 0] = 0.0  # the intercept is free
    return np.linalg.pinv(a + penalty) @ b


def fit_linear(rows: DataFrame, inputs: list[str], y: str, weight: str | None = None, ridge: float = 0.0) -> Linear:
    """Least squares, in one pass."""
    a, b = _sums(_whole(rows, inputs, y, weight), inputs, lambda x, t, w: (x.T @ (x * w[:, None]), x.T @ (t * w)))
    beta = _solved(a, b, ridge)
    return Linear(tuple(inputs), tuple(beta[1:].tolist()), float(beta[0]))


def fit_logistic(rows: DataFrame, inputs: list[str], y: str, weight: str | None = None, ridge: float = 1e-3, steps: int = 15, tolerance: float = 1e-8) -> Linear:
    """Logistic regression of a 0/1 target by Newton's method, a pass for each step."""
    own = _whole(rows, inputs, y, weight)
    beta = np.zeros(len(inputs) + 1)
    for _ in range(steps):

        def step(x, t, w, beta=beta):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            return x.T @ (x * (w * p * (1 - p) + 1e-12)[:, None]), x.T @ (w * (t - p))

        a, b = _sums(own, inputs, step)
        b[1:] -= ridge * beta[1:]
        move = _solved(a, b, ridge)
        beta = beta + move
        if np.abs(move).max(initial=0.0) < tolerance:
            break
    return Linear(tuple(inputs), tuple(beta[1:].tolist()), float(beta[0]), "logit")


def fit_quantile(rows: DataFrame, inputs: list[str], y: str, quantile: float, weight: str | None = None, steps: int = 40, eps: float = 1e-3) -> Linear:
    """Linear quantile regression by reweighted least squares of a smoothed pinball loss, a pass for each step."""
    own = _whole(rows, inputs, y, weight)
    first = fit_linear(rows, inputs, y, weight)
    beta = np.array([first.intercept, *first.coef])
    for _ in range(steps):

        def step(x, t, w, beta=beta):
            r = t - x @ beta
            v = w * np.where(r >= 0, quantile, 1 - quantile) / np.maximum(np.abs(r), eps)
            return x.T @ (x * v[:, None]), x.T @ (v * t)

        new = _solved(*_sums(own, inputs, step), 0.0)
        done = np.abs(new - beta).max() < 1e-7 * max(1.0, np.abs(beta).max())
        beta = new
        if done:
            break
    return Linear(tuple(inputs), tuple(beta[1:].tolist()), float(beta[0]))


LEARNERS = {"linear": fit_linear, "logistic": fit_logistic}


def scores(predicted: DataFrame, y: str, pred: str = "pred", scoring: str = "neg_log_loss", weight: str | None = None) -> Column:
    """The aggregate that scores predictions; greater is better."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    t, p = F.col(y).cast("double"), F.greatest(F.least(F.col(pred), F.lit(1 - CLIP)), F.lit(CLIP))
    value = {
        "neg_log_loss": t * F.log(p) + (1 - t) * F.log(1 - p),
        "accuracy": ((F.col(pred) > 0.5).cast("double") == t).cast("double"),
        "neg_mse": -F.pow(t - F.col(pred), F.lit(2.0)),
    }.get(scoring)
    if value is None:
        raise ValueError(f"no score {scoring}")
    return F.try_divide(F.sum(value * w), F.sum(w))


def _folds(rows: DataFrame, n_splits: int, embargo: float) -> DataFrame:
    """rows (instrument, t0, t1, ...) for each split with its role."""
    roles = lb.purged_folds(rows.select("instrument", "t0", "t1").distinct(), n_splits, embargo)
    return rows.join(roles, ["instrument", "t0", "t1"])


def cv_score(rows: DataFrame, inputs: list[str], y: str, learner: str = "logistic", scoring: str = "neg_log_loss", weight: str | None = None, n_splits: int = 5, embargo: float = 0.0) -> DataFrame:
    """split, n_train, n_test, score of purged folds: spans that meet the test fold's, and its embargo, don't teach."""
    parted = _folds(rows, n_splits, embargo)
    out = None
    for k in range(n_splits):
        own = parted.filter(F.col("split") == k)
        train, test = own.filter("role = 'train'"), own.filter("role = 'test'")
        model = LEARNERS[learner](train, inputs, y, weight)
        judged = test.withColumn("pred", model.predict()).filter(F.col("pred").isNotNull() & F.col(y).isNotNull())
        one = judged.agg(F.lit(k).alias("split"), F.count(F.lit(1)).alias("n_test"), scores(judged, y, scoring=scoring, weight=weight).alias("score"))
        one = one.withColumn("n_train", F.lit(train.count()))
        out = one if out is None else out.unionByName(one)
    return out.select("split", "n_train", "n_test", "score")


def out_of_sample(rows: DataFrame, inputs: list[str], y: str, learner: str = "logistic", weight: str | None = None, n_splits: int = 5, embargo: float = 0.0) -> DataFrame:
    """rows with `pred` by the model of the purged fold that tests them."""
    parted = _folds(rows, n_splits, embargo)
    out = None
    for k in range(n_splits):
        own = parted.filter(F.col("split") == k)
        model = LEARNERS[learner](own.filter("role = 'train'"), inputs, y, weight)
        one = own.filter("role = 'test'").withColumn("pred", model.predict())
        out = one if out is None else out.unionByName(one)
    return out.drop("role")


class RationaleMissing(ValueError):
    """A meta-label without a reason why the primary model should have an edge."""


class MetaLabeler:
    """Two stages: a primary side, and a model of whether taking it pays, taught on out-of-sample rows. predict() gives
    the side where the second stage's probability is above the threshold, 0 elsewhere."""

    def __init__(self, inputs: list[str], *, economic_rationale: str, threshold: float = 0.5, n_splits: int = 5, embargo: float = 0.0):
        if not (economic_rationale or "").strip():
            raise RationaleMissing("say why the primary side should pay")
        self.inputs, self.rationale, self.threshold, self.n_splits, self.embargo = inputs, economic_rationale, threshold, n_splits, embargo
        self.model: Linear | None = None

    def fit(self, rows: DataFrame, side: str = "side", ret: str = "ret", weight: str | None = None) -> MetaLabeler:
        """rows: instrument, t0, t1, the inputs, the primary side, and the return of its span; rows without a side teach
        nothing. The target is whether the side's return was above 0."""
        taken = rows.filter(F.col(side) != 0).withColumn("_hit", (F.col(side) * F.col(ret) > 0).cast("int"))
        self.oos = cv_score(taken, self.inputs, "_hit", "logistic", "neg_log_loss", weight, self.n_splits, self.embargo)
        self.model = fit_logistic(taken, self.inputs, "_hit", weight)
        return self

    def predict(self, rows: DataFrame, side: str = "side") -> DataFrame:
        p = self.model.predict()
        return rows.withColumn("meta_prob", p).withColumn("position", F.when(p > self.threshold, F.signum(F.col(side).cast("double"))).otherwise(F.lit(0.0)))


def shuffled(rows: DataFrame, column: str, seed: int, rows_a_bucket: int = 100_000) -> DataFrame:
    """rows with the column's values dealt out anew: within buckets of rows, each takes the value of the next in the order
    of a seeded hash, the last that of the first."""
    h = F.xxhash64(*rows.columns, F.lit(seed))
    placed = rows.withColumn("_h", h)
    n_buckets = max(1, rows.count() // rows_a_bucket)
    placed = placed.withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(n_buckets)))
    w = Window.partitionBy("_b").orderBy("_h")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy("_b"))
    return placed.withColumn(column, F.when(last, F.first(column).over(every)).otherwise(F.lead(column).over(w))).drop("_h", "_b")


def importance_mda(rows: DataFrame, inputs: list[str], y: str, learner: str = "logistic", scoring: str = "neg_log_loss", n_splits: int = 5, embargo: float = 0.0, repeats: int = 1, seed: int = 0) -> DataFrame:
    """method, feature, mean, std: how much the score of a purged fold falls when a feature's values are shuffled there;
    std is the standard error over folds."""
    parted, found = _folds(rows, n_splits, embargo), []
    for k in range(n_splits):
        own = parted.filter(F.col("split") == k)
        model = LEARNERS[learner](own.filter("role = 'train'"), inputs, y)
        test = own.filter("role = 'test'").na.drop(subset=[*inputs, y])

        def score(df: DataFrame, model=model) -> float | None:
            judged = df.withColumn("pred", model.predict())
            return judged.agg(scores(judged, y, scoring=scoring)).first()[0]

        base = score(test)
        for c in inputs:
            moved = [score(shuffled(test, c, seed + r)) for r in range(repeats)]
            if base is not None:
                found.append((c, k, base - float(np.mean(moved))))
    return _summary(rows.sparkSession, found, "mda")


def importance_sfi(rows: DataFrame, inputs: list[str], y: str, learner: str = "logistic", scoring: str = "neg_log_loss", n_splits: int = 5, embargo: float = 0.0) -> DataFrame:
    """method, feature, mean, std: the purged score of a model with one feature above that of the training mean alone."""
    parted, found = _folds(rows, n_splits, embargo), []
    for k in range(n_splits):
        own = parted.filter(F.col("split") == k)
        train, test = own.filter("role = 'train'"), own.filter("role = 'test'").filter(F.col(y).isNotNull())
        prior = train.agg(F.avg(F.col(y).cast("double"))).first()[0]
        base = test.withColumn("pred", F.lit(prior)).agg(scores(test, y, scoring=scoring)).first()[0]
        for c in inputs:
            judged = test.withColumn("pred", LEARNERS[learner](train, [c], y).predict()).filter("pred IS NOT NULL")
            one = judged.agg(scores(judged, y, scoring=scoring)).first()[0]
            if base is not None and one is not None:
                found.append((c, k, one - base))
    return _summary(rows.sparkSession, found, "sfi")


def importance_mdi(rows: DataFrame, inputs: list[str], y: str, trees: int = 20, depth: int = 5, seed: int = 0) -> DataFrame:
    """method, feature, mean, std: impurity importances of a random forest, taught and judged on the same rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    own = rows.select(*(F.col(c).cast("double").alias(c) for c in inputs), F.col(y).cast("double").alias("_y")).na.drop()
    ready = VectorAssembler(inputCols=inputs, outputCol="_x").transform(own)
    model = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="1").fit(ready)
    each = np.array([t.featureImportances.toArray() for t in model.trees])
    data = [("mdi", c, float(m), float(s)) for c, m, s in zip(inputs, each.mean(axis=0), each.std(axis=0, ddof=1) / np.sqrt(len(each)), strict=True)]
    return rows.sparkSession.createDataFrame(data, "method string, feature string, mean double, std double")


def _summary(spark, found: list[tuple[str, int, float]], method: str) -> DataFrame:
    out = spark.createDataFrame(found or [], "feature string, split int, value double")
    std = F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))
    return out.groupBy(F.lit(method).alias("method"), "feature").agg(F.avg("value").alias("mean"), std.alias("std"))


def importance_gate(results: DataFrame, least: int = 3, t_stat: float = 2.0, how: str = "union", allow_mdi: bool = False) -> DataFrame:
    """feature, n_methods, passed of features with mean > t_stat * std in any method (union) or in all (intersection), and
    `open`: whether at least `least` features pass. Impurity importances count only if allowed."""
    if how not in ("union", "intersection"):
        raise ValueError("how is union or intersection")
    if not allow_mdi and results.filter("method = 'mdi'").limit(1).count():
        raise ValueError("impurity importances are in sample; allow_mdi=True to use them all the same")
    n_methods = results.select("method").distinct().count()
    hits = F.sum((F.col("mean") > t_stat * F.coalesce("std", F.lit(0.0))).cast("int"))
    out = results.groupBy("feature").agg(hits.alias("n_methods"))
    out = out.withColumn("passed", F.col("n_methods") >= (1 if how == "union" else n_methods))
    return out.withColumn("open", F.sum(F.col("passed").cast("int")).over(Window.partitionBy(F.lit(0))) >= least)  # a row for each feature


def feature_scores(rows: DataFrame, inputs: list[str], y: str) -> DataFrame:
    """feature, f: the one-way F statistic of each feature between the classes of y, in one pass."""
    long = rows.filter(F.col(y).isNotNull()).select(F.col(y).alias("_y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in inputs))).alias("s")).select("_y", "s.*").filter("v IS NOT NULL")
    per = long.groupBy("feature", "_y").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_pop("v") * F.count(F.lit(1)), F.lit(0.0)).alias("within"))
    whole = per.groupBy("feature").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum("within").alias("within"))
    between = per.join(whole.select("feature", "grand"), "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2.0))).alias("between"))
    both = whole.join(between, "feature")
    return both.select("feature", F.try_divide(F.col("between") * (F.col("N") - F.col("k")), F.col("within") * (F.col("k") - 1)).alias("f"))


class FeatureSelector:
    """The k features of the greatest F statistic on the training rows."""

    def __init__(self, k: int = 10):
        self.k = k
        self.chosen: list[str] | None = None

    def fit(self, rows: DataFrame, inputs: list[str], y: str) -> FeatureSelector:
        best = feature_scores(rows, inputs, y).orderBy(F.desc_nulls_last("f"), "feature").limit(self.k)
        self.chosen = [r["feature"] for r in best.collect()]
        return self

    def transform(self, rows: DataFrame, inputs: list[str]) -> DataFrame:
        dropped = [c for c in inputs if c not in self.chosen]
        return rows.drop(*dropped)


def check_no_leakage(fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], train: DataFrame, test: DataFrame) -> None:
    """Raises unless what is fitted on train gives both tables the same columns and doesn't change when test changes."""
    transform = fit(train)
    a, b = transform(train), transform(test)
    if a.columns != b.columns:
        raise ValueError("train and test come out with other columns")
    if transform(train).exceptAll(a).limit(1).count():
        raise ValueError("the transform isn't the same twice")
