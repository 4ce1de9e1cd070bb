"""Conformal models on fitted learners, walk-forward backtests, and risk forecasts.

Models come from learners (fit(rows, inputs, y) -> Linear). Walk-forward operators fold each instrument's rows in order,
with the model's sums carried along: a refit solves a small system, and no row is read twice.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark import kernels
from tidemark.fold import Fold, ordered_fold
from tidemark.operators import conformal as cf
from tidemark.operators import learners


class ScoreType(Enum):
    ABSOLUTE = "absolute"
    SIGNED = "signed"
    NORMALIZED = "normalized"
    GAMMA = "gamma"
    QUANTILE = "quantile"
    LAC = "lac"
    APS = "aps"


SCORES: dict[ScoreType, Callable[..., Column]] = {
    ScoreType.ABSOLUTE: cf.absolute, ScoreType.SIGNED: cf.signed, ScoreType.NORMALIZED: cf.normalized, ScoreType.GAMMA: cf.gamma,
    ScoreType.QUANTILE: cf.quantile_gap, ScoreType.LAC: cf.lac, ScoreType.APS: cf.aps,
}


def score_function(kind: ScoreType | str) -> Callable[..., Column]:
    return SCORES[ScoreType(kind)]


def asymmetric_scores(y: Column, lower: Column, upper: Column) -> tuple[Column, Column]:
    """How far y lies below the lower and above the upper end, each for itself."""
    return lower - y, y - upper


def asymmetric_quantiles(scores: DataFrame, below: str, above: str, alpha: float) -> DataFrame:
    """q_below, q_above: the finite-sample quantile of each side at alpha / 2."""
    a = cf.quantile(scores, below, alpha / 2).select(F.col("q").alias("q_below"))
    return a.crossJoin(F.broadcast(cf.quantile(scores, above, alpha / 2).select(F.col("q").alias("q_above"))))  # a row each


def conformalized_quantiles(calibration: DataFrame, test: DataFrame, alpha: float, symmetric: bool = True, y: str = "y", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """test with lower and upper: predicted quantiles lo and hi, widened by the quantile of how far calibration fell out."""
    below, above = asymmetric_scores(F.col(y), F.col(lo), F.col(hi))
    scored = calibration.withColumns({"_b": below, "_a": above, "_s": F.greatest(below, above)})
    if symmetric:
        q = cf.quantile(scored, "_s", alpha).select(F.col("q").alias("_b"), F.col("q").alias("_a"))
    else:
        q = asymmetric_quantiles(scored, "_b", "_a", alpha).toDF("_b", "_a")
    return test.crossJoin(F.broadcast(q)).withColumns({"lower": F.col(lo) - F.col("_b"), "upper": F.col(hi) + F.col("_a")}).drop("_a", "_b")


def quantile_model(rows: DataFrame, inputs: list[str], y: str, alpha: float) -> Callable[[DataFrame], DataFrame]:
    """Adds lo and hi by linear quantile regressions at alpha / 2 and 1 - alpha / 2, in order where they cross."""
    a, b = (learners.fit_quantile(rows, inputs, y, q).predict() for q in (alpha / 2, 1 - alpha / 2))
    return lambda df: df.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})


def quantile_intervals(train: DataFrame, calibration: DataFrame, test: DataFrame, inputs: list[str], alpha: float, symmetric: bool = True, y: str = "y") -> DataFrame:
    with_ends = quantile_model(train, inputs, y, alpha)
    return conformalized_quantiles(with_ends(calibration), with_ends(test), alpha, symmetric, y)


def cross_conformal(rows: DataFrame, test: DataFrame, inputs: list[str], alpha: float, fold: str = "fold", y: str = "y", fit=learners.fit_linear) -> DataFrame:
    """test with pred, lower and upper: one quantile of the residuals out of fold, around the mean of the folds' models.
    Folds are few: a model is fitted for each."""
    scored, preds = None, []
    for (k,) in rows.select(fold).distinct().orderBy(fold).collect():
        model = fit(rows.filter(F.col(fold) != k), inputs, y)
        preds.append(model.predict())
        one = rows.filter(F.col(fold) == k).select(F.abs(F.col(y) - model.predict()).alias("_s"))
        scored = one if scored is None else scored.unionByName(one)
    pred = sum(preds[1:], preds[0]) / len(preds)
    q = cf.quantile(scored, "_s", alpha).select(F.col("q").alias("_q"))
    out = test.withColumn("pred", pred).crossJoin(F.broadcast(q))
    return out.withColumns({"lower": F.col("pred") - F.col("_q"), "upper": F.col("pred") + F.col("_q")}).drop("_q")


def cross_quantiles(rows: DataFrame, test: DataFrame, inputs: list[str], alpha: float, fold: str = "fold", y: str = "y") -> DataFrame:
    """test with lower and upper by quantile models of each fold: scores out of fold, ends averaged over the folds."""
    scored, ends = None, []
    for (k,) in rows.select(fold).distinct().orderBy(fold).collect():
        with_ends = quantile_model(rows.filter(F.col(fold) != k), inputs, y, alpha)
        ends.append(with_ends)
        one = with_ends(rows.filter(F.col(fold) == k)).select(F.greatest(F.col("lo") - F.col(y), F.col(y) - F.col("hi")).alias("_s"))
        scored = one if scored is None else scored.unionByName(one)
    out, names = test, []
    for i, with_ends in enumerate(ends):
        out = with_ends(out).withColumnsRenamed({"lo": f"_lo{i}", "hi": f"_hi{i}"})
        names.append(i)
    mean = lambda c: sum((F.col(f"_{c}{i}") for i in names[1:]), F.col(f"_{c}0")) / len(names)
    q = cf.quantile(scored, "_s", alpha).select(F.col("q").alias("_q"))
    out = out.withColumns({"_lo": mean("lo"), "_hi": mean("hi")}).crossJoin(F.broadcast(q))
    out = out.withColumns({"lower": F.col("_lo") - F.col("_q"), "upper": F.col("_hi") + F.col("_q")})
    return out.select(*test.columns, "lower", "upper")


def jackknife_plus(rows: DataFrame, test: DataFrame, inputs: list[str], alpha: float, y: str = "y", folds: int = 20, id_col: str = "id") -> DataFrame:
    """id, lower, upper by CV+ with `folds` hash folds, which becomes the jackknife+ as folds reach the number of rows."""
    placed = rows.withColumn("fold", F.pmod(F.xxhash64(id_col), F.lit(folds)).cast("int"))
    residuals, predictions = None, None
    for k in range(folds):
        model = learners.fit_linear(placed.filter(F.col("fold") != k), inputs, y)
        a = placed.filter(F.col("fold") == k).select("fold", F.abs(F.col(y) - model.predict()).alias("r"))
        b = test.select(F.col(id_col).alias("id"), F.lit(k).alias("fold"), model.predict().alias("pred"))
        residuals, predictions = (a, b) if residuals is None else (residuals.unionByName(a), predictions.unionByName(b))
    return cf.fold_plus(residuals, predictions, alpha)


# --- comparing intervals ----------------------------------------------------------------------------------------------


def width_tradeoff(rows: DataFrame, alpha: float, method: str = "method", y: str = "y") -> DataFrame:
    """The metrics of several methods' intervals of the same targets, one row a method."""
    return cf.interval_metrics(rows, alpha, [method], y).orderBy(method)


def stratified_coverage(rows: DataFrame, true: str = "label", members: str = "members") -> DataFrame:
    """Coverage and mean size of prediction sets for each true class."""
    return rows.groupBy(F.col(true).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_contains(members, F.col(true)).cast("double")).alias("coverage"), F.avg(F.size(members)).alias("mean_size"))


def efficiency(base: DataFrame, new: DataFrame, on: str = "id", y: str = "y") -> DataFrame:
    """One row: mean widths of two methods, their ratio, and the difference of coverage."""
    both = base.select(on, y, F.col("lower").alias("_l0"), F.col("upper").alias("_u0")).join(new.select(on, F.col("lower").alias("_l1"), F.col("upper").alias("_u1")), on)
    hit = [F.avg(((F.col(y) >= F.col(f"_l{i}")) & (F.col(y) <= F.col(f"_u{i}"))).cast("double")) for i in (0, 1)]
    width = [F.avg(F.col(f"_u{i}") - F.col(f"_l{i}")) for i in (0, 1)]
    return both.agg(width[0].alias("width_base"), width[1].alias("width_new"), F.try_divide(width[1], width[0]).alias("width_ratio"), (hit[1] - hit[0]).alias("coverage_gain"))


def strategy_metrics(rows: DataFrame, by: str, at: list[str], periods: int = 252, weight: str | None = None) -> DataFrame:
    """Of signals (mu, lower, upper) and realized returns (ret): mean, deviation and Sharpe ratio of weight * ret (default:
    the sign of a tradeable mu), drawdown of its running sum, coverage, width, strength, and direction hit rate."""
    tradeable = (F.col("lower") > 0) | (F.col("upper") < 0)
    w = F.col(weight) if weight else F.when(tradeable, F.signum("mu")).otherwise(0.0)
    own = rows.withColumns({"_r": w * F.col("ret"), "_t": tradeable})
    path = Window.partitionBy(by).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_c", F.sum("_r").over(path)).withColumn("_d", F.col("_c") - F.greatest(F.max("_c").over(path), F.lit(0.0)))
    half = (F.col("upper") - F.col("lower")) / 2
    return own.groupBy(by).agg(
        F.avg("_r").alias("mean_return"), F.stddev_samp("_r").alias("std_return"), (F.try_divide(F.avg("_r"), F.stddev_samp("_r")) * sqrt(periods)).alias("sharpe"),
        F.min("_d").alias("max_drawdown"), F.avg(F.col("ret").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"),
        F.avg(F.col("upper") - F.col("lower")).alias("mean_width"), F.avg(F.try_divide(F.abs("mu"), half)).alias("strength"),
        F.avg(F.col("_t").cast("double")).alias("tradeable"), F.avg(F.when(F.col("mu") * F.col("ret") != 0, (F.col("mu") * F.col("ret") > 0).cast("double"))).alias("direction"),
    )


def filtered_signal(rows: DataFrame, min_strength: float = 1.0, max_width: float | None = None, tradeable: bool = True) -> DataFrame:
    """mu set to 0 where its strength |mu| / half width is below the least, the interval too wide, or holds 0."""
    half = (F.col("upper") - F.col("lower")) / 2
    ok = F.coalesce(F.try_divide(F.abs("mu"), half) >= min_strength, F.lit(False))
    if max_width is not None:
        ok = ok & (F.col("upper") - F.col("lower") <= max_width)
    if tradeable:
        ok = ok & ((F.col("lower") > 0) | (F.col("upper") < 0))
    return rows.withColumn("mu", F.when(ok, F.col("mu")).otherwise(0.0))


# --- walking forward --------------------------------------------------------------------------------------------------


class _Walk(Fold):
    """Least squares with sums carried on, refitted every `refit` rows after `initial`; each row is predicted before it
    teaches, and enters the sums `embargo` rows later. Intervals come from the last `window` residuals (rolling), all of
    them (split), or by adaptive levels (aci)."""

    def __init__(self, inputs: list[str], y: str, alpha: float, initial: int, refit: int, window: int, embargo: int, method: str, step: float):
        self.inputs, self.y, self.alpha, self.initial, self.refit, self.embargo, self.method, self.step = inputs, y, alpha, initial, refit, embargo, method, step
        k = len(inputs) + 1
        self.a, self.b, self.n, self.beta = np.zeros((k, k)), np.zeros(k), 0, None
        self.scores: deque[float] = deque(maxlen=window if method != "split" else None)
        self.waiting: deque = deque()
        self.level, self.since = alpha, 0

    def width(self) -> float:
        if len(self.scores) < 10:
            return float("inf")
        level = min(max(self.level, 0.0), 1.0)
        if level <= 0:
            return float("inf")
        k = ceil((len(self.scores) + 1) * (1 - level) - 1e-12)
        return float(np.sort(np.fromiter(self.scores, float))[min(max(k, 1), len(self.scores)) - 1]) if k <= len(self.scores) else float("inf")

    def one(self, x: np.ndarray, t: float) -> tuple[float, float, float]:
        pred = lower = upper = float("nan")
        if self.beta is not None:
            pred, q = float(x @ self.beta), self.width()
            lower, upper = pred - q, pred + q
            score = abs(t - pred)
            if self.method == "aci":
                self.level += self.step * (self.alpha - float(score > q))
            self.scores.append(score)
        self.waiting.append((x, t))
        if len(self.waiting) > self.embargo:
            u, v = self.waiting.popleft()
            self.a += np.outer(u, u)
            self.b += u * v
        self.n += 1
        self.since += 1
        if self.n >= self.initial and (self.beta is None or self.since >= self.refit):
            self.beta, self.since = np.linalg.pinv(self.a) @ self.b, 0
        return pred, lower, upper

    def rows(self, part: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack((np.ones(len(part)), part[self.inputs].to_numpy(float)))
        made = np.array([self.one(u, t) for u, t in zip(x, part[self.y].to_numpy(float), strict=True)])
        return part.assign(pred=made[:, 0], lower=made[:, 1], upper=made[:, 2])


def walk_forward(rows: DataFrame, by: str, at: list[str], inputs: list[str], y: str = "y", alpha: float = 0.1, initial: int = 100, refit: int = 20, window: int = 100, embargo: int = 0, method: str = "rolling", step: float = 0.01) -> DataFrame:
    """rows with pred, lower, upper (null in the first `initial` rows of an instrument): fitted on what came before, less
    the last `embargo` rows."""
    if method not in ("rolling", "split", "aci"):
        raise ValueError("method is rolling, split or aci")
    own = rows.na.drop(subset=[*inputs, y])
    schema = StructType(list(own.schema.fields)).add("pred", "double").add("lower", "double").add("upper", "double")
    out = ordered_fold(own, by, at, lambda: _Walk(inputs, y, alpha, initial, refit, window, embargo, method, step), schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("pred", "lower", "upper")})


def alpha_backtest(rows: DataFrame, by: str, at: list[str], inputs: list[str], y: str = "ret", min_strength: float = 0.0, **options) -> DataFrame:
    """Walk-forward signals of each instrument: mu, lower, upper, position (the sign of a signal that passes) and pnl."""
    out = walk_forward(rows, by, at, inputs, y, **options).filter("pred IS NOT NULL").withColumn("mu", F.col("pred"))
    kept = filtered_signal(out, min_strength)
    return kept.withColumn("position", F.signum("mu")).withColumn("pnl", F.col("position") * F.col(y))


def compare_branches(branches: dict[str, DataFrame], y: str = "ret", alpha: float = 0.1) -> DataFrame:
    """branch, n, coverage, mean width, gap to 1 - alpha, and the mean pnl of each of several backtests of the same rows."""
    out = None
    for name, rows in sorted(branches.items()):
        hit = F.avg(F.col(y).between(F.col("lower"), F.col("upper")).cast("double"))
        one = rows.agg(F.lit(name).alias("branch"), F.count(F.lit(1)).alias("n"), hit.alias("coverage"), F.avg(F.when(F.col("upper") - F.col("lower") < float("inf"), F.col("upper") - F.col("lower"))).alias("mean_width"), F.abs(hit - (1 - alpha)).alias("gap"), F.avg("pnl").alias("mean_pnl"))
        out = one if out is None else out.unionByName(one)
    return out


# --- risk --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class VarConfig:
    alpha: float = 0.95
    window: int = 250
    method: str = "conformal"


class _Var(Fold):
    def __init__(self, config: VarConfig, ret: str):
        self.c, self.ret, self.held = config, ret, deque(maxlen=config.window)

    def value(self) -> float:
        c, x = self.c, np.sort(np.fromiter(self.held, float))
        n = len(x)
        if n < c.window:
            return float("nan")
        if c.method == "historical":
            return float(-np.quantile(x, 1 - c.alpha))
        if c.method == "parametric":
            from statistics import NormalDist

            return float(-(x.mean() + x.std(ddof=1) * NormalDist().inv_cdf(1 - c.alpha)))
        # conformal: the loss at the finite-sample rank of losses
        losses = np.sort(-x)
        k = ceil((n + 1) * c.alpha - 1e-12)
        return float(losses[k - 1]) if k <= n else float("inf")

    def rows(self, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in part[self.ret].tolist():
            out.append(self.value())
            if r == r and r is not None:
                self.held.append(r)
        return part.assign(var=out)


def rolling_var(rows: DataFrame, by: str, at: list[str], alpha: float = 0.95, window: int = 250, method: str = "conformal", ret: str = "ret") -> DataFrame:
    """rows with var, the loss that the last `window` returns before each row don't expect to be passed, and violation."""
    if method not in ("conformal", "historical", "parametric"):
        raise ValueError("method is conformal, historical or parametric")
    config = VarConfig(alpha, window, method)
    out = ordered_fold(rows, by, at, lambda: _Var(config, ret), StructType(list(rows.schema.fields)).add("var", "double"))
    out = out.withColumn("var", F.when(~F.isnan("var"), F.col("var")))
    return out.withColumn("violation", -F.col(ret) > F.col("var"))


def var_backtest(rows: DataFrame, by: str, at: list[str], alpha: float = 0.95, **options) -> DataFrame:
    """by, n, violations, rate, and both tests' statistics of rolling VaR."""
    judged = rolling_var(rows, by, at, alpha, **options).filter("violation IS NOT NULL")
    return cf.kupiec(judged, by, alpha).join(cf.christoffersen(judged, by, at), by)


class Garch:
    """Variance s2' = omega + a * r^2 + b * s2 of returns r, with omega so that the long-run variance is the sample's; a and
    b by maximum likelihood over a grid that is refined."""

    def __init__(self, a: float, b: float, variance: float):
        self.a, self.b, self.variance = a, b, variance

    @staticmethod
    def path(r: np.ndarray, a: float, b: float, variance: float) -> np.ndarray:
        out, s2, omega = np.empty(len(r) + 1), variance, variance * (1 - a - b)
        for t, x in enumerate(r * r):
            out[t] = s2
            s2 = omega + a * x + b * s2
        out[-1] = s2
        return out

    @classmethod
    def fit(cls, r: np.ndarray, rounds: int = 3) -> Garch:
        variance = float(np.mean(r * r)) or 1e-12
        best, a0, b0, span = (np.inf, 0.05, 0.9), 0.15, 0.7, (0.14, 0.28)
        for _ in range(rounds):
            for a in np.linspace(max(a0 - span[0], 0.001), a0 + span[0], 7):
                for b in np.linspace(max(b0 - span[1], 0.0), b0 + span[1], 9):
                    if a + b < 0.999:
                        s2 = np.maximum(cls.path(r, a, b, variance)[:-1], 1e-300)
                        best = min(best, (float(np.sum(np.log(s2) + r * r / s2)), float(a), float(b)))
            a0, b0, span = best[1], best[2], (span[0] / 4, span[1] / 4)
        return cls(best[1], best[2], variance)

    def volatility(self, r: np.ndarray) -> np.ndarray:
        """Of each return before it is known, and of the one after the last."""
        return np.sqrt(self.path(r, self.a, self.b, self.variance))


def garch_intervals(rows: DataFrame, by: str, at: list[str], alpha: float = 0.1, ret: str = "ret", least: int = 50) -> DataFrame:
    """by, a, b, variance, q, vol, lower, upper: the interval of each instrument's next return, its GARCH volatility times
    the conformal quantile of |return| / volatility over the second half, the model being fitted on the first. A series is
    held by one task."""
    kind = rows.schema[by].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(at)[ret].dropna().to_numpy(float)
        names = [by, "a", "b", "variance", "q", "vol", "lower", "upper"]
        if len(r) < least:
            return pd.DataFrame([(key[0], *[float("nan")] * 7)], columns=names)
        half = len(r) // 2
        model = Garch.fit(r[:half])
        vol = model.volatility(r)
        scores = np.sort(np.abs(r[half:]) / np.maximum(vol[half:-1], 1e-300))
        k = kernels.conformal_rank(len(scores), alpha)
        q = float(scores[min(k, len(scores)) - 1])
        return pd.DataFrame([(key[0], model.a, model.b, model.variance, q, vol[-1], -q * vol[-1], q * vol[-1])], columns=names)

    return rows.select(by, *at, ret).groupBy(by).applyInPandas(run, f"`{by}` {kind}, a double, b double, variance double, q double, vol double, lower double, upper double")


def volatility_intervals(calibration: DataFrame, test: DataFrame, alpha: float, proxy: str = "squared", ret: str = "ret", vol: str = "vol") -> DataFrame:
    """test with lower and upper of the volatility: any model's forecast `vol` times 1 -+ the conformal quantile of its
    relative error against a proxy of the realized one."""
    realized = {"squared": F.sqrt(F.pow(F.col(ret), F.lit(2.0))), "absolute": F.abs(F.col(ret)) * sqrt(np.pi / 2)}[proxy]
    scored = calibration.withColumn("_s", F.try_divide(F.abs(realized - F.col(vol)), F.col(vol)))
    q = cf.quantile(scored, "_s", alpha).select(F.col("q").alias("_q"))
    out = test.crossJoin(F.broadcast(q))
    return out.withColumns({"lower": F.greatest(F.col(vol) * (1 - F.col("_q")), F.lit(0.0)), "upper": F.col(vol) * (1 + F.col("_q"))}).drop("_q")


def har_intervals(rows: DataFrame, by: str, at: list[str], alpha: float = 0.1, rv: str = "rv", log: bool = True, **options) -> DataFrame:
    """Walk-forward intervals of realized variance from its means over 1, 5 and 22 days, in logs unless told otherwise."""
    w = Window.partitionBy(by).orderBy(*at)
    means = {f"_m{k}": F.avg(rv).over(w.rowsBetween(-k, -1)) for k in (1, 5, 22)}
    own = rows.withColumns(means).filter((F.col(rv) > 0) & (F.col("_m1") > 0)) if log else rows.withColumns(means)
    turn = F.log if log else (lambda c: F.col(c))
    own = own.withColumns({f"_x{k}": turn(f"_m{k}") for k in (1, 5, 22)} | {"_y": turn(rv)}).withColumn("_place", F.row_number().over(w)).filter("_place > 22")
    out = walk_forward(own, by, at, ["_x1", "_x5", "_x22"], "_y", alpha, **options)
    back = {c: (F.exp(c) if log else F.col(c)) for c in ("pred", "lower", "upper")}
    return out.withColumns(back).select(*rows.columns, "pred", "lower", "upper")


def block_intervals(calibration: DataFrame, test: DataFrame, by: str, at: list[str], alpha: float, size: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """test with lower and upper: pred -+ the quantile of the greatest absolute residual of each block of `size` rows."""
    scored = calibration.withColumn("score", F.abs(F.col(y) - F.col(pred)))
    q = cf.quantile(cf.block_maxima(scored, by, at, size), "score", alpha).select(F.col("q").alias("_q"))
    return test.crossJoin(F.broadcast(q)).withColumns({"lower": F.col(pred) - F.col("_q"), "upper": F.col(pred) + F.col("_q")}).drop("_q")


def permutation_bands(rows: DataFrame, calibration: DataFrame, inputs: list[str], model: learners.Linear, alpha: float = 0.1, y: str = "y", permutations: int = 5, seed: int = 0) -> DataFrame:
    """feature, mean, lower, upper: how much the mean absolute error grows when a feature is shuffled, over permutations."""
    base = rows.agg(F.avg(F.abs(F.col(y) - model.predict()))).first()[0]
    found = []
    for c in inputs:
        for k in range(permutations):
            worse = learners.shuffled(calibration, c, seed + k).agg(F.avg(F.abs(F.col(y) - model.predict()))).first()[0]
            found.append((c, float(worse - base)))
    out = rows.sparkSession.createDataFrame(found, "feature string, v double")
    return out.groupBy("feature").agg(F.avg("v").alias("mean"), F.percentile("v", alpha / 2).alias("lower"), F.percentile("v", 1 - alpha / 2).alias("upper"))
