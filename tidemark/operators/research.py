"""Bundles and estimators around the research operators: evaluations, block lengths, break analyses, signatures, a catalog
of factors, and data-dependent settings."""

from __future__ import annotations

import importlib
import json
import subprocess
from dataclasses import asdict, dataclass
from itertools import product
from math import ceil, log, log10, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark import kernels
from tidemark.fold import Fold, ordered_fold
from tidemark.functions import special
from tidemark.operators import bars, entropy, microstructure, portfolio, provenance, statistics

#: critical values of the sup ADF and the generalised sup ADF statistic at 90, 95 and 99 %, by sample size; fixed values
#: of a published table
PSY_TABLE = {
    100: ((0.98, 1.30, 1.92), (1.66, 1.92, 2.45)),
    200: ((1.09, 1.40, 2.01), (1.81, 2.08, 2.63)),
    400: ((1.19, 1.49, 2.07), (1.91, 2.18, 2.78)),
    800: ((1.24, 1.53, 2.12), (1.98, 2.24, 2.83)),
}


def reference_critical_values(n: int, alpha: float = 0.05) -> dict[str, float | bool]:
    """sadf and gsadf from the table, linear in log n between its sizes and clamped beyond them."""
    try:
        at = (0.10, 0.05, 0.01).index(alpha)
    except ValueError:
        raise ValueError("alpha is 0.10, 0.05 or 0.01") from None
    sizes = list(PSY_TABLE)
    x, grid = log(max(n, 2)), [log(s) for s in sizes]
    sadf, gsadf = (float(np.interp(x, grid, [PSY_TABLE[s][k][at] for s in sizes])) for k in (0, 1))
    return {"sadf": sadf, "gsadf": gsadf, "clamped": not sizes[0] <= n <= sizes[-1]}


def break_analysis(rows: DataFrame, by: str, at: list[str], value: str, p: int = 1, alpha: float = 0.05, method: str = "gsadf") -> DataFrame:
    """by, n, statistic, critical, explosive: the greatest (generalised) sup ADF statistic of each series."""
    found = entropy.bubbles(rows, by, at, value, p, expanding=method == "sadf")
    stat = [c for c in found.columns if c not in rows.columns][-1]
    per = found.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(~F.isnan(stat), F.col(stat))).alias("statistic"))
    sizes = list(PSY_TABLE)
    k = ("sadf", "gsadf").index(method)
    points = [(log(s), PSY_TABLE[s][k][(0.10, 0.05, 0.01).index(alpha)]) for s in sizes]
    x = F.log(F.col("n").cast("double"))
    critical = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        critical = F.when(x < x1, y0 + (y1 - y0) * (F.greatest(x, F.lit(x0)) - x0) / (x1 - x0)).otherwise(critical)
    return per.withColumn("critical", critical).withColumn("explosive", F.col("statistic") > F.col("critical"))


def selected_lag(y: np.ndarray, most: int = 8, criterion: str = "bic") -> int:
    """The lag of a Dickey-Fuller regression with the least AIC or BIC, on the sample that all lags share."""
    best = (np.inf, 0)
    for p in range(most + 1):
        z, x = kernels.adf_design(y, p)
        z, x = z[most - p :], x[most - p :]
        n, k = x.shape
        if n <= k:
            break
        b, *_ = np.linalg.lstsq(x, z, rcond=None)
        rss = float(((z - x @ b) ** 2).sum())
        penalty = 2 * k if criterion == "aic" else k * log(n)
        best = min(best, (n * log(max(rss, 1e-300) / n) + penalty, p))
    return best[1]


def adf_selected(rows: DataFrame, by: str, at: list[str], value: str, most: int = 8, criterion: str = "bic") -> DataFrame:
    """by, n, lag, adf of each series with the lag that the criterion selects; a series is held by one task."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(at)[value].dropna().to_numpy(float)
        lag = selected_lag(y, most, criterion) if len(y) > most + 4 else 0
        stat = kernels.adf_t(y, lag) if len(y) > 4 else float("nan")
        return pd.DataFrame({by: [key[0]], "n": [len(y)], "lag": [lag], "adf": [stat]})

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, *at, value).groupBy(by).applyInPandas(run, f"`{by}` {kind}, n long, lag int, adf double")


#: 5 % critical value of the Dickey-Fuller t-statistic with a constant, for long series; a fixed value
ADF_5 = -2.86


def optimal_d(rows: DataFrame, by: str, at: list[str], value: str, grid: list[float] | None = None, threshold: float = 1e-5) -> DataFrame:
    """by, d, adf, correlation: the least d of the grid whose fractional difference is stationary at 5 %, 1 if none is, and
    the correlation with the series itself."""
    grid = grid or [i / 10 for i in range(1, 11)]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(at)[value].dropna().to_numpy(float)
        found = (key[0], 1.0, float("nan"), float("nan"))
        for d in grid:
            x = kernels.ffd(y, d, threshold)
            ok = ~np.isnan(x)
            if ok.sum() < 20:
                continue
            stat = kernels.adf_t(x[ok], 1)
            r = float(np.corrcoef(y[ok], x[ok])[0, 1]) if np.std(x[ok]) > 0 and np.std(y[ok]) > 0 else float("nan")
            found = (key[0], d, stat, r)
            if stat < ADF_5:
                break
        else:
            found = (key[0], 1.0, *found[2:])
        return pd.DataFrame([found], columns=[by, "d", "adf", "correlation"])

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, *at, value).groupBy(by).applyInPandas(run, f"`{by}` {kind}, d double, adf double, correlation double")


def block_length(rows: DataFrame, by: str, at: list[str], value: str, max_lag: int = 50) -> DataFrame:
    """by, n, block: the automatic length of circular blocks. Autocorrelations up to max_lag; the bandwidth is twice the
    first lag after which max(5, sqrt(log10 n)) in a row are insignificant; a flat-top kernel weighs them; the length is
    cut to half the series."""
    w = Window.partitionBy(by)
    x = F.col(value) - F.avg(value).over(w)
    centred = rows.filter(F.col(value).isNotNull()).withColumn("_x", x)
    line = w.orderBy(*at)
    products = [F.avg(F.col("_x") * F.lag("_x", k).over(line)).alias(f"r{k}") for k in range(0)]
    lagged = centred.withColumns({f"_l{k}": F.lag("_x", k).over(line) for k in range(1, max_lag + 1)})
    products = [F.avg(F.col("_x") * F.col(f"_l{k}")) for k in range(1, max_lag + 1)]
    per = lagged.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_x") * F.col("_x")).alias("var"), F.array(*products).alias("cov"))

    def length(n: int, var: float, cov: list[float]) -> int:
        if n < 4 or not var > 0:
            return 1
        lags = min(max_lag, n - 1)
        rho = [c / var if c is not None else 0.0 for c in cov[:lags]]  # from lag 1 on
        in_row, limit = max(5, int(sqrt(log10(max(n, 10))))), 2 * sqrt(log10(max(n, 10)) / n)
        flat = next((k for k in range(1, lags - in_row) if all(abs(r) < limit for r in rho[k : k + in_row])), max(1, lags // 2))
        m = min(2 * flat, lags)
        lam = [1.0 if k <= m / 2 else 2 * (1 - k / m) for k in range(1, m + 1)]
        g = 2 * sum(a * k * r * var for k, (a, r) in enumerate(zip(lam, rho, strict=False), 1))
        d = 4 / 3 * (var * var + 2 * sum(a * (r * var) ** 2 for a, r in zip(lam, rho, strict=False)))
        b = ceil((2 * g * g / d) ** (1 / 3) * n ** (1 / 3)) if d > 0 else round(n ** (1 / 3))
        return max(1, min(b, n // 2))

    @F.pandas_udf("int")
    def made(n: pd.Series, var: pd.Series, cov: pd.Series) -> pd.Series:
        return pd.Series([length(int(a), float(b), list(c)) for a, b, c in zip(n, var, cov, strict=True)], dtype="int32")

    return per.select(by, "n", made("n", "var", "cov").alias("block"))


# --- evaluations -------------------------------------------------------------------------------------------------------


def autocorrelation_factor(rho: Column, n: Column) -> Column:
    """How much first-order autocorrelation stretches the variance of a sum of n: 1 + 2 rho / (1 - rho) (1 - (1 - rho^n) /
    (n (1 - rho)))."""
    return 1 + 2 * rho / (1 - rho) * (1 - (1 - F.pow(rho, n)) / (n * (1 - rho)))


def haircuts(rows: DataFrame, by: list[str], methods: tuple[str, ...] = ("bonferroni", "holm", "bhy"), ret: str = "ret", rho: float | None = None) -> DataFrame:
    """by, method, p_nominal, p_adjusted, sr, sr_haircut, haircut of each series and method; with rho, t-ratios are divided
    by the root of the autocorrelation factor first."""
    base = statistics.sharpe(rows, by, ret).withColumn("t", F.col("sr") * F.sqrt("n"))
    if rho is not None:
        base = base.withColumn("t", F.col("t") / F.sqrt(autocorrelation_factor(F.lit(rho), F.col("n").cast("double"))))
    base = base.withColumn("p", special.t_two_sided(F.col("t"), F.col("n") - 1))
    out = None
    for method in methods:
        cut = statistics.adjusted_p(base, method, "p", by[0])
        sr = F.signum("sr") * F.greatest(special.norm_ppf(1 - F.col("p_adj") / 2), F.lit(0.0)) / F.sqrt("n")
        one = cut.withColumn("sr_haircut", sr).select(*by, F.lit(method).alias("method"), F.col("p").alias("p_nominal"), F.col("p_adj").alias("p_adjusted"), "sr", "sr_haircut")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("haircut", 1 - F.try_divide("sr_haircut", "sr"))


def deflated_evaluation(rows: DataFrame, by: str, at: list[str], n_trials: int = 1, n_windows: int = 4, ret: str = "ret", periods: int = 252) -> DataFrame:
    """by, sharpe (a year), psr, dsr, window_sharpes (of n_windows stretches of equal length) and significant (dsr, or psr
    for one trial, of 0.95 or more)."""
    whole = statistics.dsr(rows, [by], n_trials, across=False, ret=ret)
    place = F.ntile(n_windows).over(Window.partitionBy(by).orderBy(*at))
    per = rows.withColumn("_w", place).groupBy(by, "_w").agg((F.try_divide(F.avg(ret), F.stddev_samp(ret)) * sqrt(periods)).alias("s"))
    windows = per.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_w", "s"))), lambda x: x["s"]).alias("window_sharpes"))
    out = whole.select(by, (F.col("sr") * sqrt(periods)).alias("sharpe"), "psr", "dsr", F.lit(n_trials).alias("n_trials")).join(windows, by)
    return out.withColumn("significant", F.col("dsr") >= 0.95)


def compare_strategies(rows: DataFrame, by: str, ret: str = "ret") -> DataFrame:
    """Strategies by deflated Sharpe, best first, each deflated by the number and the spread of all."""
    n = rows.select(by).distinct().count()
    out = statistics.dsr(rows, [by], n, ret=ret)
    return out.orderBy(F.desc_nulls_last("dsr"), by)


def survivors(verdicts: DataFrame, passed: str = "passed") -> DataFrame:
    return verdicts.filter(F.col(passed))


def as_json(df: DataFrame, most: int = 10_000) -> str:
    """Rows as one JSON list, for results that are small by nature; more than `most` rows are an error."""
    rows = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"})).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return json.dumps([json.loads(r[0]) for r in rows], indent=2)


# --- bundles -----------------------------------------------------------------------------------------------------------


def microstructure_features(ticks: DataFrame, window: int = 50) -> DataFrame:
    """ticks with the rolling Roll spread and Kyle's lambda of the window."""
    spread = microstructure.roll_spread_rolling(ticks, window)
    return microstructure.kyle_lambda_rolling(spread, window)


def entropy_features(rows: DataFrame, by: str, at: list[str], value: str, windows: tuple[int, ...] = (20, 50, 100), n_bins: int = 10) -> DataFrame:
    """rows with entropy_<window> of quantile symbols for each window."""
    out = entropy.encode_quantile(rows, value, n_bins, [by])
    symbol = [c for c in out.columns if c not in rows.columns][0]
    for w in windows:
        before = set(out.columns)
        out = entropy.rolling_entropy(out, by, at, symbol, w)
        made = [c for c in out.columns if c not in before][0]
        out = out.withColumnRenamed(made, f"entropy_{w}")
    return out.drop(symbol)


def entropy_signal(rows: DataFrame, by: str, at: list[str], value: str, entropy_col: str, window: int = 100, threshold: float = 2.0) -> DataFrame:
    """rows with signal: where entropy lies more than `threshold` deviations below its rolling mean, against the sign of the
    recent mean of the value; 0 elsewhere."""
    w = Window.partitionBy(by).orderBy(*at).rowsBetween(-(window - 1), 0)
    z = F.try_divide(F.col(entropy_col) - F.avg(entropy_col).over(w), F.stddev_samp(entropy_col).over(w))
    return rows.withColumn("signal", F.when(F.coalesce(z < -threshold, F.lit(False)), -F.signum(F.avg(value).over(w))).otherwise(0.0))


def dollar_bars_with_microstructure(quotes: DataFrame, threshold: float) -> DataFrame:
    """Dollar bars (bar columns) of ticks with quotes (bid, ask, bid_size, ask_size), with each bar's mean relative spread,
    mean depth imbalance and signed share of volume: bars are numbered once, and both are one aggregation of that."""
    bar = bars.threshold_bars(quotes, threshold, "dollar")
    w = Window.partitionBy("instrument").orderBy("ts_open")
    limits = bar.select("instrument", "bar_id", "ts_open").withColumn("ts", F.col("ts_open"))
    from tidemark.operators import pit

    placed = pit.asof_join(quotes, limits, ["instrument"], "ts", "ts", ["bar_id"]).filter("bar_id IS NOT NULL")
    placed = placed.join(bar.select("instrument", "bar_id", "ts_close"), ["instrument", "bar_id"]).filter("ts <= ts_close")
    mid = (F.col("bid") + F.col("ask")) / 2
    extra = placed.groupBy("instrument", "bar_id").agg(
        F.avg(F.try_divide(F.col("ask") - F.col("bid"), mid)).alias("rel_spread"),
        F.avg(F.try_divide(F.col("bid_size") - F.col("ask_size"), F.col("bid_size") + F.col("ask_size"))).alias("depth_imbalance"),
    )
    del w
    return bar.join(extra, ["instrument", "bar_id"], "left")


def wide_panels(frame: DataFrame, factors: list[str], date: str = "date", asset: str = "asset") -> DataFrame:
    """date, asset and the mean of each factor over repeated rows; rows without any factor go. The panel stays long."""
    out = frame.groupBy(date, asset).agg(*(F.avg(c).alias(c) for c in factors))
    return out.filter(F.coalesce(*(F.col(c) for c in factors)).isNotNull())


def threshold_for(ticks: DataFrame, kind: str, bars_per_day: float = 50.0) -> DataFrame:
    """instrument, threshold: the mean increment of a day over the bars wanted. It sees the whole sample, so it is for
    research, not for live bars."""
    out = ticks.withColumn("_w", bars.increment(kind)).groupBy("instrument").agg((F.sum("_w") / F.count_distinct(F.to_date("ts")) / bars_per_day).alias("threshold"))
    return out


# --- covariances and alphas under walk-forward --------------------------------------------------------------------------


def covariance_benchmark(returns: DataFrame, n_splits: int = 5, embargo: int = 0, t: str = "t", i: str = "i", x: str = "x") -> DataFrame:
    """estimator, portfolio, split, mean, sd, sharpe, active of portfolios from the covariance of what lies outside each of
    n_splits stretches of time, held over the stretch. A split's matrix is held by one task, as any solver needs."""
    bounds = returns.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    width = (bounds["b"] - bounds["a"] + 1) / n_splits
    own = returns.withColumn("_s", F.least(F.floor((F.col(t) - bounds["a"]) / width), F.lit(n_splits - 1)).cast("int"))
    dealt = own.select(F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split"), F.col(t).alias("t"), F.col(i).alias("i"), F.col(x).alias("x"), "_s")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        k = key[0]
        test_rows = pdf[pdf["_s"] == k]
        if test_rows.empty:
            return pd.DataFrame(columns=["estimator", "portfolio", "split", "mean", "sd", "sharpe", "active"])
        lo, hi = test_rows["t"].min() - embargo, test_rows["t"].max() + embargo
        train = pdf[(pdf["t"] < lo) | (pdf["t"] > hi)].pivot_table(index="t", columns="i", values="x").dropna()
        test = test_rows.pivot_table(index="t", columns="i", values="x").dropna()
        names = [c for c in train.columns if c in test.columns]
        a, b, out = train[names].to_numpy(float), test[names].to_numpy(float), []
        if len(a) < 3 or not len(names):
            return pd.DataFrame(columns=["estimator", "portfolio", "split", "mean", "sd", "sharpe", "active"])
        for name, cov in estimates(a).items():
            for kind in ("min_variance", "nco"):
                w = portfolio._solved(cov, np.ones(len(names))) if kind == "min_variance" else portfolio.nco_weights(cov)
                w = w / w.sum()
                r = b @ w
                sd = float(r.std(ddof=1)) if len(r) > 1 else float("nan")
                out.append((name, kind, k, float(r.mean()), sd, float(r.mean() / sd) if sd > 0 else float("nan"), int((np.abs(w) > 1e-6).sum())))
        return pd.DataFrame(out, columns=["estimator", "portfolio", "split", "mean", "sd", "sharpe", "active"])

    return dealt.groupBy("split").applyInPandas(run, "estimator string, portfolio string, split int, mean double, sd double, sharpe double, active int")


def estimates(a: np.ndarray) -> dict[str, np.ndarray]:
    """Sample, shrunk and denoised covariance of rows of returns."""
    n, p = a.shape
    c = a - a.mean(axis=0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min((((c * c).sum(axis=1) ** 2).mean() - (s * s).sum()) / (n * p), d2)
    delta = b2 / d2 if d2 > 0 else 0.0
    sd = np.sqrt(np.maximum(np.diag(s), 1e-300))
    values, vectors = np.linalg.eigh(s / np.outer(sd, sd))
    edge = portfolio.mp_edge(p / n, portfolio.fit_sigma2(values, p / n))
    noise = values <= edge
    if noise.any():
        values = np.where(noise, values[noise].mean(), values)
    corr = (vectors * values) @ vectors.T
    k = np.sqrt(np.diag(corr))
    return {"sample": s * n / (n - 1), "shrunk": delta * mu * np.eye(p) + (1 - delta) * s, "denoised": corr / np.outer(k, k) * np.outer(sd, sd)}


@dataclass(frozen=True)
class AlphaNco:
    """Settings of alpha_nco: how far back covariances look, how old signals may be (days), costs, leverage and its cap."""

    estimator: str = "shrunk"
    lookback: int = 252
    max_age: int = 31
    bps: float = 5.0
    kelly: float = 0.5
    max_leverage: float = 2.0
    least_assets: int = 3


def alpha_nco(signals: DataFrame, returns: DataFrame, config: AlphaNco = AlphaNco()) -> dict[str, DataFrame]:  # noqa: B008
    """`weights` (rebalance, asset, weight) at each month's first session, from signals (date, asset, mu) of the day before or
    earlier and the covariance of the last `lookback` sessions of returns (date, asset, ret), and `daily` (date, gross,
    cost, net). Rebalances are independent of each other; costs follow from the change of weights."""
    sessions = returns.select("date").distinct()
    first = sessions.groupBy(F.trunc("date", "month").alias("m")).agg(F.min("date").alias("rebalance")).select("rebalance")
    numbered = sessions.withColumn("_k", F.row_number().over(Window.orderBy("date")))  # a calendar
    marks = first.join(numbered, F.col("rebalance") == F.col("date")).select("rebalance", F.col("_k").alias("_r"))
    known = signals.join(F.broadcast(first), (F.col("date") < F.col("rebalance")) & (F.col("date") >= F.date_sub("rebalance", config.max_age)))
    mu = known.groupBy("rebalance", "asset").agg(F.max_by("mu", "date").alias("mu"))
    held = returns.join(F.broadcast(numbered), "date")
    past = held.join(F.broadcast(marks), (F.col("_k") < F.col("_r")) & (F.col("_k") >= F.col("_r") - config.lookback))
    rows = past.select("rebalance", "date", "asset", "ret").join(mu, ["rebalance", "asset"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["rebalance", "asset", "weight"])
        x = pdf.pivot_table(index="date", columns="asset", values="ret").dropna(axis=1)
        if len(x) < 10 or x.shape[1] < config.least_assets:
            return empty
        cov = estimates(x.to_numpy(float))[config.estimator]
        m = pdf.groupby("asset")["mu"].first().reindex(x.columns).to_numpy(float)
        w = portfolio.nco_weights(cov, m)
        var = float(w @ cov @ w)
        lever = min(max(config.kelly * float(w @ m) / var, 0.0), config.max_leverage) if var > 0 else 0.0
        gross = np.abs(w).sum()
        return pd.DataFrame({"rebalance": key[0], "asset": x.columns, "weight": w / gross * lever if gross > 0 else w * 0})

    asset = returns.schema["asset"].dataType.simpleString()
    weights = rows.groupBy("rebalance").applyInPandas(run, f"rebalance date, asset {asset}, weight double")
    spans = first.withColumn("until", F.lead("rebalance").over(Window.orderBy("rebalance")))  # a row a month
    live = returns.join(F.broadcast(spans), (F.col("date") >= F.col("rebalance")) & (F.col("until").isNull() | (F.col("date") < F.col("until"))))
    gross = live.join(weights, ["rebalance", "asset"]).groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    # a name that leaves is sold: its weight counts as 0 at the next rebalance
    after = spans.select("rebalance", "until")
    both = weights.unionByName(weights.join(F.broadcast(after), "rebalance").filter("until IS NOT NULL").select(F.col("until").alias("rebalance"), "asset", F.lit(0.0).alias("weight")))
    both = both.groupBy("rebalance", "asset").agg(F.sum("weight").alias("weight"))
    change = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(Window.partitionBy("asset").orderBy("rebalance")), F.lit(0.0)))
    cost = both.withColumn("_c", change).groupBy(F.col("rebalance").alias("date")).agg((F.sum("_c") * config.bps / 1e4).alias("cost"))
    daily = gross.join(cost, "date", "left").fillna(0.0, ["cost"]).withColumn("net", F.col("gross") - F.col("cost"))
    return {"weights": weights, "daily": daily}


# --- path signatures ----------------------------------------------------------------------------------------------------


def signature(path: np.ndarray, depth: int) -> np.ndarray:
    """The terms of levels 1 to depth of a path's signature: each step's exponential, multiplied on by Chen's rule."""
    d = path.shape[1]
    levels = [np.zeros((d,) * k) for k in range(1, depth + 1)]
    for step in np.diff(path, axis=0):
        powers = [step]
        for k in range(2, depth + 1):
            powers.append(np.multiply.outer(powers[-1], step) / k)
        levels = [
            levels[k] + powers[k] + sum((np.multiply.outer(levels[j], powers[k - 1 - j]) for j in range(k)), np.zeros((d,) * (k + 1)))
            for k in range(depth)
        ]
    return np.concatenate([x.ravel() for x in levels])


def augmented(path: np.ndarray, how: tuple[str, ...]) -> np.ndarray:
    """addtime: a first column from 0 to 1; leadlag: each column beside itself one step late; basepoint: a first row of 0."""
    if "leadlag" in how:
        twice = np.repeat(path, 2, axis=0)
        path = np.column_stack((twice[1:], twice[:-1]))
    if "addtime" in how:
        path = np.column_stack((np.linspace(0, 1, len(path)), path))
    if "basepoint" in how:
        path = np.vstack((np.zeros(path.shape[1]), path))
    return path


def signature_names(columns: list[str], depth: int, how: tuple[str, ...]) -> list[str]:
    d = len(columns) * (2 if "leadlag" in how else 1) + ("addtime" in how)
    return ["sig_" + "_".join(map(str, word)) for k in range(1, depth + 1) for word in product(range(1, d + 1), repeat=k)]


class _Signature(Fold):
    def __init__(self, columns: list[str], window: int, depth: int, how: tuple[str, ...], names: list[str]):
        self.columns, self.window, self.depth, self.how, self.names = columns, window, depth, how, names
        self.held = np.zeros((0, len(columns)))

    def rows(self, part: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack((self.held, part[self.columns].to_numpy(float)))
        skip, out = len(self.held), np.full((len(part), len(self.names)), np.nan)
        for k in range(len(part)):
            end = skip + k + 1
            if end >= self.window:
                path = x[end - self.window : end]
                out[k] = signature(augmented(path - path[0], self.how), self.depth)
        self.held = x[max(len(x) - self.window + 1, 0) :]
        return pd.concat((part.reset_index(drop=True), pd.DataFrame(out, columns=self.names)), axis=1)


def path_signatures(rows: DataFrame, by: str, at: list[str], columns: list[str], window: int = 64, depth: int = 3, how: tuple[str, ...] = ("basepoint", "addtime")) -> DataFrame:
    """rows with the signature terms of the last `window` rows' path, null until there are so many; paths start at 0, and
    level k is scaled by k! so that levels are of a size."""
    names = signature_names(columns, depth, how)
    schema = StructType(list(rows.schema.fields))
    for n in names:
        schema = schema.add(n, "double")
    out = ordered_fold(rows, by, at, lambda: _Signature(columns, window, depth, how, names), schema)
    fact = {k: float(np.prod(range(1, k + 1))) for k in range(1, depth + 1)}
    return out.select(*rows.columns, *(F.when(~F.isnan(n), F.col(n) * fact[n.count("_")]).alias(n) for n in names))


# --- catalog and ledger --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class FactorSpec:
    """A factor by name: the module and function that make it, what it needs, and words to find it by."""

    name: str
    category: str
    module: str
    function: str
    summary: str
    inputs: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()

    def resolve(self):
        return getattr(importlib.import_module(self.module), self.function)


class FactorCatalog:
    def __init__(self, specs: tuple[FactorSpec, ...] = ()):
        self.specs: dict[str, FactorSpec] = {}
        for s in specs:
            self.register(s)

    def register(self, spec: FactorSpec, overwrite: bool = False) -> None:
        if spec.name in self.specs and not overwrite:
            raise ValueError(f"{spec.name} is there already")
        self.specs[spec.name] = spec

    def get(self, name: str) -> FactorSpec:
        return self.specs[name]

    def list(self, category: str | None = None, tag: str | None = None) -> list[FactorSpec]:
        found = (s for s in self.specs.values() if category in (None, s.category) and (tag is None or tag in s.tags))
        return sorted(found, key=lambda s: (s.category, s.name))

    def search(self, text: str) -> list[FactorSpec]:
        """Specs whose name, summary or a tag holds the text, in either case."""
        low = text.lower()
        return [s for s in self.list() if any(low in x.lower() for x in (s.name, s.summary, *s.tags))]

    def categories(self) -> list[str]:
        return sorted({s.category for s in self.specs.values()})

    def to_json(self, indent: int = 2) -> str:
        return json.dumps([asdict(s) for s in self.list()], indent=indent)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.name, s.category, s.module, s.function, s.summary, list(s.inputs), list(s.tags)) for s in self.list()], "name string, category string, module string, function string, summary string, inputs array<string>, tags array<string>")


_XS, _MS, _EN = "tidemark.operators.crosssection", "tidemark.operators.microstructure", "tidemark.operators.entropy"
FACTORS = FactorCatalog((
    FactorSpec("momentum", "cross-section", _XS, "momentum", "Return of the past year without the last month", ("close",), ("trend",)),
    FactorSpec("reversal", "cross-section", _XS, "reversal", "Return of the last month, its sign turned", ("close",), ("mean reversion",)),
    FactorSpec("volatility", "cross-section", _XS, "volatility", "Deviation of daily returns", ("close",), ("risk",)),
    FactorSpec("illiquidity", "cross-section", _XS, "illiquidity", "Mean absolute return to dollar volume", ("close", "volume"), ("liquidity",)),
    FactorSpec("roll_spread", "microstructure", _MS, "roll_spread_rolling", "Spread implied by the autocovariance of price changes", ("price",), ("liquidity",)),
    FactorSpec("kyle_lambda", "microstructure", _MS, "kyle_lambda_rolling", "Price impact of signed volume", ("price", "size"), ("liquidity", "impact")),
    FactorSpec("amihud", "microstructure", _MS, "amihud", "Rolling absolute return to dollar volume", ("close", "volume"), ("liquidity",)),
    FactorSpec("corwin_schultz", "microstructure", _MS, "corwin_schultz", "Spread implied by highs and lows of two days", ("high", "low"), ("liquidity",)),
    FactorSpec("vpin", "microstructure", _MS, "vpin", "Volume-synchronised order imbalance", ("price", "size"), ("toxicity",)),
    FactorSpec("rolling_entropy", "information", _EN, "rolling_entropy", "Entropy of the symbols of a window", ("symbol",), ("information",)),
    FactorSpec("frac_diff", "information", _EN, "frac_diff", "Fractional difference of fixed width", ("value",), ("stationarity",)),
))


@dataclass(frozen=True)
class CodeVersion:
    commit: str
    dirty: bool


def code_version(folder: str = ".") -> CodeVersion:
    """The commit that a folder is at, and whether files differ from it; 'unknown' outside a repository."""
    try:
        run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
        return CodeVersion(run("rev-parse", "HEAD"), bool(run("status", "--porcelain")))
    except (OSError, subprocess.SubprocessError):
        return CodeVersion("unknown", False)


def panels_fingerprint(panels: dict[str, DataFrame]) -> str:
    """One content hash of several named panels."""
    import hashlib

    return hashlib.sha256(json.dumps({k: provenance.fingerprint(v) for k, v in sorted(panels.items())}, sort_keys=True).encode()).hexdigest()


def manifest_check(found: dict, df: DataFrame, code: str) -> dict[str, object]:
    """Which parts of a manifest still hold: run_id, data, code, and whether the run could be repeated."""
    now = provenance.manifest(df, found["params"], code, found["version"])
    out = {k: now[k] == found[k] for k in ("run_id", "data", "code")}
    return out | {"reproducible": all(out.values()), "detail": ", ".join(k for k, ok in out.items() if not ok)}
