"""Performance of return series: rows (series, date, ret). Means and deviations are of the sample; NULL is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIODS = 252


def _w(by: str, date: str = "date"):
    return Window.partitionBy(by).orderBy(date)


def report(rows: DataFrame, by: str, ret: str = "ret", rf: float = 0.0, periods: int = PERIODS) -> DataFrame:
    """n, annual return and volatility, Sharpe, Sortino, hit rate, best and worst of each series."""
    excess = F.col(ret) - rf
    down = F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), F.lit(2.0))))
    growth = F.sum(F.when(F.col(ret) > -1, F.log1p(ret)))
    out = rows.filter(F.col(ret).isNotNull()).groupBy(by).agg(
        F.count(ret).alias("n"), growth.alias("_g"), F.min(ret).alias("worst"), F.max(ret).alias("best"), F.stddev_samp(ret).alias("_sd"),
        F.avg(excess).alias("_m"), down.alias("_down"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
    )
    year = F.sqrt(F.lit(float(periods)))
    return out.select(
        by, "n",
        F.when(F.col("worst") <= -1, F.lit(-1.0)).otherwise(F.exp(F.col("_g") * periods / F.col("n")) - 1).alias("annual_return"),
        (F.col("_sd") * year).alias("annual_volatility"),
        F.try_divide(F.col("_m") * year, F.col("_sd")).alias("sharpe"),
        F.try_divide(F.col("_m") * year, F.col("_down")).alias("sortino"),
        "hit_rate", "best", "worst",
    )


def equity(rows: DataFrame, by: str, ret: str = "ret", date: str = "date") -> DataFrame:
    """rows with equity (product of 1 + ret), its peak so far and the drawdown."""
    so_far = _w(by, date).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("equity", F.exp(F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0)))).over(so_far)))
    out = out.withColumn("peak", F.greatest(F.max("equity").over(so_far), F.lit(1.0)))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def max_drawdown(rows: DataFrame, by: str, ret: str = "ret", date: str = "date") -> DataFrame:
    """The least drawdown, with its date (the first of equal ones)."""
    out = equity(rows, by, ret, date).groupBy(by).agg(F.min(F.struct(F.col("drawdown"), F.col(date).alias("d"))).alias("m"))
    return out.select(by, F.col("m.drawdown").alias("max_drawdown"), F.col("m.d").alias("trough"))


def drawdown_table(rows: DataFrame, by: str, top_n: int = 5, ret: str = "ret", date: str = "date") -> DataFrame:
    """The deepest underwater episodes of each series: first day under water, trough, recovery (NULL if none), depth."""
    e = equity(rows, by, ret, date)
    w = _w(by, date)
    wet = (F.col("drawdown") < -1e-12).cast("int")
    e = e.withColumn("_wet", wet)
    starts = ((F.col("_wet") == 1) & (F.coalesce(F.lag("_wet").over(w), F.lit(0)) == 0)).cast("int")
    e = e.withColumns({"_start": starts, "_next_dry": F.min(F.when(F.col("_wet") == 0, F.col(date))).over(w.rowsBetween(1, Window.unboundedFollowing))})
    e = e.withColumn("_ep", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_wet = 1")
    ep = e.groupBy(by, "_ep").agg(F.min(date).alias("start"), F.min(F.struct(F.col("drawdown"), F.col(date).alias("d"))).alias("m"), F.min("_next_dry").alias("recovery"), F.count(F.lit(1)).alias("n_days"))
    ep = ep.select(by, "start", F.col("m.d").alias("trough"), "recovery", F.col("m.drawdown").alias("depth"), "n_days")
    return ep.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("depth", "start"))).filter(F.col("rank") <= top_n)


def relative(rows: DataFrame, by: str, ret: str = "ret", bench: str = "bench", periods: int = PERIODS) -> DataFrame:
    """Active return, tracking error, information ratio, beta, alpha, correlation, up and down capture."""
    both = rows.filter(F.col(ret).isNotNull() & F.col(bench).isNotNull())
    active = F.col(ret) - F.col(bench)
    up, dn = F.col(bench) > 0, F.col(bench) < 0
    out = both.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(active).alias("_a"), F.stddev_samp(active).alias("_te"), F.regr_slope(F.col(ret), F.col(bench)).alias("beta"),
        F.avg(ret).alias("_r"), F.avg(bench).alias("_b"), F.corr(ret, bench).alias("correlation"),
        F.try_divide(F.avg(F.when(up, F.col(ret))), F.avg(F.when(up, F.col(bench)))).alias("up_capture"),
        F.try_divide(F.avg(F.when(dn, F.col(ret))), F.avg(F.when(dn, F.col(bench)))).alias("down_capture"),
    )
    year = F.sqrt(F.lit(float(periods)))
    return out.select(
        by, "n", (F.col("_a") * periods).alias("active_return"), (F.col("_te") * year).alias("tracking_error"), F.try_divide(F.col("_a") * year, F.col("_te")).alias("information_ratio"),
        "beta", ((F.col("_r") - F.col("beta") * F.col("_b")) * periods).alias("alpha"), "correlation", "up_capture", "down_capture",
    )


def tail(rows: DataFrame, by: str, level: float = 0.95, ret: str = "ret") -> DataFrame:
    """Historical VaR (linear quantile), CVaR, bias-corrected skew and excess kurtosis."""
    held = rows.filter(F.col(ret).isNotNull())
    cut = held.groupBy(by).agg(F.percentile(ret, 1 - level).alias("_q"), F.count(ret).alias("n"), F.skewness(ret).alias("_g1"), F.kurtosis(ret).alias("_g2"))
    es = held.join(cut.select(by, "_q"), by).filter(F.col(ret) <= F.col("_q")).groupBy(by).agg((-F.avg(ret)).alias("cvar"))
    n = F.col("n")
    out = cut.join(es, by)
    return out.select(
        by, "n", (-F.col("_q")).alias("var"), "cvar",
        F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, ((n + 1) * F.col("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
    )


def rolling(rows: DataFrame, by: str, window: int, bench: str | None = None, ret: str = "ret", date: str = "date", periods: int = PERIODS) -> DataFrame:
    """rolling_vol and rolling_sharpe, and with a benchmark rolling_beta and rolling_ir; NULL until the window is full."""
    over = _w(by, date).rowsBetween(-(window - 1), 0)
    year = F.sqrt(F.lit(float(periods)))
    ready = F.count(ret).over(over) == window
    sd = F.stddev_samp(ret).over(over)
    cols = {"rolling_vol": F.when(ready, sd * year), "rolling_sharpe": F.when(ready, F.try_divide(F.avg(ret).over(over) * year, sd))}
    if bench:
        active = F.col(ret) - F.col(bench)
        both = F.count(active).over(over) == window
        cols["rolling_beta"] = F.when(both, F.try_divide(F.covar_samp(ret, bench).over(over), F.var_samp(bench).over(over)))
        cols["rolling_ir"] = F.when(both, F.try_divide(F.avg(active).over(over) * year, F.stddev_samp(active).over(over)))
    return rows.withColumns(cols)


def attribution(rows: DataFrame, by: str, factors: list[str], ret: str = "ret") -> DataFrame:
    """OLS of ret on an intercept and up to two factors, from sums of squares and products."""
    held = rows.dropna(subset=[ret, *factors])
    if len(factors) == 1:
        x = factors[0]
        out = held.groupBy(by).agg(F.regr_intercept(F.col(ret), F.col(x)).alias("intercept"), F.regr_slope(F.col(ret), F.col(x)).alias(f"beta_{x}"), F.regr_r2(F.col(ret), F.col(x)).alias("r2"))
        return out
    x, z = factors
    m = held.groupBy(by).agg(*(F.avg(c).alias(f"_{c}") for c in (ret, x, z)), F.var_pop(x).alias("xx"), F.var_pop(z).alias("zz"), F.var_pop(ret).alias("yy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(x, ret).alias("xy"), F.covar_pop(z, ret).alias("zy"))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    bx = F.try_divide(F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz"), det)
    bz = F.try_divide(F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz"), det)
    m = m.withColumns({f"beta_{x}": bx, f"beta_{z}": bz})
    fit = F.col(f"beta_{x}") * F.col("xy") + F.col(f"beta_{z}") * F.col("zy")
    return m.select(by, (F.col(f"_{ret}") - F.col(f"beta_{x}") * F.col(f"_{x}") - F.col(f"beta_{z}") * F.col(f"_{z}")).alias("intercept"), f"beta_{x}", f"beta_{z}", F.try_divide(fit, F.col("yy")).alias("r2"))


def turnover(weights: DataFrame, by: str = "instrument", weight: str = "weight", date: str = "date", one_sided: bool = True) -> DataFrame:
    """Mean over dates of the sum of weight changes, halved if one-sided; the first date opens no trade."""
    change = F.abs(F.col(weight) - F.lag(weight).over(_w(by, date)))
    per_day = weights.withColumn("_c", change).groupBy(date).agg(F.sum("_c").alias("_t")).filter("_t IS NOT NULL")
    return per_day.agg((F.avg("_t") * (0.5 if one_sided else 1.0)).alias("turnover"), F.count(F.lit(1)).alias("n_dates"))


def contribution(rows: DataFrame, by: str = "instrument", weight: str = "weight", ret: str = "ret", date: str = "date") -> DataFrame:
    """Sum over dates of the weight held before, times the return."""
    return rows.withColumn("_c", F.lag(weight).over(_w(by, date)) * F.col(ret)).groupBy(by).agg(F.sum("_c").alias("contribution"))


def nav(fills: DataFrame, prices: DataFrame, cash: float, date: str = "date") -> DataFrame:
    """NAV by date of fills (ts, ticker, qty, price, commission): cash left and holdings at each date's prices; a holding
    without a valid price counts 0 that day."""
    flows = fills.select(F.to_date("ts").alias(date), "ticker", "qty", (-(F.col("qty") * F.col("price")) - F.coalesce(F.col("commission"), F.lit(0.0))).alias("cash"))
    days = prices.select(date).distinct()
    # holdings: net quantity of each ticker up to each of its price dates
    net = flows.groupBy("ticker", date).agg(F.sum("qty").alias("q"))
    marks = prices.select("ticker", date, "price").join(net, ["ticker", date], "full")
    held = marks.withColumn("_q", F.sum(F.coalesce("q", F.lit(0.0))).over(Window.partitionBy("ticker").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)))
    value = held.filter("price > 0").groupBy(date).agg(F.sum(F.col("_q") * F.col("price")).alias("holdings"))
    flow = flows.groupBy(date).agg(F.sum("cash").alias("c"))
    # one row for each date: a calendar, small enough to be ordered at once
    line = Window.partitionBy(F.lit(0)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = days.join(flow, date, "full").withColumn("cash", F.lit(cash) + F.sum(F.coalesce("c", F.lit(0.0))).over(line))
    return out.join(days, date, "left_semi").join(value, date, "left").select(date, "cash", F.coalesce("holdings", F.lit(0.0)).alias("holdings"), (F.col("cash") + F.coalesce("holdings", F.lit(0.0))).alias("nav"))


