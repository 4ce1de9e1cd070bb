"""Cross-sectional factors and their screening. Panels stay long: (date, instrument, value).

Ranks are average ranks. An IC is the correlation over a date's instruments; each side is ranked over its own non-null
values before the two are matched. Missing values are NULL throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import special


def _w(key: str = "instrument", date: str = "date"):
    return Window.partitionBy(key).orderBy(date)


def momentum(panel: DataFrame, lookback: int = 252, skip: int = 21, price: str = "close") -> DataFrame:
    return panel.withColumn("factor", F.try_divide(F.lag(price, skip).over(_w()), F.lag(price, lookback).over(_w())) - 1)


def reversal(panel: DataFrame, lookback: int = 21, price: str = "close") -> DataFrame:
    return panel.withColumn("factor", -(F.try_divide(F.col(price), F.lag(price, lookback).over(_w())) - 1))


def with_returns(panel: DataFrame, price: str = "close") -> DataFrame:
    return panel.withColumn("ret", F.try_divide(F.col(price), F.lag(price).over(_w())) - 1)


def full(value: Column, over, window: int, counted: Column) -> Column:
    """A rolling value where the window holds `window` observations, NULL before."""
    return F.when(F.count(counted).over(over) == window, value.over(over))


def volatility(panel: DataFrame, lookback: int = 63) -> DataFrame:
    over = _w().rowsBetween(-(lookback - 1), 0)
    return with_returns(panel).withColumn("factor", full(F.stddev_samp("ret"), over, lookback, F.col("ret")))


def illiquidity(panel: DataFrame, lookback: int = 21) -> DataFrame:
    dollars = F.col("close") * F.col("volume")
    rows = with_returns(panel).withColumn("_il", F.when(dollars > 0, F.abs("ret") / dollars))
    over = _w().rowsBetween(-(lookback - 1), 0)
    return rows.withColumn("factor", full(F.avg("_il"), over, lookback, F.col("_il"))).drop("_il")


def forward_returns(panel: DataFrame, horizon: int = 1, price: str = "close") -> DataFrame:
    return panel.withColumn("forward_return", F.try_divide(F.lead(price, horizon).over(_w()), F.col(price)) - 1)


def average_rank(value: str, date: str = "date") -> Column:
    """Average rank of the non-null values of a date; NULL for NULLs."""
    own = Window.partitionBy(date, F.col(value).isNull())
    return F.when(F.col(value).isNotNull(), F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(own.partitionBy(date, value)) - 1) / 2)


def information_coefficients(frame: DataFrame, method: str = "spearman", min_obs: int = 5, factor: str = "factor", ret: str = "forward_return", date: str = "date") -> DataFrame:
    """date, n, ic; NULL below min_obs or without variance."""
    x, y = factor, ret
    if method == "spearman":
        frame = frame.withColumns({"_x": average_rank(factor, date), "_y": average_rank(ret, date)})
        x, y = "_x", "_y"
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    out = frame.groupBy(date).agg(F.count(a).alias("n"), F.corr(a, b).alias("ic"), F.var_pop(a).alias("_vx"), F.var_pop(b).alias("_vy"))
    ok = (F.col("n") >= min_obs) & (F.col("_vx") > 0) & (F.col("_vy") > 0)
    return out.select(date, "n", F.when(ok, F.col("ic")).alias("ic"))


def hac_mean(series: DataFrame, value: str, order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """n, mean, and the Newey-West standard error of the mean (Bartlett weights, 1/n autocovariances), by group."""
    by = by or []
    rows = series.filter(F.col(value).isNotNull())
    centre = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    rows = rows.withColumn("_d", F.col(value) - F.avg(value).over(centre))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    products = [F.sum(f"_g{k}").alias(f"_s{k}") for k in range(lags + 1)]
    for k in range(lags + 1):
        rows = rows.withColumn(f"_g{k}", F.col("_d") * (F.col("_d") if k == 0 else F.lag("_d", k).over(w)))
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *products)
    total = F.coalesce(F.col("_s0"), F.lit(0.0))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.col(f"_s{k}"), F.lit(0.0))
    variance = total / (F.col("n") * F.col("n"))
    return out.select(*by, "n", "mean", F.when(variance > 0, F.sqrt(variance)).alias("se"))


def bh_q(tests: DataFrame, p: str = "p", order: str = "name") -> DataFrame:
    """Benjamini-Hochberg q over all rows: the running least, from the largest p down, of p * n / rank.
    A family of tests is a small table by its nature; it is ordered in one task."""
    family = Window.partitionBy(F.lit(0))
    rows = tests.withColumns({"_rank": F.row_number().over(family.orderBy(p, order)), "_n": F.count(F.lit(1)).over(family)})
    raw = F.col(p) * F.col("_n") / F.col("_rank")
    down = family.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_raw", raw).withColumn("q", F.least(F.min("_raw").over(down), F.lit(1.0))).drop("_rank", "_n", "_raw")


def screen(frame: DataFrame, method: str = "spearman", hac_lags: int = 0, fdr: float = 0.1, min_obs: int = 5) -> DataFrame:
    """frame: date, instrument, name, factor, forward_return. One row for each factor name: IC statistics, p, q, rank."""
    x, y, d = "factor", "forward_return", "_k"
    keyed = frame.withColumn("_k", F.struct("name", "date"))
    ics = information_coefficients(keyed, method, min_obs, x, y, d).select("_k.name", "_k.date", "ic")
    tested = hac_mean(ics, "ic", "date", hac_lags, ["name"])
    spread = ics.groupBy("name").agg(F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"))
    t = F.try_divide(F.col("mean"), F.col("se"))
    p = F.when((F.col("n") < 3) | F.col("t").isNull(), F.lit(1.0)).otherwise(special.t_two_sided(F.col("t"), F.col("n") - 1))
    rows = tested.join(spread, "name").withColumn("t", t).withColumn("p", p)
    out = bh_q(rows).withColumn("significant", F.col("q") <= fdr)
    # a row for each factor name: small
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(F.abs("mean")), "name")))


def long_short(frame: DataFrame, factor: str = "factor", ret: str = "forward_return", date: str = "date") -> DataFrame:
    """date, ls_return: weights are ranks less their mean, over the sum of their sizes."""
    ranked = frame.withColumn("_r", average_rank(factor, date))
    centred = ranked.withColumn("_w", F.col("_r") - F.avg("_r").over(Window.partitionBy(date)))
    out = centred.groupBy(date).agg(F.sum(F.abs("_w")).alias("_gross"), F.sum(F.col("_w") * F.col(ret)).alias("_pnl"))
    return out.select(date, F.when(F.col("_gross") > 0, F.col("_pnl") / F.col("_gross")).alias("ls_return"))
