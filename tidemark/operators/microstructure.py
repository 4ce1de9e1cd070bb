"""Microstructure operators over tick tapes (instrument, ts, seq, price, size, side) and daily bars.

Rolling values are NULL until their window is full unless said otherwise. Windows are ordered by (ts, seq).
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import kernels
from tidemark.fold import PerRow, ordered_fold, with_column
from tidemark.functions import special
from tidemark.operators.bars import order, tick_rule


def roll_spread(ticks: DataFrame) -> DataFrame:
    """2 sqrt(-cov(dp, lagged dp)) of each instrument; NULL if the covariance isn't negative."""
    rows = ticks.withColumn("_dp", F.col("price") - F.lag("price").over(order()))
    rows = rows.withColumn("_dq", F.lag("_dp").over(order())).filter("_dp IS NOT NULL AND _dq IS NOT NULL")
    out = rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("_dp", "_dq").alias("_c"))
    return out.select("instrument", "n", F.when(F.col("_c") < 0, 2 * F.sqrt(-F.col("_c"))).alias("roll_spread"))


def roll_spread_rolling(ticks: DataFrame, window: int = 100) -> DataFrame:
    rows = ticks.withColumn("_dp", F.col("price") - F.lag("price").over(order()))
    rows = rows.withColumn("_dq", F.lag("_dp").over(order()))
    over = order().rowsBetween(-(window - 1), 0)
    c = F.covar_samp("_dp", "_dq").over(over)
    ready = F.count(F.col("_dp") + F.col("_dq")).over(over) >= 10
    return rows.withColumn("roll_spread", F.when(ready & (c < 0), 2 * F.sqrt(-c))).drop("_dp", "_dq")


def _signed(ticks: DataFrame) -> DataFrame:
    rows = tick_rule(ticks)
    return rows.withColumns({"_dp": F.col("price") - F.lag("price").over(order()), "_sv": F.col("side") * F.col("size")})


def kyle_lambda(ticks: DataFrame) -> DataFrame:
    """Slope of price changes on signed volume; NULL below 10 observations."""
    rows = _signed(ticks).filter("_dp IS NOT NULL")
    return rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 10, F.regr_slope("_dp", "_sv")).alias("kyle_lambda"))


def kyle_lambda_rolling(ticks: DataFrame, window: int = 100) -> DataFrame:
    """Slope over the last `window` rows, from the row where the first window ends, with 10 valid pairs at least."""
    rows = _signed(ticks)
    over = order().rowsBetween(-(window - 1), 0)
    sv = F.when(F.col("_dp").isNotNull(), F.col("_sv"))
    ready = (F.col("rn") >= window) & (F.count("_dp").over(over) >= 10)
    slope = F.try_divide(F.covar_samp("_dp", "_sv").over(over), F.var_samp(sv).over(over))
    return rows.withColumn("kyle_lambda", F.when(ready, slope)).drop("_dp", "_sv")


def amihud(panel: DataFrame, window: int = 20) -> DataFrame:
    """Rolling mean of |return| / volume over daily bars."""
    w = Window.partitionBy("instrument").orderBy("date")
    ratio = F.when(F.col("volume") > 0, F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1) / F.col("volume"))
    rows = panel.withColumn("_r", ratio)
    over = w.rowsBetween(-(window - 1), 0)
    return rows.withColumn("amihud", F.when(F.count("_r").over(over) == window, F.avg("_r").over(over))).drop("_r")


def parkinson(panel: DataFrame, window: int = 20) -> DataFrame:
    w = Window.partitionBy("instrument").orderBy("date").rowsBetween(-(window - 1), 0)
    rows = panel.withColumn("_h", F.pow(F.log(F.col("high") / F.col("low")), F.lit(2.0)))
    value = F.sqrt(F.avg("_h").over(w) / (4 * log(2)))
    return rows.withColumn("parkinson", F.when(F.count("_h").over(w) == window, value)).drop("_h")


def corwin_schultz(panel: DataFrame) -> DataFrame:
    """Spread from the highs and lows of two days, within [0, 1]."""
    w = Window.partitionBy("instrument").orderBy("date")
    hl2 = F.pow(F.log(F.col("high") / F.col("low")), F.lit(2.0))
    rows = panel.withColumn("_b", hl2)
    beta = F.col("_b") + F.lag("_b").over(w)
    gamma = F.pow(F.log(F.greatest(F.col("high"), F.lag("high").over(w)) / F.least(F.col("low"), F.lag("low").over(w))), F.lit(2.0))
    k = 3 - 2 * sqrt(2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    rows = rows.withColumn("_s", spread)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s")))
    return rows.withColumn("corwin_schultz", F.when(F.col("_s").isNotNull(), value)).drop("_b", "_s")


def bulk_classification(ticks: DataFrame, window: int = 50) -> DataFrame:
    """buy_share: the normal probability of the standardised price change."""
    rows = ticks.withColumn("_dp", F.col("price") - F.lag("price").over(order()))
    over = order().rowsBetween(-(window - 1), 0)
    z = F.try_divide(F.col("_dp") - F.avg("_dp").over(over), F.stddev_samp("_dp").over(over))
    rows = rows.withColumn("bvc_z", F.when(F.count("_dp").over(over) == window, z))
    return rows.withColumn("buy_share", special.norm_cdf(F.col("bvc_z"))).drop("_dp")


def vpin(ticks: DataFrame, bucket: float, n_buckets: int = 50) -> DataFrame:
    """Volume buckets (bucket j ends with the trade whose cumulative volume first reaches j * bucket), their imbalance by
    the tick rule, and the rolling mean over n_buckets."""
    rows = tick_rule(ticks)
    so_far = order().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.sum("size").over(so_far))
    # a trade belongs to the bucket that is open before it
    opened = F.floor((F.col("_cum") - F.col("size")) / bucket)
    filled = F.floor(F.max("_cum").over(order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / bucket)
    rows = rows.withColumns({"bucket": opened, "_filled": filled}).filter(F.col("bucket") < F.col("_filled"))
    buy, sell = F.sum(F.when(F.col("side") > 0, F.col("size")).otherwise(0)), F.sum(F.when(F.col("side") < 0, F.col("size")).otherwise(0))
    out = rows.groupBy("instrument", "bucket").agg(F.max("ts").alias("ts"), F.max("rn").alias("last_rn"), F.abs(buy - sell).alias("_d"), F.sum("size").alias("volume"))
    out = out.withColumn("imbalance", F.try_divide("_d", "volume"))
    w = Window.partitionBy("instrument").orderBy("bucket").rowsBetween(-(n_buckets - 1), 0)
    return out.withColumn("vpin", F.when(F.count(F.lit(1)).over(w) == n_buckets, F.avg("imbalance").over(w))).drop("_d", "last_rn")


def top_of_book(quotes: DataFrame) -> DataFrame:
    """mid, spread, relative spread, imbalance, microprice and its deviation; NULL where the book is crossed or missing."""
    bp, ap, bs, as_ = (F.col(c) for c in ("bid_px", "ask_px", "bid_sz", "ask_sz"))
    ok = bp.isNotNull() & ap.isNotNull() & (ap > bp)
    mid = F.when(ok, (ap + bp) / 2)
    total = F.when(ok & (bs + as_ > 0), bs + as_)
    rows = quotes.withColumns({"mid": mid, "spread": F.when(ok, ap - bp), "imbalance": (bs - as_) / total, "microprice": (ap * bs + bp * as_) / total})
    return rows.withColumns({"rel_spread": F.try_divide(F.col("spread"), F.col("mid")), "micro_dev": F.try_divide(F.col("microprice") - F.col("mid"), F.col("mid"))})


def signed_flow(ticks: DataFrame, side: str | None = None) -> DataFrame:
    """direction (the exchange's side B or A, otherwise the tick rule), signed volume and signed dollars."""
    rows = tick_rule(ticks if side is None else ticks.withColumnRenamed(side, "_x"))
    direction = F.col("side") if side is None else F.when(F.col("_x") == "B", 1).when(F.col("_x") == "A", -1).otherwise(F.col("side"))
    rows = rows.withColumn("direction", direction.cast("int"))
    out = rows.withColumns({"signed_volume": F.col("direction") * F.col("size"), "signed_dollars": F.col("direction") * F.col("size") * F.col("price")})
    return out if side is None else out.drop("_x")


def realized_moments(rows: DataFrame, by: list[str], at: list[str], ret: str = "ret", min_obs: int = 5) -> DataFrame:
    """Realised variance, semivariances, signed jump, bipower variation, relative jump, skew and quarticity of each group."""
    w = Window.partitionBy(*by).orderBy(*at)
    held = rows.filter(F.col(ret).isNotNull()).withColumn("_p", F.abs(F.col(ret)) * F.abs(F.lag(ret).over(w)))
    r = F.col(ret)
    out = held.groupBy(*by).agg(
        F.count(r).alias("n"), F.sum(r * r).alias("rv"), F.sum(F.when(r > 0, r * r).otherwise(0.0)).alias("rs_plus"), F.sum(F.when(r < 0, r * r).otherwise(0.0)).alias("rs_minus"),
        (F.lit(3.141592653589793 / 2) * F.coalesce(F.sum("_p"), F.lit(0.0))).alias("bpv"), F.sum(r * r * r).alias("_s3"), F.sum(r * r * r * r).alias("_s4"),
    )
    ok = F.col("n") >= min_obs
    made = {
        "signed_jump": F.col("rs_plus") - F.col("rs_minus"),
        "rel_jump": F.try_divide(F.greatest(F.col("rv") - F.col("bpv"), F.lit(0.0)), F.col("rv")),
        "skew": F.try_divide(F.sqrt("n") * F.col("_s3"), F.pow("rv", F.lit(1.5))),
        "quarticity": F.col("n") / 3 * F.col("_s4"),
    }
    out = out.withColumns(made).drop("_s3", "_s4")
    return out.select(*by, "n", *(F.when(ok, F.col(c)).alias(c) for c in ("rv", "rs_plus", "rs_minus", "signed_jump", "bpv", "rel_jump", "skew", "quarticity")))


def deseasonalize(rows: DataFrame, by: str, bucket: str, value: str, at: list[str]) -> DataFrame:
    """multiplier: median of the bucket's earlier values over the median of all earlier values of the group; missing where
    either has none, or the latter is 0. Rows are folded in order, with the group's values held sorted."""
    make = lambda: PerRow(kernels.MedianBefore().push, [bucket, value], "multiplier")
    out = ordered_fold(rows, by, at, make, with_column(rows, "multiplier", "double"))
    return out.withColumn("multiplier", F.when(~F.isnan("multiplier"), F.col("multiplier")))


def vpin_bulk(ticks: DataFrame, bucket: float, n_buckets: int = 50, least: int = 10) -> DataFrame:
    """Volume buckets classified in bulk: buy share from the bucket's price change over its expanding deviation, imbalance
    |2 share - 1|, and the rolling mean of n_buckets; a deviation that is missing or 0 counts as a share of one half."""
    so_far = order().rowsBetween(Window.unboundedPreceding, 0)
    rows = ticks.withColumn("_cum", F.sum("size").over(so_far)).withColumn("bucket", F.floor((F.col("_cum") - F.col("size")) / bucket))
    closes = rows.groupBy("instrument", "bucket").agg(F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("size").alias("volume"), F.max("ts").alias("ts"))
    w = Window.partitionBy("instrument").orderBy("bucket")
    out = closes.withColumn("_d", F.col("close") - F.lag("close").over(w))
    grown = w.rowsBetween(Window.unboundedPreceding, 0)
    sd = F.when(F.count("_d").over(grown) >= least, F.stddev_samp("_d").over(grown))
    share = F.coalesce(special.norm_cdf(F.try_divide(F.col("_d"), F.col("_sd"))), F.lit(0.5))
    out = out.withColumn("_sd", sd).withColumn("imbalance", F.abs(2 * share - 1))
    last = w.rowsBetween(-(n_buckets - 1), 0)
    return out.withColumn("vpin", F.when(F.count(F.lit(1)).over(last) == n_buckets, F.avg("imbalance").over(last))).drop("_d", "_sd")
