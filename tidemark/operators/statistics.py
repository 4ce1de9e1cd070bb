"""Sharpe statistics and corrections for multiple testing, as aggregations of return tables."""

from __future__ import annotations

from math import comb
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import special


def moments(rows: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """n, mean, sd (of the sample), and the biased skew and excess kurtosis."""
    return rows.groupBy(*by).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"), F.skewness(ret).alias("skew"), F.kurtosis(ret).alias("kurt"))


def sharpe(rows: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """n, sr (per period), sr_std from skew and kurtosis: (1 + sr^2 / 2 - skew sr + kurt / 4 sr^2) / (n - 1)."""
    sr = F.try_divide(F.col("mean"), F.col("sd"))
    out = moments(rows, by, ret).withColumn("sr", sr)
    var = (1 + 0.5 * F.col("sr") ** 2 - F.col("skew") * F.col("sr") + F.col("kurt") / 4 * F.col("sr") ** 2) / (F.col("n") - 1)
    return out.withColumn("sr_std", F.when((F.col("n") > 1) & (var > 0), F.sqrt(var)))


def psr(rows: DataFrame, by: list[str], benchmark: float = 0.0, ret: str = "ret") -> DataFrame:
    """Probabilistic Sharpe: z = (sr - benchmark) / sr_std and its probability."""
    out = sharpe(rows, by, ret).withColumn("psr_z", (F.col("sr") - benchmark) / F.col("sr_std"))
    return out.withColumn("psr", special.norm_cdf(F.col("psr_z")))


def expected_max_z(n_trials: Column) -> Column:
    """Expected greatest of n standard normals: (1 - g) z(1 - 1/n) + g z(1 - 1/(n e))."""
    g, n = special.EULER, n_trials.cast("double")
    return (1 - g) * special.norm_ppf(1 - 1 / n) + g * special.norm_ppf(1 - 1 / (n * F.exp(F.lit(1.0))))


def dsr(rows: DataFrame, by: list[str], n_trials: int, benchmark: float = 0.0, across: bool = True, ret: str = "ret") -> DataFrame:
    """Deflated Sharpe; sigma is the spread of the trials' Sharpe ratios (across) or the path's own."""
    out = psr(rows, by, benchmark, ret)
    if n_trials <= 1:
        return out.withColumn("dsr", F.col("psr"))
    sigma = F.stddev_samp("sr").over(Window.partitionBy(F.lit(0))) if across else F.col("sr_std")
    out = out.withColumn("_sigma", sigma)
    z = (F.col("sr") - benchmark - F.col("_sigma") * expected_max_z(F.lit(n_trials))) / F.col("_sigma")
    return out.withColumns({"dsr_z": z, "dsr": special.norm_cdf(z)}).drop("_sigma")


def min_backtest_length(n_trials: Column, target: Column) -> Column:
    g, n = special.EULER, n_trials.cast("double")
    z1, z2 = special.norm_ppf(1 - 1 / n), special.norm_ppf(1 - 1 / (n * F.exp(F.lit(1.0))))
    return ((1 - g) * z1 * z1 + g * z2 * z2) / (target * target)


def adjusted_p(tests: DataFrame, method: str, p: str = "p", order: str = "name") -> DataFrame:
    """tests with p_adj by 'bonferroni', 'holm' or 'bhy'. A family of tests is small and ordered in one task."""
    family = Window.partitionBy(F.lit(0))
    rows = tests.withColumns({"_k": F.row_number().over(family.orderBy(p, order)), "_n": F.count(F.lit(1)).over(family)})
    if method == "bonferroni":
        adj = F.col(p) * F.col("_n")
    elif method == "holm":
        rows = rows.withColumn("_raw", F.col(p) * (F.col("_n") - F.col("_k") + 1))
        adj = F.max("_raw").over(family.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bhy":
        harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_n").cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / i)
        rows = rows.withColumn("_raw", F.col(p) * F.col("_n") * harmonic / F.col("_k"))
        adj = F.min("_raw").over(family.orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(method)
    return rows.withColumn("p_adj", F.least(adj, F.lit(1.0))).drop("_k", "_n", "_raw")


def haircut(rows: DataFrame, by: list[str], method: str = "holm", ret: str = "ret") -> DataFrame:
    """Sharpe ratios cut to what their adjusted p-values are worth."""
    out = sharpe(rows, by, ret).withColumn("t", F.col("sr") * F.sqrt("n"))
    out = out.withColumn("p", special.t_two_sided(F.col("t"), F.col("n") - 1))
    cut = adjusted_p(out, method, "p", by[0])
    t_adj = special.norm_ppf(1 - F.col("p_adj") / 2)
    return cut.withColumn("sr_haircut", F.signum("sr") * F.greatest(t_adj, F.lit(0.0)) / F.sqrt("n"))


def overfitting(perf: DataFrame, n_blocks: int, strategy: str = "strategy", block: str = "block", ret: str = "ret") -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation over n_blocks blocks of time.

    Block sums are taken once; each way of choosing half of the blocks gives the mean in and out of sample of every
    strategy, and the share of ways where the best in sample ranks in the lower half out of sample is returned."""
    if n_blocks % 2 or comb(n_blocks, n_blocks // 2) > 20_000:
        raise ValueError("n_blocks has to be even and at most 16")
    sums = perf.groupBy(strategy, block).agg(F.sum(ret).alias("s"), F.count(ret).alias("k"))
    ways = [(i, b) for i, chosen in enumerate(combinations(range(n_blocks), n_blocks // 2)) for b in chosen]
    picked = perf.sparkSession.createDataFrame(ways, f"way int, {block} int")
    n_ways = len(ways) // (n_blocks // 2)
    everyone = sums.crossJoin(F.broadcast(perf.sparkSession.range(n_ways).select(F.col("id").cast("int").alias("way"))))
    marked = everyone.join(F.broadcast(picked.withColumn("ins", F.lit(1))), ["way", block], "left")
    inside = F.col("ins").isNotNull()
    means = marked.groupBy("way", strategy).agg(
        (F.sum(F.when(inside, F.col("s"))) / F.sum(F.when(inside, F.col("k")))).alias("is_"),
        (F.sum(F.when(~inside, F.col("s"))) / F.sum(F.when(~inside, F.col("k")))).alias("oos"),
    )
    w = Window.partitionBy("way")
    ranked = means.withColumns({"best": F.row_number().over(w.orderBy(F.desc("is_"), strategy)), "r": F.rank().over(w.orderBy("oos")), "n": F.count(F.lit(1)).over(w)})
    winners = ranked.filter("best = 1").withColumn("logit", F.log((F.col("r") / (F.col("n") + 1)) / (1 - F.col("r") / (F.col("n") + 1))))
    return winners.agg(F.count(F.lit(1)).alias("n_ways"), F.avg((F.col("logit") < 0).cast("double")).alias("pbo"))
