"""Entropy of symbol sequences and structural breaks of price series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import kernels
from tidemark.fold import Fold, ordered_fold
from tidemark.functions import special


def _bits(counts: Column, base: float) -> Column:
    return -F.sum(counts * F.log(counts)) / F.log(F.lit(float(base)))


def shannon(rows: DataFrame, by: list[str], symbol: str, base: float = 2.0) -> DataFrame:
    """Plug-in entropy, its greatest value for the symbols seen, and the ratio of both."""
    per = rows.filter(F.col(symbol).isNotNull()).groupBy(*by, symbol).agg(F.count(F.lit(1)).alias("c"))
    total = F.sum("c").over(Window.partitionBy(*by))
    out = per.withColumn("p", F.col("c") / total).groupBy(*by).agg(F.count(F.lit(1)).alias("n_symbols"), _bits(F.col("p"), base).alias("entropy"))
    most = F.log(F.col("n_symbols").cast("double")) / F.log(F.lit(float(base)))
    return out.withColumns({"max_entropy": most, "normalized": F.coalesce(F.try_divide(F.col("entropy"), most), F.lit(0.0))})


def joint(rows: DataFrame, by: list[str], x: str, y: str, base: float = 2.0) -> DataFrame:
    """Joint and conditional entropy, mutual information, and the latter over the lesser entropy of the two."""
    held = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = held.withColumn("_xy", F.struct(x, y))
    parts = [shannon(both, by, c, base).select(*by, F.col("entropy").alias(name)) for c, name in (("_xy", "h_xy"), (x, "h_x"), (y, "h_y"))]
    out = parts[0].join(parts[1], by).join(parts[2], by)
    out = out.withColumns({"conditional": F.col("h_xy") - F.col("h_y"), "mutual": F.col("h_x") + F.col("h_y") - F.col("h_xy")})
    return out.withColumn("normalized_mutual", F.coalesce(F.try_divide("mutual", F.least("h_x", "h_y")), F.lit(0.0)))


def encode_binary(value: Column) -> Column:
    return F.when(value > 0, "1").when(value.isNotNull(), "0")


def encode_ternary(value: Column, threshold: float = 0.0) -> Column:
    return F.when(value > threshold, "+").when(value < -threshold, "-").when(value.isNotNull(), "0")


def encode_quantile(rows: DataFrame, value: str, n_bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """rows with `symbol`: the quantile bin over the group's whole sample; equal edges are one edge."""
    by = by or []
    cuts = [i / n_bins for i in range(1, n_bins)]
    edges = rows.groupBy(*by).agg(F.array_distinct(F.percentile(value, cuts)).alias("_e"))
    out = rows.join(F.broadcast(edges) if not by else edges, by) if by else rows.crossJoin(F.broadcast(edges))
    return out.withColumn("symbol", F.when(F.col(value).isNotNull(), F.size(F.filter("_e", lambda e: e < F.col(value)))).cast("string")).drop("_e")


def sequence_complexity(rows: DataFrame, by: str, at: list[str], symbol: str, window: int | None = None) -> DataFrame:
    """LZ78 phrases and entropy, and match-length entropy, of each group's whole message."""

    class Message(Fold):
        def __init__(self):
            self.key, self.parts = None, []

        def rows(self, part):
            self.key = part[by].iloc[0]
            self.parts.append("".join(part[symbol].dropna().astype(str)))

        def end(self):
            m = "".join(self.parts)
            c, n = kernels.lz78(m), len(m)
            lz = c * np.log2(n) / n if n > 1 else 0.0
            return pd.DataFrame({by: [self.key], "n": [n], "phrases": [c], "lz_entropy": [lz], "match_entropy": [kernels.match_length_entropy(m, window)]})

    kind = rows.schema[by].dataType.simpleString()
    return ordered_fold(rows.select(by, *at, symbol), by, at, Message, f"{by} {kind}, n long, phrases long, lz_entropy double, match_entropy double")


def rolling_entropy(rows: DataFrame, by: str, at: list[str], symbol: str, window: int, base: float = 2.0) -> DataFrame:
    """rows with the plug-in entropy of the last `window` symbols; NULL until there are so many, or where one is missing."""
    held = F.collect_list(symbol).over(Window.partitionBy(by).orderBy(*at).rowsBetween(-(window - 1), 0))
    rows = rows.withColumn("_m", held)
    p = F.transform(F.array_distinct("_m"), lambda s: F.size(F.filter("_m", lambda x: x == s)) / F.lit(float(window)))
    h = F.aggregate(p, F.lit(0.0), lambda acc, q: acc - q * F.log(q)) / F.log(F.lit(float(base)))
    return rows.withColumn("entropy", F.when(F.size("_m") == window, h)).drop("_m")


class _Tail(Fold):
    """Feeds a function with the last `width` - 1 values and the new ones."""

    def __init__(self, width: int, value: str, name: str, fn):
        self.width, self.value, self.name, self.fn, self.tail = width, value, name, fn, np.zeros(0)

    def rows(self, part):
        x = np.concatenate((self.tail, part[self.value].to_numpy(float)))
        out = self.fn(x)[len(self.tail) :]
        self.tail = x[-(self.width - 1) :] if self.width > 1 else np.zeros(0)
        return part.assign(**{self.name: out})


def frac_diff(rows: DataFrame, by: str, at: list[str], value: str, d: float, threshold: float = 1e-5) -> DataFrame:
    """rows with `ffd`: fixed-width fractional differences, NULL until the window is full."""
    weights = kernels.ffd_weights(d, threshold)
    over = Window.partitionBy(by).orderBy(*at)
    total = F.lit(0.0)
    if len(weights) <= 64:
        for k, w in enumerate(weights[::-1].tolist()):
            total = total + w * F.lag(value, k).over(over)
        return rows.withColumn("ffd", total)
    from tidemark.fold import with_column

    out = ordered_fold(rows, by, at, lambda: _Tail(len(weights), value, "ffd", lambda x: kernels.ffd(x, d, threshold)), with_column(rows, "ffd", "double"))
    return out.withColumn("ffd", F.when(~F.isnan("ffd"), F.col("ffd")))


def chow(rows: DataFrame, by: str, pos: str, value: str, breakpoint: int) -> DataFrame:
    """Chow's F for a break of intercept and trend at pos = breakpoint, with its p-value, from sums alone."""
    def rss(cond):
        y, x = F.when(cond, F.col(value)), F.when(cond, F.col(pos).cast("double"))
        n = F.count(y)
        return F.var_pop(y) * n - F.coalesce(F.try_divide(F.covar_pop(y, x) * F.covar_pop(y, x) * n, F.var_pop(x)), F.lit(0.0))

    before = F.col(pos) < breakpoint
    out = rows.groupBy(by).agg(F.count(value).alias("n"), rss(F.lit(True)).alias("_all"), rss(before).alias("_a"), rss(~before).alias("_b"), F.count(F.when(before, F.col(value))).alias("_na"))
    ok = (F.col("_na") > 2) & (F.col("n") - F.col("_na") > 2) & (F.col("n") > 4)
    split = F.col("_a") + F.col("_b")
    f = F.try_divide((F.col("_all") - split) / 2, split / (F.col("n") - 4))
    out = out.withColumn("chow_f", F.when(ok, f))
    return out.select(by, "n", "chow_f", special.f_sf(F.col("chow_f"), F.lit(2.0), F.col("n") - 4).alias("p"))


def bubbles(rows: DataFrame, by: str, at: list[str], value: str, p: int = 1, expanding: bool = False) -> DataFrame:
    """by, pos, bsadf: the backward sup ADF statistic at each row (expanding: from the first start only, i.e. SADF). Each
    series is held whole: the statistic looks back to its beginning from every row."""

    class Whole(Fold):
        def __init__(self):
            self.key, self.parts = None, []

        def rows(self, part):
            self.key = part[by].iloc[0]
            self.parts.append(part[value].to_numpy(float))

        def end(self):
            y = np.concatenate(self.parts)
            if len(y) < 3 * p + 8:
                return None
            out = kernels.bsadf(y, p, starts=1 if expanding else None)
            return pd.DataFrame({by: self.key, "pos": np.arange(len(y)), "bsadf": out})

    kind = rows.schema[by].dataType.simpleString()
    out = ordered_fold(rows.select(by, *at, value), by, at, Whole, f"{by} {kind}, pos long, bsadf double")
    return out.withColumn("bsadf", F.when(~F.isnan("bsadf"), F.col("bsadf")))


def episodes(stats: DataFrame, by: str, critical: float, least: int = 2, pos: str = "pos", value: str = "bsadf") -> DataFrame:
    """Runs of at least `least` rows above the critical value: by, start, end, peak."""
    w = Window.partitionBy(by).orderBy(pos)
    rows = stats.withColumn("_up", (F.coalesce(F.col(value), F.lit(-1e300)) > critical).cast("int"))
    fresh = ((F.col("_up") == 1) & (F.coalesce(F.lag("_up").over(w), F.lit(0)) == 0)).cast("int")
    rows = rows.withColumn("_new", fresh).withColumn("_ep", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_up = 1")
    out = rows.groupBy(by, "_ep").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.max(value).alias("peak"), F.count(F.lit(1)).alias("duration"))
    return out.filter(F.col("duration") >= least).drop("_ep")


def adf(rows: DataFrame, by: str, at: list[str], value: str, p: int = 1) -> DataFrame:
    """ADF statistic of each whole series."""
    kind = rows.schema[by].dataType.simpleString()

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(at)[value].to_numpy(float)
        return pd.DataFrame({by: [key[0]], "n": [len(y)], "adf": [kernels.adf_t(y, p) if len(y) >= 20 else None]})

    return rows.select(by, *at, value).groupBy(by).applyInPandas(run, f"{by} {kind}, n long, adf double")


def recursive_cusum(rows: DataFrame, by: str, pos: str, value: str, first: int = 10) -> DataFrame:
    """by, pos, cusum: running sum of the standardised one-step errors of the expanding mean, from row `first` on."""
    w = Window.partitionBy(by).orderBy(pos)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_k": F.count(value).over(before), "_m": F.avg(value).over(before), "_s": F.stddev_samp(value).over(before)})
    z = F.when((F.col("_k") >= first) & (F.col("_s") > 0), (F.col(value) - F.col("_m")) / (F.col("_s") * F.sqrt(1 + 1 / F.col("_k"))))
    return rows.withColumn("_z", z).select(by, pos, F.sum("_z").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cusum"))


def encode_sigma(rows: DataFrame, by: str, at: list[str], value: str, n_bins: int = 5, window: int = 100, least: int = 50) -> DataFrame:
    """rows with `symbol`: the bin of the z-score against the rows before; bins have equal width from -2 to 2."""
    before = Window.partitionBy(by).orderBy(*at).rowsBetween(-window, -1)
    z = F.try_divide(F.col(value) - F.avg(value).over(before), F.stddev_samp(value).over(before))
    place = F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.floor((z + 2) / 4 * n_bins)))
    return rows.withColumn("symbol", F.when(F.count(value).over(before) >= least, place.cast("string")))


def encode_quantile_causal(rows: DataFrame, by: str, at: list[str], value: str, n_bins: int = 10, least: int = 50, window: int | None = None) -> DataFrame:
    """rows with `symbol`: the quantile bin among earlier values only (all, or the last `window`), once there are enough."""
    w = Window.partitionBy(by).orderBy(*at)
    held = F.collect_list(value).over(w.rowsBetween(Window.unboundedPreceding if window is None else -window, -1))
    rows = rows.withColumn("_h", held)
    below = F.size(F.filter("_h", lambda x: x < F.col(value)))
    place = F.least(F.floor(below * n_bins / F.size("_h")), F.lit(n_bins - 1))
    return rows.withColumn("symbol", F.when((F.size("_h") >= least) & F.col(value).isNotNull(), place.cast("string"))).drop("_h")


def entropy_regime(rows: DataFrame, by: str, low: float = 0.3, high: float = 0.7, value: str = "entropy") -> DataFrame:
    """rows with `regime` by the entropy's place between the group's extremes. Looks at the whole sample."""
    w = Window.partitionBy(by)
    x = F.try_divide(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w))
    return rows.withColumn("_x", x).withColumn("regime", F.when(F.col("_x") < low, "mean_revert").when(F.col("_x") > high, "random").when(F.col("_x").isNotNull(), "trending")).drop("_x")


def critical_values(n: int, p: int = 1, n_sim: int = 200, quantiles: tuple[float, ...] = (0.9, 0.95, 0.99), seed: int = 0, sup: bool = True, spark=None) -> DataFrame:
    """quantile, value: of the (double) sup ADF statistic of random walks of length n; a path for each seeded row."""

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"].tolist():
                y = np.cumsum(np.random.default_rng([seed, i]).normal(size=n))
                out.append(float(np.nanmax(kernels.bsadf(y, p, starts=None if sup else 1))))
            yield pd.DataFrame({"stat": out})

    stats = spark.range(n_sim).repartition(max(1, n_sim // 25)).mapInPandas(run, "stat double")
    found = stats.agg(F.percentile("stat", list(quantiles)).alias("v"))
    return found.select(F.posexplode("v").alias("i", "value")).select(F.get(F.lit(list(quantiles)), F.col("i")).alias("quantile"), "value")
