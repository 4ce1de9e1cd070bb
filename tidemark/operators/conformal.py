"""Conformal intervals and sets from tables of scores, their metrics, and risk intervals of return series.

The finite-sample quantile of n scores at level alpha is the min(k + 1, n)-th least one, k = ceil((n + 1)(1 - alpha)).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import kernels
from tidemark.fold import Fold, ordered_fold
from tidemark.functions import special


def absolute(y: Column, pred: Column) -> Column:
    return F.abs(y - pred)


def signed(y: Column, pred: Column) -> Column:
    return y - pred


def normalized(y: Column, pred: Column, std: Column, eps: float = 1e-8) -> Column:
    return F.abs(y - pred) / (std + eps)


def gamma(y: Column, pred: Column, std: Column, power: float = 0.1, eps: float = 1e-8) -> Column:
    return F.abs(y - pred) / (F.pow(std, F.lit(power)) + eps)


def quantile_gap(y: Column, lower: Column, upper: Column) -> Column:
    return F.greatest(lower - y, y - upper)


def lac(prob_true: Column) -> Column:
    return 1 - prob_true


def aps(probs: Column, true: Column) -> Column:
    """Mass of the classes above the true one, and its own: probs is an array, true an index from 0."""
    own = F.get(probs, true)
    mass = F.aggregate(F.filter(probs, lambda p: p > own), F.lit(0.0), lambda acc, p: acc + p) + own
    return F.round(mass, 9)  # so that equal masses, added up in another order, are equal


PIECES = 256  # a group's scores are ranked in so many pieces at least


def quantile(scores: DataFrame, score: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """by, n, q: the finite-sample quantile of each group, exactly. Approximate quantiles cut each group into pieces, the
    pieces are counted, and only the one that holds the place is ranked, so no task sorts a whole group."""
    by = by or []
    own = scores.filter(F.col(score).isNotNull()).select(*by, F.col(score).alias("_s"))
    n = F.count(F.lit(1))
    k = F.least(F.ceil((n + 1) * F.lit(1 - alpha) - F.lit(1e-12)) + 1, n)
    cuts = F.percentile_approx("_s", [i / PIECES for i in range(1, PIECES)], 10 * PIECES)
    ranked = own.groupBy(*by).agg(n.alias("n"), k.alias("_k"), cuts.alias("_cuts"))

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, by) if by else a.crossJoin(F.broadcast(b))  # without groups b is one row

    def step(at: Column, width: Column) -> Column:
        return F.when(F.coalesce(F.get("_cuts", at + width - 1) < F.col("_s"), F.lit(False)), at + width).otherwise(at)

    # how many cuts lie below a score, by halving
    widths = F.array(*(F.lit(1 << i) for i in reversed(range(PIECES.bit_length() - 1))))
    placed = joined(own, ranked).withColumn("_p", F.aggregate(widths, F.lit(0), step))
    counts = placed.groupBy(*by, "_p").agg(n.alias("_c"), F.first("_k").alias("_k"), F.first("n").alias("n"))
    up = F.sum("_c").over(Window.partitionBy(*by).orderBy("_p") if by else Window.orderBy("_p"))  # PIECES rows a group
    piece = counts.withColumn("_up", up).filter((F.col("_up") >= F.col("_k")) & (F.col("_up") - F.col("_c") < F.col("_k")))
    piece = piece.select(*by, F.col("_p").alias("_piece"), "n", (F.col("_k") - F.col("_up") + F.col("_c")).alias("_left"))
    held = joined(placed.select(*by, "_s", "_p"), piece).filter(F.col("_p") == F.col("_piece"))
    # counts of distinct values, then their running sum: ties share a place
    values = held.groupBy(*by, "n", "_left", "_s").agg(n.alias("_c"))
    within = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_up", F.sum("_c").over(within)).filter(F.col("_up") >= F.col("_left"))
    return values.groupBy(*by, "n").agg(F.min("_s").alias("q"))


def split_intervals(calibration: DataFrame, test: DataFrame, alpha: float, by: list[str] | None = None, y: str = "y", pred: str = "pred") -> DataFrame:
    """test with lower and upper: pred -+ the quantile of absolute residuals; with `by`, one quantile for each stratum and
    the overall one for strata that calibration has not seen."""
    scored = calibration.withColumn("_s", absolute(F.col(y), F.col(pred)))
    whole = quantile(scored, "_s", alpha).select(F.col("q").alias("_q0"))
    if by:
        per = quantile(scored, "_s", alpha, by).select(*by, F.col("q").alias("_q1"))
        out = test.join(per, by, "left").crossJoin(F.broadcast(whole)).withColumn("_q", F.coalesce("_q1", "_q0"))
    else:
        out = test.crossJoin(F.broadcast(whole)).withColumn("_q", F.col("_q0"))
    return out.withColumns({"lower": F.col(pred) - F.col("_q"), "upper": F.col(pred) + F.col("_q")}).drop("_q", "_q0", "_q1")


def sets(calibration: DataFrame, test: DataFrame, alpha: float, probs: str = "probs", true: str = "label", method: str = "lac") -> DataFrame:
    """test with `members`, the sorted classes of the prediction set; a LAC set that would be empty is the best class."""
    score = lac(F.get(probs, F.col(true))) if method == "lac" else aps(F.col(probs), F.col(true))
    q = quantile(calibration.withColumn("_s", score), "_s", alpha).select(F.col("q").alias("_q"))
    out = test.crossJoin(F.broadcast(q))
    index = F.sequence(F.lit(0), F.size(probs) - 1)
    if method == "lac":
        chosen = F.filter(index, lambda i: F.get(probs, i) >= 1 - F.col("_q"))
    else:
        chosen = F.filter(index, lambda i: aps(F.col(probs), i) <= F.col("_q"))
    best = F.array((F.array_position(probs, F.array_max(probs)) - 1).cast("int"))
    return out.withColumn("members", F.when(F.size(chosen) > 0, chosen).otherwise(best)).drop("_q")


def interval_metrics(rows: DataFrame, alpha: float, by: list[str] | None = None, y: str = "y", eta: float = 50.0) -> DataFrame:
    """Coverage, widths, Winkler score, pinball losses at both ends, and the coverage-width criterion."""
    lo, hi, v = F.col("lower"), F.col("upper"), F.col(y)
    width = hi - lo
    miss = F.greatest(lo - v, F.lit(0.0)) + F.greatest(v - hi, F.lit(0.0))

    def pinball(end: Column, level: float) -> Column:
        return F.avg(F.greatest(level * (v - end), (level - 1) * (v - end)))

    out = rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(((v >= lo) & (v <= hi)).cast("double")).alias("coverage"), F.avg(width).alias("mean_width"), F.median(width).alias("median_width"),
        F.stddev_pop(width).alias("std_width"), F.avg(width + 2 / alpha * miss).alias("winkler"), pinball(lo, alpha / 2).alias("pinball_lower"), pinball(hi, 1 - alpha / 2).alias("pinball_upper"),
    )
    short = F.when(F.col("coverage") < 1 - alpha, F.exp(-eta * (F.col("coverage") - (1 - alpha)))).otherwise(0.0)
    return out.withColumn("cwc", F.col("mean_width") * (1 + short))


def set_metrics(rows: DataFrame, true: str = "label", by: list[str] | None = None) -> DataFrame:
    k = F.size("members")
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.array_contains("members", F.col(true)).cast("double")).alias("coverage"), F.avg(k).alias("mean_size"),
        F.avg((k == 0).cast("double")).alias("empty_rate"), F.avg((k == 1).cast("double")).alias("singleton_rate"),
    )


def conditional_coverage(rows: DataFrame, column: str, n_bins: int = 10, y: str = "y") -> DataFrame:
    """Coverage within percentile bins of a column."""
    edges = rows.agg(F.percentile(column, [i / n_bins for i in range(1, n_bins)]).alias("_e"))
    binned = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(column))))
    inside = (F.col(y) >= F.col("lower")) & (F.col(y) <= F.col("upper"))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"))


def worst_slab(rows: DataFrame, by: str, column: str, slab: int, y: str = "y", tie: str = "id") -> DataFrame:
    """The least coverage of `slab` neighbours in the order of a column, by group."""
    w = Window.partitionBy(by).orderBy(column, tie)
    inside = ((F.col(y) >= F.col("lower")) & (F.col(y) <= F.col("upper"))).cast("double")
    over = w.rowsBetween(-(slab - 1), 0)
    rolled = rows.withColumn("_i", inside).withColumn("_c", F.when(F.count("_i").over(over) == slab, F.avg("_i").over(over)))
    return rolled.groupBy(by).agg(F.min("_c").alias("worst_coverage"))


class _Adaptive(Fold):
    """Adaptive intervals over one series' scores in order. Scores of the window are kept, nothing else."""

    def __init__(self, key: str, fn):
        self.key, self.fn, self.parts = key, fn, []

    def rows(self, part):
        self.parts.append(part)

    def end(self):
        import pandas as pd

        part = pd.concat(self.parts)
        width, alpha = self.fn(part["score"].to_numpy(float))
        return part.assign(half_width=width, alpha_t=alpha)


def adaptive(scores: DataFrame, by: str, at: list[str], alpha: float = 0.1, step: float = 0.01, window: int = 100, dynamic: bool = False) -> DataFrame:
    """scores (column `score`) with half_width and alpha_t of ACI, or of DtACI if dynamic; infinite before 10 scores."""
    from pyspark.sql.types import StructType

    def fn(x: np.ndarray):
        return kernels.dynamically_tuned(x, alpha, window=window) if dynamic else kernels.adaptive_alphas(x, alpha, step, window)

    schema = StructType(list(scores.schema.fields)).add("half_width", "double").add("alpha_t", "double")
    return ordered_fold(scores, by, at, lambda: _Adaptive(by, fn), schema)


def value_at_risk(rows: DataFrame, by: str, alpha: float = 0.95, ret: str = "ret") -> DataFrame:
    """Loss quantile at ceil((n + 1) alpha) / n, linear, and the mean loss from there on (the greatest if under 5)."""
    losses = rows.filter(F.col(ret).isNotNull()).select(by, (-F.col(ret)).alias("loss"))
    ordered = losses.groupBy(by).agg(F.array_sort(F.collect_list("loss")).alias("_l"), F.count(F.lit(1)).alias("n"))
    at = F.least(F.ceil((F.col("n") + 1) * F.lit(alpha)) / F.col("n"), F.lit(1.0)) * (F.col("n") - 1)
    lo = F.floor(at).cast("int")
    v = F.get("_l", lo) + (at - lo) * (F.get("_l", F.least(lo + 1, (F.col("n") - 1).cast("int"))) - F.get("_l", lo))
    out = ordered.withColumn("var", v).withColumn("_tail", F.filter("_l", lambda x: x >= F.col("var")))
    es = F.when(F.size("_tail") < 5, F.array_max("_l")).otherwise(F.aggregate("_tail", F.lit(0.0), lambda acc, x: acc + x) / F.size("_tail"))
    return out.select(by, "n", "var", es.alias("es"))


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.log(y)).otherwise(0.0)


def kupiec(rows: DataFrame, by: str, alpha: float, violation: str = "violation") -> DataFrame:
    """Likelihood ratio of unconditional coverage and its p-value; (0, 1) without or with only violations."""
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(violation).cast("long")).alias("x"))
    p, n, x = F.lit(1 - alpha), F.col("n"), F.col("x")
    lr = 2 * (_xlogy(x, x / n) + _xlogy(n - x, (n - x) / n) - _xlogy(x, p) - _xlogy(n - x, 1 - p))
    out = out.withColumn("lr", F.when((x == 0) | (x == n), F.lit(0.0)).otherwise(lr))
    return out.withColumn("p", F.when((x == 0) | (x == n), F.lit(1.0)).otherwise(special.chi2_sf(F.col("lr"), 1)))


def christoffersen(rows: DataFrame, by: str, at: list[str], violation: str = "violation") -> DataFrame:
    """Likelihood ratio of independence from the counts of transitions; (0, 1) where it is degenerate."""
    w = Window.partitionBy(by).orderBy(*at)
    moved = rows.withColumns({"_b": F.col(violation).cast("int"), "_a": F.lag(F.col(violation).cast("int")).over(w)}).filter("_a IS NOT NULL")
    counts = [F.sum(((F.col("_a") == a) & (F.col("_b") == b)).cast("long")).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    out = moved.groupBy(by).agg(*counts)
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    p0, p1, p = F.try_divide(n01, n00 + n01), F.try_divide(n11, n10 + n11), (n01 + n11) / (n00 + n01 + n10 + n11)
    lr = 2 * (_xlogy(n00, 1 - p0) + _xlogy(n01, p0) + _xlogy(n10, 1 - p1) + _xlogy(n11, p1) - _xlogy(n00 + n10, 1 - p) - _xlogy(n01 + n11, p))
    bad = (n00 + n01 == 0) | (n10 + n11 == 0) | (n01 + n11 == 0) | (n00 + n10 == 0)
    out = out.withColumn("lr", F.when(bad, F.lit(0.0)).otherwise(lr))
    return out.withColumn("p", F.when(bad, F.lit(1.0)).otherwise(special.chi2_sf(F.col("lr"), 1)))


def har_features(rows: DataFrame, by: str, at: list[str], rv: str = "rv") -> DataFrame:
    """rows with the means of realised variance over 1, 5 and 22 rows before, NULL until full."""
    w = Window.partitionBy(by).orderBy(*at)
    return rows.withColumns({f"rv_{k}": F.when(F.count(rv).over(w.rowsBetween(-k, -1)) == k, F.avg(rv).over(w.rowsBetween(-k, -1))) for k in (1, 5, 22)})


def alpha_signal(lower: Column, upper: Column, mu: Column) -> dict[str, Column]:
    """width, strength, tradeable, direction of a return interval."""
    width = upper - lower
    return {"width": width, "strength": F.coalesce(F.try_divide(2 * F.abs(mu), width), F.lit(0.0)), "tradeable": (lower > 0) | (upper < 0), "direction": F.when(lower > 0, 1).when(upper < 0, -1).otherwise(0)}


def regularized_aps(probs: Column, true: Column, weight: float = 0.01, free: int = 5) -> Column:
    """APS score plus a weight for every rank beyond the free ones."""
    own = F.get(probs, true)
    rank = F.size(F.filter(probs, lambda p: p > own)) + 1
    return aps(probs, true) + weight * F.greatest(rank - free, F.lit(0))


def top_k(calibration: DataFrame, alpha: float, probs: str = "probs", true: str = "label") -> DataFrame:
    """k, coverage: the least k whose k best classes hold the true one often enough."""
    rank = F.size(F.filter(probs, lambda p: p > F.get(probs, F.col(true)))) + 1
    counts = calibration.select(rank.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(F.lit(0))  # a row for each class
    out = counts.withColumn("coverage", F.sum("c").over(w.orderBy("k")) / F.sum("c").over(w))
    return out.filter(F.col("coverage") >= 1 - alpha).orderBy("k").limit(1).select("k", "coverage")


def calibration_error(rows: DataFrame, score: str = "score", n: int = 10) -> DataFrame:
    """Mean distance between expected and found coverage over a grid of levels; rows hold the level at which each
    observation would just be covered."""
    grid = [i / (n + 1) for i in range(1, n + 1)]
    found = rows.agg(*(F.avg((F.col(score) <= g).cast("double")).alias(f"c{i}") for i, g in enumerate(grid)))
    total = F.lit(0.0)
    for i, g in enumerate(grid):
        total = total + F.abs(F.col(f"c{i}") - g)
    return found.select((total / n).alias("calibration_error"))


def weighted_quantile(scores: DataFrame, by: str, at: list[str], alpha: float = 0.1, decay: float = 0.99, most: int = 500, score: str = "score") -> DataFrame:
    """by, q, n_eff: the least score at which decayed weights of the last `most` scores add up to 1 - alpha."""
    w = Window.partitionBy(by)
    age = F.row_number().over(w.orderBy(*(F.desc(c) for c in at))) - 1
    rows = scores.withColumn("_a", age).filter(F.col("_a") < most).withColumn("_w", F.pow(F.lit(decay), F.col("_a")))
    rows = rows.withColumn("_u", F.sum("_w").over(w.orderBy(score).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_w").over(w))
    out = rows.groupBy(by).agg(F.min(F.when(F.col("_u") >= 1 - alpha - 1e-12, F.col(score))).alias("q"), (F.pow(F.sum("_w"), F.lit(2.0)) / F.sum(F.col("_w") * F.col("_w"))).alias("n_eff"))
    return out


def fold_plus(residuals: DataFrame, predictions: DataFrame, alpha: float) -> DataFrame:
    """CV+ (jackknife+ with a fold for each row): residuals (fold, r) out of fold, predictions (id, fold, pred) of each
    fold's model; lower and upper are order statistics of pred -+ r over all residuals. The residual table is counted
    and has to be small enough to meet every row, as the method asks."""
    if residuals.limit(100_001).count() > 100_000:
        raise ValueError("CV+ needs at most 100,000 residuals; use split intervals")
    both = predictions.join(F.broadcast(residuals), "fold")
    held = both.groupBy("id").agg(F.array_sort(F.collect_list(F.col("pred") - F.col("r"))).alias("_l"), F.array_sort(F.collect_list(F.col("pred") + F.col("r"))).alias("_u"))
    n = F.size("_l")
    lo = F.greatest(F.floor((n + 1) * F.lit(alpha) + 1e-9), F.lit(1)).cast("int")
    hi = F.least(F.ceil((n + 1) * F.lit(1 - alpha) - 1e-9), n).cast("int")
    return held.select("id", F.get("_l", lo - 1).alias("lower"), F.get("_u", hi - 1).alias("upper"))


def block_maxima(scores: DataFrame, by: str, at: list[str], size: int, score: str = "score") -> DataFrame:
    """by, block, score: the greatest score of each run of `size` rows; the calibration scores of block intervals."""
    place = F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*at)) - 1) / size)
    return scores.withColumn("block", place).groupBy(by, "block").agg(F.max(score).alias(score))
