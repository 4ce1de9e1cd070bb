"""Event sampling, labels, sample weights and leakage-aware splits over series (instrument, pos, price).

pos is the row's place within its instrument, from 0; number() adds it. Spans [t0, t1] are positions, both inclusive.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import kernels
from tidemark.fold import PerRow, ordered_fold, with_column


def number(rows: DataFrame, at: list[str], by: str = "instrument") -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*at)) - 1)


def _w():
    return Window.partitionBy("instrument").orderBy("pos")


def cusum_events(rows: DataFrame, threshold: float, skip: bool = True) -> DataFrame:
    """rows with `event`: whether the symmetric CUSUM of log returns fires there. skip: see kernels.Cusum."""
    make = lambda: PerRow(kernels.Cusum(threshold, skip).push, ["price"], "event")
    return ordered_fold(rows, "instrument", ["pos"], make, with_column(rows, "event", "boolean"))


def _negative_for_nan(push):
    """pandas has no NaN beside missing values."""
    return lambda price: -1.0 if (vol := push(price)) is not None and vol != vol else vol


def ewm_volatility(rows: DataFrame, span: int = 100, skip: bool = True) -> DataFrame:
    """rows with `vol`: EWM deviation of simple returns; missing for the first two rows. skip: see kernels.EwmVolatility;
    without it vol is NaN where infinite returns leave no value."""
    make = lambda: PerRow(_negative_for_nan(kernels.EwmVolatility(span, skip).push), ["price"], "vol")
    out = ordered_fold(rows, "instrument", ["pos"], make, with_column(rows, "vol", "double"))
    return out.withColumn("vol", F.when(F.col("vol") < 0, F.lit(None if skip else float("nan")).cast("double")).when(~F.isnan("vol"), F.col("vol")))


def _ieee_divide(a, b):
    """a / b where a division by 0 gives an infinite value or NaN instead of an error."""
    sign = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when((b == 0) & a.isNotNull(), sign).otherwise(F.try_divide(a, b))


def barrier_events(rows: DataFrame, events: DataFrame, horizon: int, min_ret: float = 0.0, target: str = "target") -> DataFrame:
    """instrument, pos, target, t1 of the events (instrument, pos): the last target at or before each, above min_ret, and
    the vertical barrier `horizon` rows on, or the last row."""
    so_far = _w().rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("pos").over(Window.partitionBy("instrument"))
    filled = rows.select("instrument", "pos", F.last(target, ignorenulls=True).over(so_far).alias("target"), F.least(F.col("pos") + horizon, last).alias("t1"))
    return filled.join(events.select("instrument", "pos"), ["instrument", "pos"]).filter(F.col("target") > min_ret)


def triple_barrier(rows: DataFrame, events: DataFrame, horizon: int, pt: float = 1.0, sl: float = 1.0, ieee: bool = False) -> DataFrame:
    """events (instrument, pos, target, t1, optional side) with exit, label, ret and bin: the first touch after the event,
    the upper barrier tested first, 0 at t1. A multiple of 0 or less switches its barrier off; ret is null where the event's
    price is 0, or by `ieee` infinite or NaN."""
    ahead = F.collect_list(F.struct("pos", "price")).over(_w().rowsBetween(1, horizon))
    paths = rows.select("instrument", "pos", F.col("price").alias("p0"), ahead.alias("path"))
    side = F.col("side") if "side" in events.columns else F.lit(1)
    e = events.withColumn("_side", side.cast("double")).join(paths, ["instrument", "pos"])
    up_by, down_by = F.when(F.col("_side") > 0, F.lit(pt)).otherwise(F.lit(sl)), F.when(F.col("_side") > 0, F.lit(sl)).otherwise(F.lit(pt))
    inf = F.lit(float("inf"))
    e = e.withColumns({
        "_up": F.when(up_by > 0, F.col("p0") * (1 + up_by * F.col("target"))).otherwise(inf),
        "_dn": F.when(down_by > 0, F.col("p0") * (1 - down_by * F.col("target"))).otherwise(-inf),
    })
    hits = F.filter("path", lambda x: (x["pos"] <= F.col("t1")) & ((x["price"] >= F.col("_up")) | (x["price"] <= F.col("_dn"))))
    first = F.get(hits, F.lit(0))
    e = e.withColumns({"_hit": first, "_end": F.when(F.size("path") > 0, F.get(F.filter("path", lambda x: x["pos"] == F.col("t1")), F.lit(0)))})
    label = F.when(F.col("_hit").isNull(), 0).when(F.col("_hit.price") >= F.col("_up"), 1).otherwise(-1)
    price = F.coalesce("_hit.price", "_end.price", "p0")
    divide = _ieee_divide if ieee else F.try_divide
    out = e.withColumns({"exit": F.coalesce("_hit.pos", "t1"), "label": label, "ret": (divide(price, F.col("p0")) - 1) * F.col("_side")})
    return out.withColumn("bin", (F.col("label") * F.signum("_side")).cast("int")).drop("path", "p0", "_side", "_up", "_dn", "_hit", "_end")


def concurrency(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """instrument, pos, c: how many spans (instrument, t0, t1) cover each row, from a running sum of starts and ends."""
    starts = spans.select("instrument", F.col("t0").alias("pos"), F.lit(1).alias("d"))
    ends = spans.select("instrument", (F.col("t1") + 1).alias("pos"), F.lit(-1).alias("d"))
    change = starts.unionByName(ends).groupBy("instrument", "pos").agg(F.sum("d").alias("d"))
    both = rows.select("instrument", "pos").join(change, ["instrument", "pos"], "left")
    return both.select("instrument", "pos", F.sum(F.coalesce("d", F.lit(0))).over(_w().rowsBetween(Window.unboundedPreceding, 0)).alias("c"))


def _span_sums(spans: DataFrame, running: DataFrame, totals: tuple[str, ...] = ("s",)) -> DataFrame:
    """spans with `sum` of each: the running totals (instrument, pos, s, ...) at t1 less those before t0. With one total
    the name is `sum`, else sum_<total>."""
    at_end = running.select("instrument", F.col("pos").alias("t1"), *(F.col(s).alias(f"_e{s}") for s in totals))
    before = running.select("instrument", (F.col("pos") + 1).alias("t0"), *(F.col(s).alias(f"_b{s}") for s in totals))
    both = spans.join(at_end, ["instrument", "t1"]).join(before, ["instrument", "t0"], "left")
    made = {"sum" if len(totals) == 1 else f"sum_{s}": F.col(f"_e{s}") - F.coalesce(f"_b{s}", F.lit(0.0)) for s in totals}
    return both.withColumns(made).drop(*(f"_{k}{s}" for s in totals for k in "eb"))


def uniqueness(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with the mean of 1 / concurrency over them."""
    share = F.when(F.col("c") > 0, 1 / F.col("c")).otherwise(0.0)
    running = concurrency(rows, spans).withColumn("s", F.sum(share).over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    return _span_sums(spans, running).select("instrument", "t0", "t1", (F.col("sum") / (F.col("t1") - F.col("t0") + 1)).alias("uniqueness"))


def sample_weights(rows: DataFrame, spans: DataFrame, normalize: bool = True, ieee: bool = False) -> DataFrame:
    """spans with |sum of log return / concurrency|, scaled to add up to the number of spans of the instrument. A return
    from or to a price of 0 counts as none; or, by `ieee`, it is infinite, and so are or without a value (NaN) the sums and
    weights it goes into."""
    divide = _ieee_divide if ieee else F.try_divide
    ratio = divide(F.col("price"), F.lag("price").over(_w()))
    logret = F.log(ratio)  # null for 0 and below
    if ieee:
        logret = F.when(ratio == 0, F.lit(float("-inf"))).when((ratio < 0) | F.isnan(ratio), F.lit(float("nan"))).otherwise(logret)
    joined = rows.withColumn("_r", F.coalesce(logret, F.lit(0.0))).join(concurrency(rows, spans), ["instrument", "pos"])
    r = F.col("_r")
    # running totals of finite values alone, and of how many are not finite
    kinds = {"s": F.when((F.col("c") > 0) & ~F.isnan(r) & (F.abs(r) < float("inf")), r / F.col("c")).otherwise(0.0)}
    if ieee:
        kinds |= {k: F.when(is_it, 1.0).otherwise(0.0) for k, is_it in (("up", r == float("inf")), ("down", r == float("-inf")), ("none", F.isnan(r)))}
    so_far = _w().rowsBetween(Window.unboundedPreceding, 0)
    running = joined.withColumns({k: F.sum(x).over(so_far) for k, x in kinds.items()})
    sums = _span_sums(spans, running, tuple(kinds))
    total = F.col("sum")
    if ieee:
        lost = (F.col("sum_none") > 0) | ((F.col("sum_up") > 0) & (F.col("sum_down") > 0))
        total = F.when(lost, float("nan")).when((F.col("sum_up") > 0) | (F.col("sum_down") > 0), float("inf")).otherwise(F.col("sum_s"))
    out = sums.select("instrument", "t0", "t1", F.abs(total).alias("weight"))
    if normalize:
        per = Window.partitionBy("instrument")
        out = out.withColumn("weight", divide(F.col("weight") * F.count(F.lit(1)).over(per), F.sum("weight").over(per)))
    return out


def _groups(spans: DataFrame, k: int) -> DataFrame:
    """spans with _i (place by t0), _n and _g: contiguous groups whose sizes differ by one at most, larger ones first."""
    w = Window.partitionBy("instrument")
    rows = spans.withColumns({"_i": F.row_number().over(w.orderBy("t0", "t1")) - 1, "_n": F.count(F.lit(1)).over(w)})
    big, size = F.col("_n") % k, F.floor(F.col("_n") / k)
    return rows.withColumn("_g", F.when(F.col("_i") < big * (size + 1), F.floor(F.col("_i") / (size + 1))).otherwise(big + F.floor((F.col("_i") - big * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int"))


def _roles(rows: DataFrame, tests: DataFrame, embargo: float) -> DataFrame:
    """rows x splits with role test, purged, embargo or train; tests: split, _g (a small table)."""
    size = F.bround(embargo * F.col("_n")).cast("int")
    segments = rows.join(F.broadcast(tests), "_g").groupBy("instrument", "split", "_g").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"), F.max("_i").alias("last"), F.first(size).alias("e"))
    # the embargo reaches to the t0 of the e-th row after the block, ties included
    limits = segments.join(rows.select("instrument", F.col("_i").alias("last_e"), F.col("t0").alias("reach")), (segments.instrument == rows.instrument) & (F.col("last_e") == F.least(F.col("last") + F.col("e"), F.lit(1 << 30))), "left").select(segments["instrument"], "split", F.col("_g").alias("tg"), "lo", "hi", "last", "e", "reach")
    end = rows.groupBy("instrument").agg(F.max("t0").alias("_max"))
    limits = limits.join(end, "instrument").withColumn("reach", F.coalesce("reach", "_max")).drop("_max")
    held = limits.groupBy("instrument").agg(F.collect_list(F.struct("split", "tg", "lo", "hi", "last", "e", "reach")).alias("_seg"))
    every = rows.join(held, "instrument").withColumn("split", F.explode(F.array_distinct(F.transform("_seg", lambda s: s["split"]))))
    own = F.filter("_seg", lambda s: s["split"] == F.col("split"))
    is_test = F.exists(own, lambda s: s["tg"] == F.col("_g"))
    purged = F.exists(own, lambda s: (F.col("t0") <= s["hi"]) & (F.col("t1") >= s["lo"]))
    embargoed = F.exists(own, lambda s: (s["e"] > 0) & (F.col("_i") > s["last"]) & (F.col("t0") <= s["reach"]))
    role = F.when(is_test, "test").when(purged, "purged").when(embargoed, "embargo").otherwise("train")
    return every.select("instrument", "split", "t0", "t1", role.alias("role"))


def purged_folds(spans: DataFrame, n_splits: int = 5, embargo: float = 0.0) -> DataFrame:
    """instrument, split, t0, t1, role for n_splits contiguous test folds."""
    tests = spans.sparkSession.createDataFrame([(g, g) for g in range(n_splits)], "split int, _g int")
    return _roles(_groups(spans, n_splits), tests, embargo)


def combinatorial_folds(spans: DataFrame, n_groups: int = 6, n_test: int = 2, embargo: float = 0.0) -> DataFrame:
    """The same for every way of choosing n_test of n_groups groups as the test set."""
    ways = [(i, g) for i, way in enumerate(combinations(range(n_groups), n_test)) for g in way]
    return _roles(_groups(spans, n_groups), spans.sparkSession.createDataFrame(ways, "split int, _g int"), embargo)


def drop_overlapping(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of train (instrument, t0, t1) whose span meets none of test's: of the test spans that begin by a row's t1, the
    latest end is before its t0. One sort, no pairs."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in train.schema.fields if f.name != "instrument"]
    other = test.select("instrument", *none, F.col("t0").alias("_at"), F.lit(0).alias("_own"), F.col("t1").alias("_hi"))
    both = train.withColumns({"_at": F.col("t1"), "_own": F.lit(1), "_hi": F.lit(None).cast(test.schema["t1"].dataType)}).unionByName(other)
    so_far = Window.partitionBy("instrument").orderBy("_at", "_own").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_met", F.max("_hi").over(so_far)).filter("_own = 1 AND coalesce(_met < t0, true)")
    return met.select(*train.columns)


def block_bootstrap(rows: DataFrame, block: int, replicates: int, seed: int = 0, circular: bool = True) -> DataFrame:
    """replicate, i, pos, and the row's values: blocks of consecutive rows that begin where a seeded hash says."""
    n = rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))
    plan = n.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))))
    room = F.col("n") if circular else F.greatest(F.col("n") - block + 1, F.lit(1))
    plan = plan.withColumn("start", F.pmod(F.xxhash64("instrument", "replicate", "b", F.lit(seed)), room))
    plan = plan.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumns({"i": F.col("b") * block + F.col("o"), "pos": ((F.col("start") + F.col("o")) % F.col("n")).cast("int")})
    # the planner takes the exploded plan for as small as the counts it is made of, and would broadcast it
    return plan.filter(F.col("i") < F.col("n")).select("instrument", "replicate", "i", "pos").join(rows.hint("merge"), ["instrument", "pos"])


def sequential_bootstrap(spans: DataFrame, seed: int = 0) -> DataFrame:
    """instrument, draw, t0, t1: as many draws as spans, each in proportion to average uniqueness given those before."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t0", "t1"])
        starts, ends = pdf["t0"].to_numpy(), pdf["t1"].to_numpy()
        u = np.random.default_rng([seed, abs(hash(key[0])) % (1 << 32)]).random(len(pdf))
        out = kernels.sequential_bootstrap(starts, ends, int(ends.max()) + 1, u)
        return pd.DataFrame({"instrument": key[0], "draw": np.arange(len(out)), "t0": starts[out], "t1": ends[out]})

    return spans.select("instrument", "t0", "t1").groupBy("instrument").applyInPandas(run, f"instrument {spans.schema['instrument'].dataType.simpleString()}, draw long, t0 long, t1 long")


def effective_sample_size(weights: DataFrame, weight: str = "weight", by: str = "instrument") -> DataFrame:
    """(sum w)^2 / sum w^2, and the entropy of the shares over its greatest value."""
    w = F.col(weight)
    p = w / F.sum(w).over(Window.partitionBy(by))
    rows = weights.filter(w > 0).withColumn("_p", p)
    return rows.groupBy(by).agg((F.pow(F.sum(w), F.lit(2.0)) / F.sum(w * w)).alias("ess"), F.try_divide(-F.sum(F.col("_p") * F.log("_p")), F.log(F.count(F.lit(1)).cast("double"))).alias("entropy"))
