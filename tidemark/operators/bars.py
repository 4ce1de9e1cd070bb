"""Bars over tick tapes (instrument, ts, seq, price, size). Every operator orders ticks by (ts, seq) within an instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark import kernels
from tidemark.fold import Fold, ordered_fold


def order():
    """Ticks of an instrument in time order."""
    return Window.partitionBy("instrument").orderBy("ts", "seq")


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Tick view of an event table: one instrument per user, price = value, size = k + 1 of the JSON properties."""
    return events.select(
        F.col("user_id").alias("instrument"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("size"),
    )


def tick_rule(ticks: DataFrame) -> DataFrame:
    """Adds `rn` (position, from 1) and `side`: sign of the last price change that is not zero, +1 before any."""
    change = F.signum(F.col("price") - F.lag("price").over(order()))
    stepped = ticks.withColumn("rn", F.row_number().over(order())).withColumn("_chg", F.nullif(change, F.lit(0.0)))
    so_far = order().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    side = F.coalesce(F.last("_chg", ignorenulls=True).over(so_far), F.lit(1.0)).cast("int")
    return stepped.withColumn("side", side).drop("_chg")


def aggregate_bars(ticks: DataFrame) -> DataFrame:
    """OHLCV, vwap and signed flow per (instrument, bar_id); needs `rn` and `side` from tick_rule()."""
    dollars = F.sum(F.col("price") * F.col("size"))
    return ticks.groupBy("instrument", "bar_id").agg(
        F.min("ts").alias("ts_open"),
        F.max("ts").alias("ts_close"),
        F.min_by("price", "rn").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "rn").alias("close"),
        F.sum("size").alias("volume"),
        F.round(dollars / F.sum("size"), 6).alias("vwap"),
        F.count(F.lit(1)).alias("tick_count"),
        F.round(dollars, 4).alias("dollar_volume"),
        F.sum("side").alias("signed_ticks"),
    )


def tick_bars(ticks: DataFrame, n: int) -> DataFrame:
    """Bars of exactly n ticks; an unfinished last bar is not returned."""
    numbered = tick_rule(ticks).withColumn("bar_id", F.expr(f"(rn - 1) div {int(n)}"))
    return aggregate_bars(numbered).filter(F.col("tick_count") == n)


INCREMENTS = ("tick", "volume", "dollar")


def increment(kind: str):
    return {"tick": F.lit(1.0), "volume": F.col("size").cast("double"), "dollar": F.col("price") * F.col("size")}[kind]


class _Closing(Fold):
    """Adds bar_id and closes; `make` builds the kernel from the first `warmup` rows (all there are, if fewer)."""

    def __init__(self, make, push, warmup: int):
        self.make, self.push, self.warmup = make, push, warmup
        self.kernel, self.bar, self.held = None, 0, []

    def _numbered(self, part):
        ids, closes = [], []
        for side, weight in zip(part["side"].tolist(), part["_w"].tolist(), strict=True):
            closed = self.push(self.kernel, side, weight)
            ids.append(self.bar)
            closes.append(closed)
            self.bar += closed
        return part.assign(bar_id=ids, closes=closes)

    def rows(self, part):
        import pandas as pd

        if self.kernel is None:
            self.held.append(part)
            if sum(map(len, self.held)) < self.warmup:
                return None
            part, self.held = pd.concat(self.held), []
            self.kernel = self.make(part["side"].to_numpy(float), part["_w"].to_numpy(float))
        return self._numbered(part)

    def end(self):
        import pandas as pd

        if not self.held:
            return None
        part = pd.concat(self.held)
        self.kernel = self.make(part["side"].to_numpy(float), part["_w"].to_numpy(float))
        return self._numbered(part)


def _closed(ticks: DataFrame, kind: str, make, push, warmup: int) -> DataFrame:
    rows = tick_rule(ticks).withColumn("_w", increment(kind))
    schema = StructType(list(rows.schema.fields)).add("bar_id", "long").add("closes", "boolean")
    numbered = ordered_fold(rows, "instrument", ["ts", "seq"], lambda: _Closing(make, push, warmup), schema)
    done = numbered.groupBy("instrument", "bar_id").agg(F.max("closes").alias("done")).filter("done").drop("done")
    return aggregate_bars(numbered.join(done, ["instrument", "bar_id"], "left_semi"))


def threshold_bars(ticks: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Bars that close where ticks, volume or dollars since the last close reach the threshold."""
    return _closed(ticks, kind, lambda s, w: kernels.ThresholdBars(threshold), lambda k, side, w: k.push(w), 1)


def imbalance_bars(ticks: DataFrame, kind: str, config: kernels.ImbalanceConfig) -> DataFrame:
    def make(sides, weights):
        first = config.exp_imbalance
        if first is None:
            first = float((sides * weights)[: config.warmup].mean())
        return kernels.ImbalanceBars(config, first)

    return _closed(ticks, kind, make, lambda k, side, w: k.push(side * w), config.warmup if config.exp_imbalance is None else 1)


def runs_bars(ticks: DataFrame, kind: str, config: kernels.RunsConfig) -> DataFrame:
    def make(sides, weights):
        return kernels.RunsBars(config, *kernels.runs_start(config, sides, weights))

    return _closed(ticks, kind, make, lambda k, side, w: k.push(side, w), config.warmup)


def time_bars(ticks: DataFrame, length: str) -> DataFrame:
    """Bars of fixed spans of time, in UTC."""
    rows = tick_rule(ticks).withColumn("bar_id", F.window("ts", length)["start"])
    return aggregate_bars(rows)


def session_bars(ticks: DataFrame, gap_seconds: int) -> DataFrame:
    """Bars that end where no tick follows for longer than the gap."""
    far = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(order()).cast("timestamp"))) > gap_seconds * 1_000_000
    rows = tick_rule(ticks).withColumn("_new", F.coalesce(far, F.lit(True)).cast("int"))
    rows = rows.withColumn("bar_id", F.sum("_new").over(order().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return aggregate_bars(rows)


def flow_ratios(ticks: DataFrame, n: int) -> DataFrame:
    """Signed over unsigned flow of each complete bar of n ticks: volume, dollars and ticks; 0 without flow."""
    rows = tick_rule(ticks).withColumns({"bar_id": F.expr(f"(rn - 1) div {int(n)}"), "_d": F.col("price") * F.col("size")})
    out = rows.groupBy("instrument", "bar_id").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.col("side") * F.col("size")).alias("sv"), F.sum("size").alias("v"),
        F.sum(F.col("side") * F.col("_d")).alias("sd"), F.sum("_d").alias("d"), F.sum("side").alias("st"),
    ).filter(F.col("k") == n)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.select("instrument", "bar_id", ratio("sv", "v").alias("volume_ratio"), ratio("sd", "d").alias("dollar_ratio"), ratio("st", "k").alias("tick_ratio"))


def bar_statistics(ticks: DataFrame, n: int, column: str = "size") -> DataFrame:
    """Mean, last, deviation (0 for one value), least, greatest and change of a column in each complete bar of n ticks."""
    rows = tick_rule(ticks).withColumn("bar_id", F.expr(f"(rn - 1) div {int(n)}"))
    out = rows.groupBy("instrument", "bar_id").agg(
        F.count(F.lit(1)).alias("k"), F.avg(column).alias("mean"), F.max_by(column, "rn").alias("last"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std"),
        F.min(column).alias("least"), F.max(column).alias("greatest"), (F.max_by(column, "rn") - F.min_by(column, "rn")).alias("change"),
    )
    return out.filter(F.col("k") == n).drop("k")
