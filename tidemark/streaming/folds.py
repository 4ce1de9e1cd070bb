"""Streaming twins of the sequential kernels: the same kernels, with their state kept by transformWithState.

Rows of a key are taken in the order of (ts, seq) within a micro-batch; a source that delivers later rows in later
batches gives the batch result. State is one pickled kernel for each key, in RocksDB.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark import kernels

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BARS = (
    "instrument long, bar_id long, ts_open timestamp, ts_close timestamp, open double, high double, low double, close double, "
    "volume double, tick_count long, dollar_volume double"
)


class Bar:
    """OHLCV of the ticks since the last close."""

    def __init__(self, kernel):
        self.kernel, self.bar, self.ticks = kernel, 0, []

    def push(self, ts, price: float, size: float, weight: float):
        self.ticks.append((ts, price, size))
        if not self.kernel.push(weight):
            return None
        return self.closed(ts, price)

    def closed(self, ts, price: float) -> tuple:
        px = [t[1] for t in self.ticks]
        row = (self.bar, self.ticks[0][0], ts, px[0], max(px), min(px), price, sum(t[2] for t in self.ticks), len(px), sum(t[1] * t[2] for t in self.ticks))
        self.bar, self.ticks = self.bar + 1, []
        return row


class _Kernel(StatefulProcessor):
    """Keeps a kernel per key; rows(kernel, key, sorted batch) -> DataFrame."""

    def __init__(self, make: Callable[[], object], rows: Callable):
        self.make, self.rows = make, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("kernel", "state binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kernel = pickle.loads(self.state.get()[0]) if self.state.exists() else self.make()
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out = self.rows(kernel, key[0], batch)
        self.state.update((pickle.dumps(kernel),))
        if len(out):
            yield out

    def close(self) -> None:
        pass


def _bars(kind: str):
    def rows(kernel: Bar, key, batch: pd.DataFrame) -> pd.DataFrame:
        weight = {"tick": pd.Series(1.0, batch.index), "volume": batch["size"], "dollar": batch["price"] * batch["size"]}[kind]
        made = [kernel.push(*x) for x in zip(batch["ts"], batch["price"].tolist(), batch["size"].tolist(), weight.tolist(), strict=True)]
        names = [c.split()[0] for c in BARS.split(", ")]
        return pd.DataFrame([(key, *r) for r in made if r is not None], columns=names)

    return rows


def bars(ticks: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Threshold bars of a stream of ticks (instrument, ts, seq, price, size), as they close."""
    make = lambda: Bar(kernels.ThresholdBars(threshold))
    return ticks.groupBy("instrument").transformWithStateInPandas(_Kernel(make, _bars(kind)), BARS, "Append", "None")


class SignedBar(Bar):
    """A bar whose kernel reads the tick rule's side: the sign of the last price change, 1 before the first."""

    def __init__(self, kernel, runs: bool):
        super().__init__(kernel)
        self.runs, self.last, self.side = runs, None, 1.0

    def push(self, ts, price: float, size: float, weight: float):
        if self.last is not None and price != self.last:
            self.side = 1.0 if price > self.last else -1.0
        self.last = price
        self.ticks.append((ts, price, size))
        closed = self.kernel.push(self.side, weight) if self.runs else self.kernel.push(self.side * weight)
        return self.closed(ts, price) if closed else None


def imbalance_bars(ticks: DataFrame, kind: str, config: kernels.ImbalanceConfig) -> DataFrame:
    """Imbalance bars of a stream. The first expectation has to be given: a warm-up's mean would look ahead."""
    if config.exp_imbalance is None:
        raise ValueError("a stream needs exp_imbalance")
    make = lambda: SignedBar(kernels.ImbalanceBars(config, config.exp_imbalance), runs=False)
    return ticks.groupBy("instrument").transformWithStateInPandas(_Kernel(make, _bars(kind)), BARS, "Append", "None")


def runs_bars(ticks: DataFrame, kind: str, config: kernels.RunsConfig) -> DataFrame:
    """Runs bars of a stream; the share of buys and the weights of both sides have to be given."""
    first = (config.exp_buy, config.exp_w_buy, config.exp_w_sell)
    if None in first:
        raise ValueError("a stream needs exp_buy, exp_w_buy and exp_w_sell")
    make = lambda: SignedBar(kernels.RunsBars(config, *first), runs=True)
    return ticks.groupBy("instrument").transformWithStateInPandas(_Kernel(make, _bars(kind)), BARS, "Append", "None")


class RollingFlow:
    """Sums of the last values over several widths, and how far the last lies from the mean of the widest in deviations; 0
    until a width is full or where it doesn't vary."""

    def __init__(self, widths: tuple[int, ...] = (5, 10, 20)):
        self.widths, self.held = widths, deque(maxlen=max(widths))

    def push(self, value: float) -> tuple[float, ...]:
        self.held.append(value)
        x = np.fromiter(self.held, float)
        sums = [float(x[-w:].sum()) if len(x) >= w else 0.0 for w in self.widths]
        sd = float(x.std(ddof=1)) if len(x) == self.held.maxlen and len(x) > 1 else 0.0
        return (*sums, float((x[-1] - x.mean()) / sd) if sd > 1e-12 else 0.0)


def rolling_flow(flow: DataFrame, widths: tuple[int, ...] = (5, 10, 20), value: str = "flow") -> DataFrame:
    """instrument, ts, seq, sum_<width> of each width, z of a stream (instrument, ts, seq, value)."""
    names = [f"sum_{w}" for w in widths] + ["z"]

    def rows(kernel, key, batch):
        made = pd.DataFrame([kernel.push(x) for x in batch[value].tolist()], columns=names)
        return pd.DataFrame({"instrument": key, "ts": batch["ts"].to_numpy(), "seq": batch["seq"].to_numpy(), **made})

    schema = "instrument long, ts timestamp, seq long, " + ", ".join(f"{n} double" for n in names)
    return flow.groupBy("instrument").transformWithStateInPandas(_Kernel(lambda: RollingFlow(widths), rows), schema, "Append", "None")


class Hysteresis:
    """A position of -1, 0 or 1 that is entered above one threshold, left below a lower one, and turned beyond a third."""

    def __init__(self, entry: float, exit_: float, flip: float):
        self.entry, self.exit, self.flip, self.position = entry, exit_, flip, 0

    def push(self, score: float) -> int:
        side = 1 if score > 0 else -1
        if self.position == 0:
            self.position = side if abs(score) >= self.entry else 0
        elif side == self.position:
            self.position = 0 if abs(score) < self.exit else self.position
        else:
            self.position = side if abs(score) >= self.flip else 0 if abs(score) >= self.exit else self.position
        return self.position


def hysteresis(scores: DataFrame, entry: float, exit_: float, flip: float, score: str = "score") -> DataFrame:
    """instrument, ts, seq, position of a stream of scores."""

    def rows(kernel, key, batch):
        return pd.DataFrame({"instrument": key, "ts": batch["ts"].to_numpy(), "seq": batch["seq"].to_numpy(), "position": [kernel.push(x) for x in batch[score].tolist()]})

    return scores.groupBy("instrument").transformWithStateInPandas(_Kernel(lambda: Hysteresis(entry, exit_, flip), rows), "instrument long, ts timestamp, seq long, position int", "Append", "None")


class InFlight:
    """Orders that are on their way count against a name's cap, so a burst can't break it together; once the kill switch is
    set, nothing more goes out."""

    def __init__(self, cap: float):
        self.cap, self.pending, self.held, self.killed = cap, {}, 0.0, False

    def push(self, kind: str, order: object, qty: float) -> str:
        if kind == "kill":
            self.killed = True
            return "killed"
        if kind in ("fill", "cancel"):
            done = self.pending.pop(order, None)
            if done is None:
                return "repeated"  # a fill or cancel that was seen already changes nothing
            self.held += done if kind == "fill" else 0.0
            return kind
        if self.killed:
            return "killed"
        if order in self.pending:
            return "repeated"
        if abs(self.held + sum(self.pending.values()) + qty) > self.cap:
            return "rejected"
        self.pending[order] = qty
        return "sent"


def in_flight(events: DataFrame, cap: float) -> DataFrame:
    """instrument, ts, seq, order_id, result of a stream of events (instrument, ts, seq, kind, order_id, qty)."""

    def rows(kernel, key, batch):
        made = [kernel.push(*x) for x in zip(batch["kind"].tolist(), batch["order_id"].tolist(), batch["qty"].tolist(), strict=True)]
        return pd.DataFrame({"instrument": key, "ts": batch["ts"].to_numpy(), "seq": batch["seq"].to_numpy(), "order_id": batch["order_id"].to_numpy(), "result": made})

    schema = "instrument long, ts timestamp, seq long, order_id long, result string"
    return events.groupBy("instrument").transformWithStateInPandas(_Kernel(lambda: InFlight(cap), rows), schema, "Append", "None")


class Drift:
    """Tells of a difference between two running quantities once it has lasted `debounce` rows beyond the tolerance."""

    def __init__(self, tolerance: float, debounce: int):
        self.tolerance, self.debounce, self.internal, self.broker, self.since = tolerance, debounce, 0.0, 0.0, 0

    def push(self, source: str, qty: float) -> bool:
        setattr(self, "internal" if source == "internal" else "broker", qty)
        self.since = self.since + 1 if abs(self.internal - self.broker) > self.tolerance else 0
        return self.since == self.debounce


def position_drifts(positions: DataFrame, tolerance: float = 0.0, debounce: int = 3) -> DataFrame:
    """instrument, ts, seq, internal, broker where a stream of position reports (instrument, ts, seq, source, qty) has
    disagreed for `debounce` reports."""

    def rows(kernel, key, batch):
        out = []
        for ts, seq, source, qty in zip(batch["ts"], batch["seq"].tolist(), batch["source"].tolist(), batch["qty"].tolist(), strict=True):
            if kernel.push(source, qty):
                out.append((key, ts, seq, kernel.internal, kernel.broker))
        return pd.DataFrame(out, columns=["instrument", "ts", "seq", "internal", "broker"])

    schema = "instrument long, ts timestamp, seq long, internal double, broker double"
    return positions.groupBy("instrument").transformWithStateInPandas(_Kernel(lambda: Drift(tolerance, debounce), rows), schema, "Append", "None")


def metrics(query) -> dict[str, int]:
    """Rows read, batches run and rows of state of a streaming query so far."""
    progress = query.recentProgress
    state = progress[-1].get("stateOperators") or [] if progress else []
    return {"events": sum(p["numInputRows"] for p in progress), "batches": len(progress), "state_rows": sum(s["numRowsTotal"] for s in state)}


def stop(query, mode: str = "drain") -> None:
    """drain: what has arrived is worked off first; halt: at once. State and offsets are in the checkpoint either way."""
    if mode not in ("drain", "halt"):
        raise ValueError("mode is drain or halt")
    if mode == "drain":
        query.processAllAvailable()
    query.stop()


def cusum(ticks: DataFrame, threshold: float, skip: bool = True) -> DataFrame:
    """Ticks at which the symmetric CUSUM of log returns fires. skip: see kernels.Cusum."""

    def rows(kernel, key, batch):
        return batch[[kernel.push(p) for p in batch["price"].tolist()]][["instrument", "ts", "seq", "price"]]

    schema = "instrument long, ts timestamp, seq long, price double"
    return ticks.groupBy("instrument").transformWithStateInPandas(_Kernel(lambda: kernels.Cusum(threshold, skip), rows), schema, "Append", "None")


def ewm_volatility(ticks: DataFrame, span: int) -> DataFrame:
    """Ticks with the exponentially weighted volatility so far."""

    def rows(kernel, key, batch):
        return batch.assign(vol=[kernel.push(p) for p in batch["price"].tolist()])[["instrument", "ts", "seq", "vol"]]

    schema = "instrument long, ts timestamp, seq long, vol double"
    return ticks.groupBy("instrument").transformWithStateInPandas(_Kernel(lambda: kernels.EwmVolatility(span), rows), schema, "Append", "None")


def windowed(ticks: DataFrame, length: str, late: str) -> DataFrame:
    """Count, volume and dollars of windows of event time, once the watermark has passed them."""
    from pyspark.sql import functions as F

    w = ticks.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"))
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("dollars"))
    return out.select(F.col("w.start").alias("start"), "n", "volume", "dollars")


def deduplicated(fills: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return fills.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs the stream over what its source holds now, into Parquet files in the folder, and returns them."""
    spark: SparkSession = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    out = f"{folder}/{name}"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
