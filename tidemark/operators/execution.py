"""Execution: rebalancing, pre-trade checks, simulated fills, state reducers, reconciliation and the audit chain."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark import kernels
from tidemark.fold import Fold, ordered_fold

GENESIS = "genesis"
#: legal transitions of an order's status
TRANSITIONS = {
    "NEW": ("SUBMITTED", "REJECTED", "CANCELLED"),
    "SUBMITTED": ("PARTIAL", "FILLED", "CANCELLED", "REJECTED"),
    "PARTIAL": ("PARTIAL", "FILLED", "CANCELLED"),
    "FILLED": (),
    "CANCELLED": (),
    "REJECTED": (),
}


class _Positions(Fold):
    """Average-cost state of one ticker, carried from batch to batch."""

    def __init__(self):
        self.state = (0.0, 0.0, 0.0, 0.0)

    def rows(self, part):
        pos, cost, pnl, cash = self.state
        q, p, c = (part[x].to_numpy(float) for x in ("qty", "price", "commission"))
        if pos:  # the position held so far is one fill at its cost
            out = np.array(kernels.average_cost(np.concatenate(([pos], q)), np.concatenate(([cost], p)), np.concatenate(([0.0], c))))[1:]
            out[:, 3] += pos * cost
        else:
            out = np.array(kernels.average_cost(q, p, c))
        out[:, 2] += pnl
        out[:, 3] += cash
        self.state = tuple(out[-1])
        return part.assign(position=out[:, 0], avg_cost=out[:, 1], realized=out[:, 2], cash=out[:, 3])


def average_cost(fills: DataFrame, by: str = "ticker", at: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """fills (qty signed, price, commission) with position, avg_cost, realized and cash after each: adding averages the
    cost, reducing realises against it, and crossing zero starts at the fill's price."""
    schema = StructType(list(fills.schema.fields))
    for c in ("position", "avg_cost", "realized", "cash"):
        schema = schema.add(c, "double")
    return ordered_fold(fills, by, list(at), _Positions, schema)


def _money(amount: Column) -> Column:
    """A sum that doesn't depend on the order of rows: amounts to eight decimals, added up exactly."""
    return F.sum(amount.cast("decimal(28,8)")).cast("double")


def shortfall(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """orders (order_id, qty, decision, final) with their average fill price, price impact, commission, missed gain, total."""
    f = fills.groupBy("order_id").agg(F.sum("qty").alias("filled"), _money(F.col("qty") * F.col("price")).alias("_v"), _money(F.col("commission")).alias("commission"))
    out = orders.join(f, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    out = out.withColumns({
        "vwap": F.try_divide("_v", "filled"),
        "impact": F.coalesce(F.col("_v") - F.col("filled") * F.col("decision"), F.lit(0.0)),
        "commission": F.coalesce("commission", F.lit(0.0)),
        "missed": (F.col("qty") - F.col("filled")) * (F.col("final") - F.col("decision")),
    })
    out = out.withColumn("total", F.col("impact") + F.col("commission") + F.col("missed")).drop("_v")
    return out.withColumn("total_bps", F.try_divide(F.col("total") * 1e4, F.abs(F.col("qty") * F.col("decision"))))


def reconcile(internal: DataFrame, broker: DataFrame, tol_cost: float = 0.01, by: str = "ticker") -> DataFrame:
    """Drifts between two position tables (qty, avg_cost): unknown on a side, other quantity, or other cost."""
    a = internal.select(F.col(by), F.col("qty").alias("internal_qty"), F.col("avg_cost").alias("internal_cost"))
    b = broker.select(F.col(by), F.col("qty").alias("broker_qty"), F.col("avg_cost").alias("broker_cost"))
    kind = F.when(F.col("internal_qty").isNull(), "UNKNOWN_TO_INTERNAL").when(F.col("broker_qty").isNull(), "UNKNOWN_TO_BROKER").when(
        F.col("internal_qty") != F.col("broker_qty"), "QUANTITY").when(F.abs(F.col("internal_cost") - F.col("broker_cost")) > tol_cost, "COST")
    return a.join(b, by, "full").withColumn("kind", kind).filter("kind IS NOT NULL")


def linear_cost(qty: Column, price: Column, bps: float = 1.0, per_share: float = 0.005, least: float = 1.0) -> tuple[Column, Column]:
    """(fill price, commission): the price moved against the order, commission by share with a minimum."""
    return price * (1 + F.signum(qty) * bps / 1e4), F.greatest(F.abs(qty) * per_share, F.lit(least))


def paper_fills(orders: DataFrame, bps: float = 1.0) -> DataFrame:
    """orders (type, qty, ref, limit, stop) with filled and fill_price against one reference price."""
    buy, ref = F.col("qty") > 0, F.col("ref")
    limit_ok = F.when(buy, ref <= F.col("limit")).otherwise(ref >= F.col("limit"))
    stop_ok = F.when(buy, ref >= F.col("stop")).otherwise(ref <= F.col("stop"))
    ok = F.when(F.col("type").isin("MARKET", "MOC"), F.lit(True)).when(F.col("type").isin("LIMIT", "LOO"), limit_ok).when(F.col("type") == "STOP", stop_ok).when(F.col("type") == "STOP_LIMIT", stop_ok & limit_ok).otherwise(F.lit(False))
    price, fee = linear_cost(F.col("qty"), ref, bps)
    capped = F.when(F.col("type").isin("LIMIT", "LOO", "STOP_LIMIT"), F.when(buy, F.least(price, F.col("limit"))).otherwise(F.greatest(price, F.col("limit")))).otherwise(price)
    filled = F.coalesce(ok, F.lit(False)) & ref.isNotNull()
    return orders.withColumns({"filled": filled, "fill_price": F.when(filled, capped), "commission": F.when(filled, fee)})


def trailing_stop(rows: DataFrame, by: str, at: list[str], percent: float, price: str = "price") -> DataFrame:
    """rows with the stop that trails the greatest price so far, and whether it has been hit by then."""
    w = Window.partitionBy(by).orderBy(*at)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    stop = F.max(price).over(before) * (1 - percent)
    hit = F.coalesce((F.col(price) <= F.col("stop")).cast("int"), F.lit(0))
    return rows.withColumn("stop", stop).withColumn("triggered", F.max(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)


def legal(src: Column, dst: Column) -> Column:
    allowed = F.lit(False)
    for a, to in TRANSITIONS.items():
        if to:
            allowed = allowed | ((src == a) & dst.isin(*to))
    return allowed


def order_states(events: DataFrame, by: str = "order_id", at: tuple[str, ...] = ("seq",)) -> DataFrame:
    """events (status, fill_qty, target) with the status before, and whether step, direction and total are lawful."""
    w = Window.partitionBy(by).orderBy(*at)
    before = F.coalesce(F.lag("status").over(w), F.lit("NEW"))
    total = F.sum(F.coalesce("fill_qty", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumns({"before": before, "filled": total})
    ok = legal(F.col("before"), F.col("status")) & (F.abs("filled") <= F.abs("target")) & (F.coalesce(F.col("fill_qty"), F.lit(0.0)) * F.col("target") >= 0)
    return rows.withColumn("ok", ok)


def hash_chain(events: DataFrame, by: str, at: list[str], payload: list[str]) -> DataFrame:
    """by, n, digest: d0 = sha256(genesis), then sha256 of the digest before and the event's JSON, in order."""
    # keys sorted, so that the text of an event doesn't depend on the order of columns
    ordered = events.select(by, *at, F.to_json(F.struct(*sorted(payload))).alias("_j"))
    kind = events.schema[by].dataType.simpleString()
    return ordered_fold(ordered, by, [*at, "_j"], lambda: _Chain(by), f"`{by}` {kind}, n int, digest string")


class _Chain(Fold):
    def __init__(self, by: str):
        self.by, self.key, self.n, self.digest = by, None, 0, sha256(GENESIS.encode()).digest()

    def rows(self, part: pd.DataFrame) -> None:
        self.key = part[self.by].iloc[0]
        for text in part["_j"]:
            self.digest = sha256(self.digest + text.encode()).digest()
        self.n += len(part)

    def end(self) -> pd.DataFrame:
        return pd.DataFrame({self.by: [self.key], "n": [self.n], "digest": [self.digest.hex()]})


def verify_chain(events: DataFrame, chains: DataFrame, by: str, at: list[str], payload: list[str]) -> DataFrame:
    """by, ok, expected, found: whether the events give the digests (by, n, digest) on record; a chain that only one side
    has isn't ok."""
    own = hash_chain(events, by, at, payload).select(by, F.col("n").alias("_n"), F.col("digest").alias("found"))
    both = chains.select(by, "n", F.col("digest").alias("expected")).join(own, by, "full")
    return both.select(by, F.coalesce((F.col("expected") == F.col("found")) & (F.col("n") == F.col("_n")), F.lit(False)).alias("ok"), "expected", "found")


def rebalance(rows: DataFrame, nav: DataFrame, by: str = "book", max_weight: float = 0.1, max_leverage: float = 1.0, cash_buffer: float = 0.02, lot: int = 1, min_notional: float = 100.0, long_only: bool = False, max_turnover: float = 1.0) -> DataFrame:
    """rows (book, ticker, weight, lower, upper, held, price) and nav (book, nav) with the order quantity of each: weights
    without a tradeable interval count 0, then long-only, cap by name, leverage, cash buffer, lots rounded half to even,
    least notional, and turnover scaled to its limit."""
    w = Window.partitionBy(by)
    mask = (F.col("lower") > 0) | (F.col("upper") < 0)
    weight = F.when(mask, F.col("weight")).otherwise(0.0)
    if long_only:
        weight = F.greatest(weight, F.lit(0.0))
    out = rows.join(nav, by).withColumn("_w", F.greatest(F.lit(-max_weight), F.least(F.lit(max_weight), weight)))
    gross = F.sum(F.abs("_w")).over(w)
    scale = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(max_leverage), gross), F.lit(1.0)))
    out = out.withColumn("_w", F.col("_w") * scale)
    invested = F.sum(F.abs("_w")).over(w)
    out = out.withColumn("_w", F.col("_w") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(1 - cash_buffer), invested), F.lit(1.0))))

    def lots(x: Column) -> Column:
        return F.bround(x / lot) * lot

    def kept(q: Column) -> Column:
        return F.when((F.abs(q) * F.col("price") >= min_notional) & (F.col("nav") > 0), q).otherwise(0.0)

    out = out.withColumn("_q", lots(F.col("_w") * F.col("nav") / F.col("price") - F.col("held"))).withColumn("_q", kept(F.col("_q")))
    traded = F.sum(F.abs("_q") * F.col("price")).over(w) / F.col("nav")
    out = out.withColumn("_s", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(max_turnover), traded), F.lit(1.0))))
    out = out.withColumn("_q", F.when(F.col("_s") < 1, lots(F.col("_q") * F.col("_s"))).otherwise(F.col("_q")))
    return out.withColumn("order_qty", kept(F.col("_q"))).drop("_w", "_q", "_s")


def risk_gate(orders: DataFrame, by: str = "book", max_notional: float = 1e6, max_weight: float = 0.2, max_participation: float = 0.1, min_cash: float = 0.0) -> DataFrame:
    """orders (book, ticker, qty, price, held, nav, cash, adv) with `reason`: the first check that rejects each, or NULL.
    Later checks see what earlier ones let through; buys beyond the cash go by size, the largest first."""
    notional = F.abs(F.col("qty")) * F.col("price")
    rows = orders.withColumn("_n", notional)
    reason = F.when(F.col("price").isNull(), "unknown ticker").when(F.col("_n") > max_notional, "notional").when(
        F.abs((F.col("held") + F.col("qty")) * F.col("price")) > max_weight * F.col("nav"), "weight").when(
        F.col("adv").isNull() | (F.col("_n") > max_participation * F.col("adv")), "participation")
    rows = rows.withColumn("reason", reason)
    live = F.col("reason").isNull()
    w = Window.partitionBy(by)
    sells = F.sum(F.when(live & (F.col("qty") < 0), F.col("_n")).otherwise(0.0)).over(w)
    # the cash left if this buy and all smaller ones go through
    buys = F.sum(F.when(live & (F.col("qty") > 0), F.col("_n")).otherwise(0.0)).over(w.orderBy("_n", "ticker").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_left", F.col("cash") + sells - buys)
    return rows.withColumn("reason", F.when(live & (F.col("qty") > 0) & (F.col("_left") < min_cash), "cash").otherwise(F.col("reason"))).drop("_n", "_left")
