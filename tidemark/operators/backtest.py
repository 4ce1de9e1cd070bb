"""Portfolio states with corporate actions, replays of target weights over prices, and the daily cycle around them.

A state is a fold of a run's or a ticker's events in order; runs and tickers are folded next to each other. Events are
rows (kind, qty, price, commission, ratio, per_share), and what can't be is an error of that row (`error`), not of the job.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tidemark.fold import Fold, ordered_fold
from tidemark.operators import calendar, execution, performance, pit
from tidemark.sources import store

LEAST_BPS = 2.0


class NoTrade(Enum):
    """What becomes of a holding whose signal can't be traded."""

    HOLD = "hold"
    FLATTEN = "flatten"
    DECAY = "decay"


def untradeable_weight(policy: NoTrade | str, tradeable: Column, weight: Column, held_weight: Column, decay: float = 0.5) -> Column:
    other = {NoTrade.HOLD: held_weight, NoTrade.FLATTEN: F.lit(0.0), NoTrade.DECAY: held_weight * decay}[NoTrade(policy)]
    return F.when(tradeable, weight).otherwise(other)


# --- states ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Position:
    qty: float = 0.0
    cost: float = 0.0
    realized: float = 0.0
    cash: float = 0.0

    def value(self, price: float) -> float:
        return self.qty * price

    def unrealized(self, price: float) -> float:
        return self.qty * (price - self.cost)

    def filled(self, qty: float, price: float, commission: float = 0.0) -> Position:
        """Adding averages the cost, reducing realises against it, and crossing zero starts at the fill's price."""
        after, realized, cost = self.qty + qty, self.realized, self.cost
        if self.qty * qty < 0:
            closed = min(abs(qty), abs(self.qty))
            realized += (price - cost) * closed * np.sign(self.qty)
            cost = price if abs(qty) > abs(self.qty) else cost if after else 0.0
        elif qty:
            cost = (cost * abs(self.qty) + price * abs(qty)) / (abs(self.qty) + abs(qty))
        return Position(after, cost, realized, self.cash - qty * price - commission)

    def split(self, ratio: float) -> Position:
        """Quantity times the ratio, which has to come out whole; the cost divided by it."""
        qty = self.qty * ratio
        if not ratio > 0 or abs(qty - round(qty)) > 1e-9:
            raise ValueError("a split has to leave whole shares")
        return replace(self, qty=float(round(qty)), cost=self.cost / ratio)

    def dividend(self, per_share: float) -> Position:
        return replace(self, cash=self.cash + self.qty * per_share)


class _State(Fold):
    def __init__(self):
        self.now = Position()

    def one(self, kind, qty, price, commission, ratio, per_share) -> tuple:
        try:
            if kind == "fill":
                self.now = self.now.filled(qty, price, commission if commission == commission else 0.0)
            elif kind == "split":
                self.now = self.now.split(ratio)
            elif kind == "dividend":
                self.now = self.now.dividend(per_share)
            else:
                raise ValueError(f"no event {kind}")
            error = None
        except ValueError as e:
            error = str(e)
        return self.now.qty, self.now.cost, self.now.realized, self.now.cash, error

    def rows(self, part: pd.DataFrame) -> pd.DataFrame:
        columns = [part[c].tolist() for c in ("kind", "qty", "price", "commission", "ratio", "per_share")]
        out = pd.DataFrame([self.one(*x) for x in zip(*columns, strict=True)], columns=["position", "avg_cost", "realized", "cash", "error"])
        return part.assign(**{c: out[c].to_numpy() for c in out})


def states(events: DataFrame, by: str = "ticker", at: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """events with position, avg_cost, realized, cash and error after each; kinds are fill, split and dividend."""
    schema = StructType(list(events.schema.fields))
    for c in ("position", "avg_cost", "realized", "cash"):
        schema = schema.add(c, "double")
    return ordered_fold(events, by, list(at), _State, schema.add("error", "string"))


def ledger(*events: DataFrame, at: tuple[str, ...] = ("ts",), by: str = "run_id") -> DataFrame:
    """One numbered list of events: the tables' rows by run and time, seq from 0 in each run."""
    both = events[0]
    for e in events[1:]:
        both = both.unionByName(e, allowMissingColumns=True)
    order = [*at, *(c for c in ("kind", "ticker", "order_id") if c in both.columns)]
    return both.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def trades(orders: DataFrame, fills: DataFrame) -> DataFrame:
    """order_id, qty, filled, avg_price, commission of every order."""
    f = fills.groupBy("order_id").agg(F.sum("qty").alias("filled"), F.try_divide(F.sum(F.col("qty") * F.col("price")), F.sum("qty")).alias("avg_price"), F.sum("commission").alias("commission"))
    out = orders.select("order_id", "qty").join(f, "order_id", "left")
    return out.withColumns({"filled": F.coalesce("filled", F.lit(0.0)), "commission": F.coalesce("commission", F.lit(0.0))})


def decision_prices(events: DataFrame) -> DataFrame:
    """order_id, decision: the first reference price of each order."""
    return events.filter("ref IS NOT NULL").groupBy("order_id").agg(F.min_by("ref", "seq").alias("decision"))


def recovered(journal: DataFrame, at: tuple[str, ...] = ("seq",)) -> dict[str, DataFrame]:
    """What a journal (seq, kind, order_id, fill_id, ticker, qty, price, commission) says after a crash: `positions` from
    each fill once, whatever the number of its records; `pending` orders, sent without an end; `repeats`, fills recorded
    again."""
    fills = journal.filter("kind = 'fill'")
    once = fills.withColumn("_k", F.row_number().over(Window.partitionBy("fill_id").orderBy(*at)))
    first = once.filter("_k = 1").drop("_k")
    ended = journal.filter(F.col("kind").isin("filled", "cancelled", "rejected")).select("order_id").distinct()
    pending = journal.filter("kind = 'sent'").join(ended, "order_id", "left_anti").groupBy("order_id").agg(F.min("ticker").alias("ticker"), F.max("qty").alias("qty"))
    done = first.groupBy("order_id").agg(F.sum("qty").alias("done"))
    pending = pending.join(done, "order_id", "left").withColumn("left", F.col("qty") - F.coalesce("done", F.lit(0.0))).filter("left <> 0")
    held = execution.average_cost(first.withColumn("ts", F.col(at[0])), at=at)
    last = held.groupBy("ticker").agg(F.max_by(F.struct("position", "avg_cost"), F.struct(*at)).alias("s")).select("ticker", F.col("s.position").alias("qty"), F.col("s.avg_cost").alias("avg_cost"))
    return {"positions": last, "pending": pending, "repeats": once.filter("_k > 1").drop("_k")}


class NotReconciled(RuntimeError):
    """Positions or cash of the two sides differ by more than the tolerance."""


def reconciled(internal: DataFrame, broker: DataFrame, cash_internal: float, cash_broker: float, *, tol_cash: float = 1.0, tol_cost: float = 0.01, ignore: tuple[str, ...] = ()) -> DataFrame:
    """The drifts between two sides (see execution.reconcile), without ignored tickers, and one of kind CASH."""
    keep = lambda df: df.filter(~F.col("ticker").isin(*ignore)) if ignore else df
    drifts = execution.reconcile(keep(internal), keep(broker), tol_cost)
    if abs(cash_internal - cash_broker) <= tol_cash:
        return drifts
    row = drifts.sparkSession.createDataFrame([("CASH", cash_internal, cash_broker)], "kind string, internal_qty double, broker_qty double")
    return drifts.unionByName(row, allowMissingColumns=True)


def assert_reconciled(*args, **options) -> None:
    drifts = reconciled(*args, **options)
    if found := drifts.limit(20).collect():
        raise NotReconciled("; ".join(f"{r['ticker']} {r['kind']}" for r in found))


# --- checks and orders -------------------------------------------------------------------------------------------------


def max_gross_leverage(orders: DataFrame, most: float, by: str = "book") -> DataFrame:
    """orders with `dropped`: the largest go until what the holdings and the rest come to is within `most` times nav."""
    gross = F.abs((F.col("held") + F.col("qty")) * F.col("price"))
    w = Window.partitionBy(by).orderBy("_g", "ticker").rowsBetween(Window.unboundedPreceding, 0)
    out = orders.withColumn("_g", gross).withColumn("_c", F.sum("_g").over(w))
    return out.withColumn("dropped", F.col("_c") > most * F.col("nav")).drop("_g", "_c")


def protective_stops(positions: DataFrame, stop_loss: float | None = None, trail: float | None = None) -> DataFrame:
    """Orders (ticker, type, qty, stop, trail) that close each open position: a stop at the cost less stop_loss, and one that
    trails by a share of the price."""
    if stop_loss is None and trail is None:
        raise ValueError("give stop_loss, trail or both")
    held = positions.filter("qty <> 0")
    side = F.signum("qty")
    kinds = []
    if stop_loss is not None:
        kinds.append(F.struct(F.lit("STOP").alias("type"), (F.col("avg_cost") * (1 - side * stop_loss)).alias("stop"), F.lit(None).cast("double").alias("trail")))
    if trail is not None:
        kinds.append(F.struct(F.lit("TRAIL").alias("type"), F.lit(None).cast("double").alias("stop"), F.lit(float(trail)).alias("trail")))
    return held.select("ticker", (-F.col("qty")).alias("qty"), F.explode(F.array(*kinds)).alias("o")).select("ticker", "o.type", "qty", "o.stop", "o.trail")


# --- replay ------------------------------------------------------------------------------------------------------------


class CostsTooLow(ValueError):
    """A backtest whose costs are below what trading takes, without being told that this is meant."""


@dataclass(frozen=True)
class Constraints:
    cash: float = 1_000_000.0
    cash_buffer: float = 0.02
    max_weight: float = 1.0
    max_gross: float = 1.0
    min_notional: float = 100.0
    lot: int = 1
    long_only: bool = True
    bps: float = 5.0
    every_day: bool = True  # back to the weights each day, or only on days with new ones


class _Replay(Fold):
    """One run: at each date holdings are marked, and traded towards the target weights at the date's prices."""

    def __init__(self, c: Constraints, by: str):
        self.c, self.by, self.key = c, by, None
        self.cash, self.held, self.last, self.before = c.cash, {}, {}, None
        self.waiting: pd.DataFrame | None = None

    def day(self, rows: pd.DataFrame) -> tuple:
        c = self.c
        priced = {}
        fresh = set()
        for ticker, price, weight, new in zip(rows["ticker"].tolist(), rows["price"].tolist(), rows["weight"].tolist(), rows["fresh"].tolist(), strict=True):
            if price is not None and price > 0 and np.isfinite(price):
                priced[ticker] = (price, weight)
                if new or c.every_day:
                    fresh.add(ticker)
                self.last[ticker] = price
        nav = self.cash + sum(q * self.last[t] for t, q in self.held.items())
        weights = {t: float(w) for t, (_, w) in priced.items() if w is not None and w == w}
        weights = {t: min(max(w, 0.0 if c.long_only else -c.max_weight), c.max_weight) for t, w in weights.items()}
        gross = sum(map(abs, weights.values()))
        room = c.max_gross * (1 - c.cash_buffer)
        if gross > room:
            weights = {t: w * room / gross for t, w in weights.items()}
        turnover = cost = 0.0
        orders = 0
        for t in sorted(weights, key=lambda t: (weights[t] * nav - self.held.get(t, 0.0) * priced[t][0], t)):  # sales first
            if t not in fresh:
                continue
            price = priced[t][0]
            move = np.round((weights[t] * nav / price - self.held.get(t, 0.0)) / c.lot) * c.lot
            if abs(move) * price < c.min_notional:
                continue
            fee = abs(move) * price * c.bps / 1e4
            self.cash -= move * price + fee
            self.held[t] = self.held.get(t, 0.0) + move
            turnover, cost, orders = turnover + abs(move) * price, cost + fee, orders + 1
        after = self.cash + sum(q * self.last[t] for t, q in self.held.items())
        ret = after / self.before - 1 if self.before else (after / self.c.cash - 1)
        self.before = after
        exposed = sum(abs(q) * self.last[t] for t, q in self.held.items())
        return rows["date"].iloc[0], after, self.cash, exposed / after if after else 0.0, turnover / nav if nav else 0.0, cost, orders, ret, len(rows) - len(priced)

    def made(self, days: list[pd.DataFrame]) -> pd.DataFrame | None:
        if not days:
            return None
        out = pd.DataFrame([self.day(d) for d in days], columns=["date", "nav", "cash", "gross", "turnover", "cost", "n_orders", "ret", "n_skipped"])
        out.insert(0, self.by, self.key)
        return out

    def rows(self, part: pd.DataFrame) -> pd.DataFrame | None:
        self.key = part[self.by].iloc[0]
        part = part if self.waiting is None else pd.concat((self.waiting, part))
        last = part["date"].iloc[-1]  # a date's rows may go on in the next batch
        self.waiting = part[part["date"] == last]
        done = part[part["date"] != last]
        return self.made([d for _, d in done.groupby("date", sort=True)])

    def end(self) -> pd.DataFrame | None:
        return self.made([] if self.waiting is None else [self.waiting])


def replay(prices: DataFrame, weights: DataFrame, constraints: Constraints = Constraints(), by: str = "run_id", allow_low_costs: bool = False) -> DataFrame:  # noqa: B008
    """run_id, date, nav, cash, gross, turnover, cost, n_orders, ret, n_skipped of each run: target weights (run_id, date,
    ticker, weight; the last one on or before a date holds) traded at prices (date, ticker, price). A price that is missing
    or not above 0 trades nothing that day, and a holding keeps its last price."""
    if constraints.bps < LEAST_BPS and not allow_low_costs:
        raise CostsTooLow(f"costs below {LEAST_BPS} bps have to be allowed")
    runs = weights.select(by).distinct()
    grid = prices.select("date", "ticker", "price").join(runs, how="cross")  # a price table for each run; runs are few
    held = pit.asof_join(grid, weights.select(by, "date", "ticker", "weight"), [by, "ticker"], "date", "date", ["weight"])
    kind = weights.schema[by].dataType.simpleString()
    date = prices.schema["date"].dataType.simpleString()
    schema = f"`{by}` {kind}, date {date}, nav double, cash double, gross double, turnover double, cost double, n_orders long, ret double, n_skipped long"
    fresh = F.coalesce(F.col("date_matched") == F.col("date"), F.lit(False)).alias("fresh")
    return ordered_fold(held.select(by, "date", "ticker", "price", "weight", fresh), by, ["date", "ticker"], lambda: _Replay(constraints, by), schema)


def run_backtest(prices: DataFrame, weights: DataFrame, constraints: Constraints = Constraints(), by: str = "run_id", benchmark: DataFrame | None = None, **options) -> dict[str, DataFrame]:  # noqa: B008
    """`frames` of each run, its `report`, and `relative` to a benchmark (date, bench) if there is one."""
    frames = replay(prices, weights, constraints, by, **options)
    found = {"frames": frames, "report": performance.report(frames, by).join(performance.max_drawdown(frames, by), by)}
    if benchmark is not None:
        found["relative"] = performance.relative(frames.join(benchmark, "date"), by)
    return found


def calmar(rows: DataFrame, by: str, ret: str = "ret", date: str = "date") -> DataFrame:
    """by, calmar: annual return over the size of the deepest drawdown; null without one."""
    both = performance.report(rows, by, ret).join(performance.max_drawdown(rows, by, ret, date), by)
    return both.select(by, F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown")).alias("calmar"))


def summary_table(report: DataFrame, fmt: str = "markdown") -> str:
    """A table of metrics, a column for each run; a report has a row for each run."""
    pdf = report.limit(50).toPandas().set_index(report.columns[0]).T
    head = ["metric", *map(str, pdf.columns)]
    lines = [[name, *("" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v) for v in row)] for name, row in zip(pdf.index, pdf.to_numpy().tolist(), strict=True)]
    if fmt == "markdown":
        return "\n".join("| " + " | ".join(x) + " |" for x in (head, ["--"] * len(head), *lines))
    widths = [max(len(x[i]) for x in (head, *lines)) for i in range(len(head))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(row, widths, strict=True)).rstrip() for row in (head, *lines))


def tearsheet(frames: DataFrame, by: str = "run_id", window: int = 63) -> DataFrame:
    """The series of a tear sheet: equity, drawdown and rolling Sharpe by date."""
    rolled = performance.rolling(frames, by, window)
    return performance.equity(rolled, by)


# --- clocks and the daily cycle ----------------------------------------------------------------------------------------


def business_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """date of Monday to Friday."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS date")
    return days.filter(F.weekday("date") < 5)


def session_closes(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The exchange's sessions with their closes."""
    return calendar.sessions(spark, first, last)


def historical_clock(rows: DataFrame, at: str = "ts") -> DataFrame:
    """The distinct times of a table, ascending, numbered from 0; the calendar of a replay, a row for each time."""
    return rows.select(at).filter(F.col(at).isNotNull()).distinct().withColumn("step", F.row_number().over(Window.orderBy(at)) - 1)


def daily_cycle(as_of: str, *, signals: DataFrame, prices: DataFrame, positions: DataFrame, broker: DataFrame, cash: float, broker_cash: float, runs: store.RunStore | None = None, run_id: str | None = None, bps: float = 5.0, gate: dict | None = None, **constraints) -> dict[str, DataFrame]:
    """One cycle on what is known at a date: reconcile, the last signal and price of each ticker, orders, checks, paper fills,
    new positions and the digest of the fills. positions, broker: ticker, qty, avg_cost; signals: ticker, date, weight,
    lower, upper; prices: ticker, date, close, adv. Nothing is sent or saved unless positions reconcile."""
    spark = signals.sparkSession
    assert_reconciled(positions, broker, cash, broker_cash)
    signal = store.latest_signal(signals, as_of).select("ticker", "weight", "lower", "upper")
    marks = pit.latest_valid(prices, as_of, key="ticker").select("ticker", F.col("close").alias("price"))
    adv = prices.filter(F.col("date") <= F.lit(as_of)).groupBy("ticker").agg(F.max_by("adv", "date").alias("adv"))
    held = positions.select("ticker", F.col("qty").alias("held"))
    rows = signal.join(held, "ticker", "full").join(marks, "ticker").join(adv, "ticker", "left").fillna(0.0, ["held", "weight"])
    rows = rows.withColumn("book", F.lit("main"))
    value = held.join(marks, "ticker").agg(F.coalesce(F.sum(F.col("held") * F.col("price")), F.lit(0.0))).first()[0]
    nav = spark.createDataFrame([("main", cash + value)], "book string, nav double")
    wanted = execution.rebalance(rows, nav, **constraints).filter("order_qty <> 0").withColumn("qty", F.col("order_qty").cast("double"))
    wanted = wanted.drop("nav").join(F.broadcast(nav), "book").withColumn("cash", F.lit(cash))
    checked = execution.risk_gate(wanted, **(gate or {}))
    sent = checked.filter("reason IS NULL").select(F.col("ticker").alias("order_id"), "ticker", F.lit("MARKET").alias("type"), "qty", F.col("price").alias("ref"), F.lit(None).cast("double").alias("limit"), F.lit(None).cast("double").alias("stop"))
    fills = execution.paper_fills(sent, bps).filter("filled").select("order_id", "ticker", "qty", F.col("fill_price").alias("price"), "commission")
    none = {c: F.lit(None).cast("double") for c in ("ratio", "per_share")}
    opening = positions.filter("qty <> 0").select("ticker", F.lit("fill").alias("kind"), F.lit(0).alias("seq"), "qty", F.col("avg_cost").alias("price"), F.lit(0.0).alias("commission"))
    events = opening.unionByName(fills.select("ticker", F.lit("fill").alias("kind"), F.lit(1).alias("seq"), "qty", "price", "commission")).withColumns(none)
    last = states(events, at=("seq",)).groupBy("ticker").agg(F.max_by(F.struct("position", "avg_cost"), "seq").alias("s"))
    after = last.select("ticker", F.col("s.position").alias("qty"), F.col("s.avg_cost").alias("avg_cost"))
    journal = fills.withColumns({"run": F.lit(run_id or as_of), "seq": F.col("order_id")})
    digest = execution.hash_chain(journal, "run", ["seq"], ["ticker", "qty", "price", "commission"])
    found = {"orders": sent, "rejected": checked.filter("reason IS NOT NULL"), "fills": fills, "positions": after, "digest": digest}
    if runs is not None:
        row = digest.first()
        runs.save({"orders": sent, "fills": fills, "positions": after}, run_id=run_id, digest=row["digest"] if row else "", initial_cash=cash, metadata={"as_of": as_of})
    return found
