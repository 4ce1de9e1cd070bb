"""Bar queries over the tick view of `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import kernels
from tidemark.operators import bars
from tidemark.plans.registry import query, table

TICKS_SQL = """ticks AS (
  SELECT user_id AS instrument, ts, event_id AS seq, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS size
  FROM events)"""

SIGNED_SQL = TICKS_SQL + """, d AS (
  SELECT *, row_number() OVER w AS rn, CAST(sign(price - lag(price) OVER w) AS INTEGER) AS chg
  FROM ticks WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq)
), signed AS (
  SELECT instrument, ts, seq, price, size, rn,
         coalesce(last_value(nullif(chg, 0) IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts, seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS side
  FROM d)"""


@query(
    "bars_tick",
    f"""WITH {SIGNED_SQL}
SELECT instrument, (rn - 1) // 10 AS bar_id, min(ts) AS ts_open, max(ts) AS ts_close,
       arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close,
       sum(size) AS volume, round(sum(price * size) / sum(size), 6) AS vwap, count(*) AS tick_count,
       round(sum(price * size), 4) AS dollar_volume, CAST(sum(side) AS BIGINT) AS signed_ticks
FROM signed GROUP BY 1, 2 HAVING count(*) = 10""",
)
def bars_tick(spark, sf_dir):
    return bars.tick_bars(bars.ticks_from_events(table(spark, sf_dir, "events")), 10)


def _ticks(spark, sf_dir):
    return bars.ticks_from_events(table(spark, sf_dir, "events"))


def _bar_sql(source: str, extra: str = "") -> str:
    return f"""SELECT instrument, bar_id, min(ts) AS ts_open, max(ts) AS ts_close, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close,
sum(size) AS volume, round(sum(price * size) / sum(size), 6) AS vwap, count(*) AS tick_count, round(sum(price * size), 4) AS dollar_volume, CAST(sum(side) AS BIGINT) AS signed_ticks
FROM {source} GROUP BY 1, 2 {extra}"""


def _reset_sql(value: str, threshold: float) -> str:
    """Bars by a recursive sum that starts again where it reaches the threshold."""
    return f"""WITH RECURSIVE {SIGNED_SQL}, walk AS (
  SELECT instrument, rn, CASE WHEN {value} >= {threshold} THEN 0.0 ELSE {value} END AS acc, 0 AS bar_id, {value} >= {threshold} AS closes FROM signed WHERE rn = 1
  UNION ALL SELECT s.instrument, s.rn, CASE WHEN w.acc + {value} >= {threshold} THEN 0.0 ELSE w.acc + {value} END, CASE WHEN w.closes THEN w.bar_id + 1 ELSE w.bar_id END, w.acc + {value} >= {threshold}
  FROM walk w JOIN signed s ON s.instrument = w.instrument AND s.rn = w.rn + 1),
t AS (SELECT s.*, CAST(w.bar_id AS BIGINT) AS bar_id, w.closes FROM signed s JOIN walk w USING (instrument, rn))
{_bar_sql('t', 'HAVING bool_or(closes)')}"""


@query("bars_volume", _reset_sql("CAST(size AS DOUBLE)", 300.0))
def bars_volume(spark, sf_dir):
    return bars.threshold_bars(_ticks(spark, sf_dir), 300.0, "volume")


@query("bars_dollar", _reset_sql("price * size", 20000.0))
def bars_dollar(spark, sf_dir):
    return bars.threshold_bars(_ticks(spark, sf_dir), 20000.0, "dollar")


P_SQL = "avg(CASE WHEN side > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rn <= 10)"
BUY_SQL, SELL_SQL = ("coalesce(avg(x) FILTER (WHERE rn <= 10 AND side %s 0), avg(x) FILTER (WHERE rn <= 10))" % sign for sign in (">", "<"))
VALUE_SQL = {"tick": "CAST(1 AS DOUBLE)", "volume": "CAST(size AS DOUBLE)", "dollar": "price * size"}


def _imbalance_sql(kind: str, first: str, ticks: float, span: int) -> str:
    """Imbalance bars by recursion: `first` is the SQL of the first expected imbalance, over rows of v (instrument, rn, x)."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"""WITH RECURSIVE {SIGNED_SQL}, v AS (SELECT *, side * ({VALUE_SQL[kind]}) AS x FROM signed),
start AS (SELECT instrument, {first} AS x0 FROM v GROUP BY 1),
walk AS (SELECT instrument, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS theta, CAST(0 AS BIGINT) AS n, CAST({ticks} AS DOUBLE) AS ticks, CASE WHEN abs(x0) >= 1e-9 THEN x0 WHEN x0 >= 0 THEN 1e-9 ELSE -1e-9 END AS ex, CAST(0 AS BIGINT) AS bar_id, false AS closes FROM start
  UNION ALL SELECT instrument, rn, CASE WHEN hit THEN 0 ELSE t END, CASE WHEN hit THEN 0 ELSE m END, CASE WHEN hit THEN least(greatest({a} * m + (1 - {a}) * ticks, 1.0), 1e9) ELSE ticks END,
    CASE WHEN NOT hit THEN ex WHEN abs(nx) >= 1e-9 THEN nx WHEN nx >= 0 THEN 1e-9 ELSE -1e-9 END, bar_id, hit
  FROM (SELECT *, {a} * t / m + (1 - {a}) * ex AS nx, abs(t) >= greatest(ticks * abs(ex), 1e-9) AS hit
    FROM (SELECT v.instrument, v.rn, w.theta + v.x AS t, w.n + 1 AS m, w.ticks, w.ex, CASE WHEN w.closes THEN w.bar_id + 1 ELSE w.bar_id END AS bar_id FROM walk w JOIN v ON v.instrument = w.instrument AND v.rn = w.rn + 1))),
t AS (SELECT s.*, w.bar_id, w.closes FROM signed s JOIN walk w USING (instrument, rn))
{_bar_sql('t', 'HAVING bool_or(closes)')}"""


def _runs_sql(kind: str, p: str, buy: str, sell: str, ticks: float, span: int) -> str:
    """Runs bars by recursion: p, buy and sell are the SQL of the first expectations, over rows of v (instrument, rn, side, x)."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"""WITH RECURSIVE {SIGNED_SQL}, v AS (SELECT *, {VALUE_SQL[kind]} AS x FROM signed),
start AS (SELECT instrument, {p} AS p, {buy} AS buy, {sell} AS sell FROM v GROUP BY 1),
walk AS (SELECT instrument, CAST(0 AS BIGINT) AS rn, CAST(0 AS DOUBLE) AS tb, CAST(0 AS DOUBLE) AS ts, CAST(0 AS BIGINT) AS nb, CAST(0 AS BIGINT) AS ns, CAST({ticks} AS DOUBLE) AS ticks, CAST(least(greatest(p, 0), 1) AS DOUBLE) AS p, CAST(buy AS DOUBLE) AS buy, CAST(sell AS DOUBLE) AS sell, CAST(0 AS BIGINT) AS bar_id, false AS closes FROM start
  UNION ALL SELECT instrument, rn, CASE WHEN hit THEN 0 ELSE b END, CASE WHEN hit THEN 0 ELSE s END, CASE WHEN hit THEN 0 ELSE mb END, CASE WHEN hit THEN 0 ELSE ms END,
    CASE WHEN hit THEN least(greatest({a} * (mb + ms) + (1 - {a}) * ticks, 1.0), 1e9) ELSE ticks END, CASE WHEN hit THEN least(greatest({a} * mb / (mb + ms) + (1 - {a}) * p, 0.0), 1.0) ELSE p END,
    CASE WHEN hit AND mb > 0 THEN {a} * b / mb + (1 - {a}) * buy ELSE buy END, CASE WHEN hit AND ms > 0 THEN {a} * s / ms + (1 - {a}) * sell ELSE sell END, bar_id, hit
  FROM (SELECT *, greatest(b, s) >= greatest(ticks * greatest(p * buy, (1 - p) * sell), 1e-9) AS hit
    FROM (SELECT v.instrument, v.rn, w.tb + CASE WHEN v.side > 0 THEN v.x ELSE 0 END AS b, w.ts + CASE WHEN v.side > 0 THEN 0 ELSE v.x END AS s, w.nb + CASE WHEN v.side > 0 THEN 1 ELSE 0 END AS mb, w.ns + CASE WHEN v.side > 0 THEN 0 ELSE 1 END AS ms,
      w.ticks, w.p, w.buy, w.sell, CASE WHEN w.closes THEN w.bar_id + 1 ELSE w.bar_id END AS bar_id FROM walk w JOIN v ON v.instrument = w.instrument AND v.rn = w.rn + 1))),
t AS (SELECT s.*, w.bar_id, w.closes FROM signed s JOIN walk w USING (instrument, rn))
{_bar_sql('t', 'HAVING bool_or(closes)')}"""


for _kind in bars.INCREMENTS:

    @query(f"bars_imbalance_{_kind}", _imbalance_sql(_kind, "avg(x) FILTER (WHERE rn <= 10)", 5, 5))
    def bars_imbalance(spark, sf_dir, kind=_kind):
        return bars.imbalance_bars(_ticks(spark, sf_dir), kind, kernels.ImbalanceConfig(exp_ticks=5, warmup=10, span_ticks=5, span_imbalance=5))

    @query(f"bars_runs_{_kind}", _runs_sql(_kind, P_SQL, BUY_SQL, SELL_SQL, 5, 5))
    def bars_runs(spark, sf_dir, kind=_kind):
        return bars.runs_bars(_ticks(spark, sf_dir), kind, kernels.RunsConfig(exp_ticks=5, warmup=10, span=5))


@query("bars_time_window", f"WITH {SIGNED_SQL}, t AS (SELECT *, date_trunc('day', ts) AS bar_id FROM signed) {_bar_sql('t')}")
def bars_time_window(spark, sf_dir):
    return bars.time_bars(_ticks(spark, sf_dir), "1 day")


@query("bars_session_window", f"""WITH {SIGNED_SQL}, n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 86400000000 THEN 0 ELSE 1 END AS fresh FROM signed WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq)),
t AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS bar_id FROM n) {_bar_sql('t')}""")
def bars_session_window(spark, sf_dir):
    return bars.session_bars(_ticks(spark, sf_dir), 86400)


@query("bars_flow_ratios", f"""WITH {SIGNED_SQL} SELECT instrument, (rn - 1) // 10 AS bar_id, round(sum(side * size) / sum(size), 6) AS volume_ratio,
round(sum(side * price * size) / sum(price * size), 6) AS dollar_ratio, round(sum(side) / count(*), 6) AS tick_ratio FROM signed GROUP BY 1, 2 HAVING count(*) = 10""")
def bars_flow_ratios(spark, sf_dir):
    out = bars.flow_ratios(_ticks(spark, sf_dir), 10)
    return out.select("instrument", "bar_id", *(F.round(c, 6).alias(c) for c in ("volume_ratio", "dollar_ratio", "tick_ratio")))


@query("bars_statistics", f"""WITH {SIGNED_SQL} SELECT instrument, (rn - 1) // 10 AS bar_id, round(avg(size), 6) AS mean, arg_max(size, rn) AS last, round(stddev_samp(size), 6) AS std,
min(size) AS least, max(size) AS greatest, arg_max(size, rn) - arg_min(size, rn) AS change FROM signed GROUP BY 1, 2 HAVING count(*) = 10""")
def bars_statistics(spark, sf_dir):
    return bars.bar_statistics(_ticks(spark, sf_dir), 10).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})
