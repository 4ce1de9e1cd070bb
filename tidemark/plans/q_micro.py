"""Microstructure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.operators import crosssection as xs
from tidemark.operators import microstructure as ms
from tidemark.plans.datasets import DAILY_SQL, RETURNS_SQL, daily
from tidemark.plans.q_bars import SIGNED_SQL, TICKS_SQL
from tidemark.plans.q_research import rounded
from tidemark.plans.registry import query, table

W = "(PARTITION BY instrument ORDER BY ts, seq)"
D = "(PARTITION BY instrument ORDER BY date)"
DP_SQL = SIGNED_SQL + f", dp AS (SELECT *, price - lag(price) OVER {W} AS dp, side * size AS sv FROM signed), dq AS (SELECT *, lag(dp) OVER {W} AS dq FROM dp)"


def _ticks(spark, sf_dir):
    return bars.ticks_from_events(table(spark, sf_dir, "events"))


@query("micro_tick_rule", f"WITH {SIGNED_SQL} SELECT instrument, seq, CAST(side AS INTEGER) AS side FROM signed")
def micro_tick_rule(spark, sf_dir):
    return bars.tick_rule(_ticks(spark, sf_dir)).select("instrument", "seq", "side")


@query("micro_roll", f"WITH {DP_SQL} SELECT instrument, count(*) AS n, round(CASE WHEN covar_samp(dp, dq) < 0 THEN 2 * sqrt(-covar_samp(dp, dq)) END, 5) AS roll_spread FROM dq WHERE dp IS NOT NULL AND dq IS NOT NULL GROUP BY 1")
def micro_roll(spark, sf_dir):
    return rounded(ms.roll_spread(_ticks(spark, sf_dir)), 5)


@query("micro_roll_rolling", f"""WITH {DP_SQL} SELECT instrument, seq, round(CASE WHEN count(dp + dq) OVER w >= 10 AND covar_samp(dp, dq) OVER w < 0 THEN 2 * sqrt(-covar_samp(dp, dq) OVER w) END, 4) AS roll_spread
FROM dq WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def micro_roll_rolling(spark, sf_dir):
    return rounded(ms.roll_spread_rolling(_ticks(spark, sf_dir), 20).select("instrument", "seq", "roll_spread"), 4)


@query("micro_kyle", f"WITH {DP_SQL} SELECT instrument, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN regr_slope(dp, sv) END, 5) AS kyle_lambda FROM dp WHERE dp IS NOT NULL GROUP BY 1")
def micro_kyle(spark, sf_dir):
    return rounded(ms.kyle_lambda(_ticks(spark, sf_dir)), 5)


@query("micro_kyle_rolling", f"""WITH {DP_SQL}, v AS (SELECT *, CASE WHEN dp IS NOT NULL THEN sv END AS x FROM dp)
SELECT instrument, seq, round(CASE WHEN rn >= 20 AND count(dp) OVER w >= 10 THEN covar_samp(dp, x) OVER w / nullif(var_samp(x) OVER w, 0) END, 4) AS kyle_lambda
FROM v WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def micro_kyle_rolling(spark, sf_dir):
    return rounded(ms.kyle_lambda_rolling(_ticks(spark, sf_dir), 20).select("instrument", "seq", "kyle_lambda"), 4)


ROLL = "(PARTITION BY instrument ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("micro_amihud", f"""WITH {DAILY_SQL}, r AS (SELECT instrument, date, CASE WHEN volume > 0 THEN abs(close / lag(close) OVER {D} - 1) / volume END AS r FROM daily)
SELECT instrument, date, round(CASE WHEN count(r) OVER {ROLL} = 10 THEN avg(r) OVER {ROLL} END, 5) AS amihud FROM r""")
def micro_amihud(spark, sf_dir):
    return rounded(ms.amihud(daily(spark, sf_dir), 10).select("instrument", "date", "amihud"), 5)


@query("micro_parkinson", f"""WITH {DAILY_SQL}, h AS (SELECT instrument, date, pow(ln(high / low), 2) AS h FROM daily)
SELECT instrument, date, round(CASE WHEN count(h) OVER {ROLL} = 10 THEN sqrt(avg(h) OVER {ROLL} / (4 * ln(2))) END, 5) AS parkinson FROM h""")
def micro_parkinson(spark, sf_dir):
    return rounded(ms.parkinson(daily(spark, sf_dir), 10).select("instrument", "date", "parkinson"), 5)


@query("micro_corwin_schultz", f"""WITH {DAILY_SQL}, b AS (SELECT *, pow(ln(high / low), 2) + lag(pow(ln(high / low), 2)) OVER {D} AS beta,
  pow(ln(greatest(high, lag(high) OVER {D}) / least(low, lag(low) OVER {D})), 2) AS gamma, lag(high) OVER {D} AS before FROM daily),
a AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS alpha FROM b)
SELECT instrument, date, round(CASE WHEN before IS NOT NULL THEN greatest(0, least(1, 2 * (exp(alpha) - 1) / (1 + exp(alpha)))) END, 5) AS corwin_schultz FROM a""")
def micro_corwin_schultz(spark, sf_dir):
    return rounded(ms.corwin_schultz(daily(spark, sf_dir)).select("instrument", "date", "corwin_schultz"), 5)


@query("micro_bvc_z", f"""WITH {DP_SQL} SELECT instrument, seq, round(CASE WHEN count(dp) OVER w = 10 THEN (dp - avg(dp) OVER w) / nullif(stddev_samp(dp) OVER w, 0) END, 4) AS bvc_z
FROM dp WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def micro_bvc_z(spark, sf_dir):
    return rounded(ms.bulk_classification(_ticks(spark, sf_dir), 10).select("instrument", "seq", "bvc_z"), 4)


@query("micro_bvc")
def micro_bvc(spark, sf_dir):
    return rounded(ms.bulk_classification(_ticks(spark, sf_dir), 10).select("instrument", "seq", "buy_share"))


@query("micro_vpin", f"""WITH {SIGNED_SQL}, c AS (SELECT *, sum(size) OVER {W} AS cum, sum(size) OVER (PARTITION BY instrument) AS whole FROM signed),
k AS (SELECT *, CAST(floor((cum - size) / 200) AS BIGINT) AS bucket FROM c WHERE floor((cum - size) / 200) < floor(whole / 200)),
i AS (SELECT instrument, bucket, max(ts) AS ts, sum(size) AS volume, abs(sum(CASE WHEN side > 0 THEN size ELSE 0 END) - sum(CASE WHEN side < 0 THEN size ELSE 0 END)) / sum(size) AS imbalance FROM k GROUP BY 1, 2)
SELECT instrument, bucket, ts, volume, round(imbalance, 6) AS imbalance, round(CASE WHEN count(*) OVER w = 3 THEN avg(imbalance) OVER w END, 6) AS vpin
FROM i WINDOW w AS (PARTITION BY instrument ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def micro_vpin(spark, sf_dir):
    return rounded(ms.vpin(_ticks(spark, sf_dir), 200.0, 3))


QUOTES_SQL = TICKS_SQL + """, q AS (SELECT instrument, seq, price - size / 100 AS bid_px, CASE WHEN seq % 11 = 0 THEN price - 1 ELSE price + size / 50 END AS ask_px, size AS bid_sz, 101 - size AS ask_sz FROM ticks),
t AS (SELECT *, bid_px IS NOT NULL AND ask_px > bid_px AS ok FROM q)"""


@query("micro_top_of_book", f"""WITH {QUOTES_SQL}, m AS (SELECT *, CASE WHEN ok THEN (ask_px + bid_px) / 2 END AS mid, CASE WHEN ok THEN ask_px - bid_px END AS spread, CASE WHEN ok THEN bid_sz + ask_sz END AS total FROM t)
SELECT instrument, seq, round(mid, 6) AS mid, round(spread, 6) AS spread, round((bid_sz - ask_sz) / total, 6) AS imbalance, round((ask_px * bid_sz + bid_px * ask_sz) / total, 6) AS microprice,
round(spread / mid, 6) AS rel_spread, round(((ask_px * bid_sz + bid_px * ask_sz) / total - mid) / mid, 6) AS micro_dev FROM m""")
def micro_top_of_book(spark, sf_dir):
    t = _ticks(spark, sf_dir)
    ask = F.when(F.col("seq") % 11 == 0, F.col("price") - 1).otherwise(F.col("price") + F.col("size") / 50)
    q = t.select("instrument", "seq", (F.col("price") - F.col("size") / 100).alias("bid_px"), ask.alias("ask_px"), F.col("size").alias("bid_sz"), (101 - F.col("size")).alias("ask_sz"))
    return rounded(ms.top_of_book(q).select("instrument", "seq", "mid", "spread", "imbalance", "microprice", "rel_spread", "micro_dev"))


@query("micro_signed_flow", f"""WITH {SIGNED_SQL}, x AS (SELECT s.*, CASE event_type WHEN 'purchase' THEN 'B' WHEN 'click' THEN 'B' WHEN 'error' THEN 'A' ELSE 'N' END AS x FROM signed s JOIN events ON event_id = seq),
dir AS (SELECT *, CAST(CASE x WHEN 'B' THEN 1 WHEN 'A' THEN -1 ELSE side END AS INTEGER) AS direction FROM x)
SELECT instrument, seq, direction, direction * size AS signed_volume, round(direction * size * price, 6) AS signed_dollars FROM dir""")
def micro_signed_flow(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = F.when(F.col("event_type").isin("purchase", "click"), "B").when(F.col("event_type") == "error", "A").otherwise("N")
    t = bars.ticks_from_events(e).join(e.select(F.col("event_id").alias("seq"), side.alias("exchange_side")), "seq")
    return rounded(ms.signed_flow(t, "exchange_side").select("instrument", "seq", "direction", "signed_volume", "signed_dollars"))


@query("micro_realized_moments", f"""WITH {RETURNS_SQL}, r AS (SELECT instrument, date, ret, abs(ret) * abs(lag(ret) OVER {D}) AS p FROM returns WHERE ret IS NOT NULL),
m AS (SELECT instrument, count(*) AS n, sum(ret * ret) AS rv, sum(CASE WHEN ret > 0 THEN ret * ret ELSE 0 END) AS rs_plus, sum(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END) AS rs_minus,
  pi() / 2 * sum(p) AS bpv, sum(pow(ret, 3)) AS s3, sum(pow(ret, 4)) AS s4 FROM r GROUP BY 1)
SELECT instrument, n, round(rv, 4) AS rv, round(rs_plus, 4) AS rs_plus, round(rs_minus, 4) AS rs_minus, round(rs_plus - rs_minus, 4) AS signed_jump, round(bpv, 4) AS bpv,
round(greatest(rv - bpv, 0) / rv, 4) AS rel_jump, round(sqrt(n) * s3 / pow(rv, 1.5), 4) AS skew, round(ln(n / 3.0 * s4), 4) AS quarticity FROM m""")
def micro_realized_moments(spark, sf_dir):
    rows = xs.with_returns(daily(spark, sf_dir))
    return rounded(ms.realized_moments(rows, ["instrument"], ["date"]).withColumn("quarticity", F.log("quarticity")), 4)


@query("micro_deseasonalize", f"""WITH {SIGNED_SQL}, b AS (SELECT *, hour(ts) // 8 AS bucket FROM signed)
SELECT instrument, seq, round(median(price) OVER (PARTITION BY instrument, bucket ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  / median(price) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS multiplier FROM b""")
def micro_deseasonalize(spark, sf_dir):
    rows = _ticks(spark, sf_dir).withColumn("bucket", F.floor(F.hour("ts") / 8))
    return rounded(ms.deseasonalize(rows, "instrument", "bucket", "price", ["ts", "seq"]).select("instrument", "seq", "multiplier"))


@query("micro_vpin_bulk")
def micro_vpin_bulk(spark, sf_dir):
    return rounded(ms.vpin_bulk(_ticks(spark, sf_dir), 200.0, 3, 3))
