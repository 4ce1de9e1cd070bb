"""Cross-section, statistics and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import tools
from tidemark.operators import crosssection as xs
from tidemark.operators import performance as perf
from tidemark.operators import statistics as st
from tidemark.plans.datasets import DAILY_SQL, RETURNS_SQL, daily
from tidemark.plans.registry import query, table

W = "(PARTITION BY instrument ORDER BY date)"


def rounded(df, digits: int = 6):
    """Doubles rounded, so that sums in another order agree."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def round_half_away(c, digits: int):
    """The double c rounded as SQL's round() does: the nearest whole number to c * 10 ** digits, ties away from 0, over that
    power. (Spark's rounds the decimal that is shown, which differs where the product is a tie.)"""
    c, by = F.col(c) if isinstance(c, str) else c, F.lit(10.0**digits)
    out = F.round(c * by) / by
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), c).otherwise(out)


def rounded_half_away(df, digits: int = 6):
    return df.select(*((round_half_away(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("xs_momentum", f"WITH {DAILY_SQL} SELECT instrument, date, round(lag(close, 2) OVER {W} / lag(close, 20) OVER {W} - 1, 6) AS factor FROM daily")
def xs_momentum(spark, sf_dir):
    return rounded(xs.momentum(daily(spark, sf_dir), 20, 2).select("instrument", "date", "factor"))


@query("xs_reversal", f"WITH {DAILY_SQL} SELECT instrument, date, round(-(close / lag(close, 5) OVER {W} - 1), 6) AS factor FROM daily")
def xs_reversal(spark, sf_dir):
    return rounded(xs.reversal(daily(spark, sf_dir), 5).select("instrument", "date", "factor"))


ROLL10 = "(PARTITION BY instrument ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query("xs_vol", f"WITH {RETURNS_SQL} SELECT instrument, date, round(CASE WHEN count(ret) OVER {ROLL10} = 10 THEN stddev_samp(ret) OVER {ROLL10} END, 6) AS factor FROM returns")
def xs_vol(spark, sf_dir):
    return rounded(xs.volatility(daily(spark, sf_dir), 10).select("instrument", "date", "factor"))


@query("xs_illiq", f"""WITH {DAILY_SQL}, i AS (SELECT instrument, date, CASE WHEN close * volume > 0 THEN abs(close / lag(close) OVER {W} - 1) / (close * volume) END AS il FROM daily)
SELECT instrument, date, round(CASE WHEN count(il) OVER {ROLL10} = 10 THEN avg(il) OVER {ROLL10} END * 1000000, 6) AS factor FROM i""")
def xs_illiq(spark, sf_dir):
    out = xs.illiquidity(daily(spark, sf_dir), 10).select("instrument", "date", (F.col("factor") * 1000000).alias("factor"))
    return rounded(out)


@query("xs_fwd_returns", f"WITH {DAILY_SQL} SELECT instrument, date, round(lead(close, 2) OVER {W} / close - 1, 6) AS forward_return FROM daily")
def xs_fwd_returns(spark, sf_dir):
    return rounded(xs.forward_returns(daily(spark, sf_dir), 2).select("instrument", "date", "forward_return"))


FRAME_SQL = DAILY_SQL + f""", f AS (SELECT instrument, date, -(close / lag(close, 5) OVER {W} - 1) AS factor, lead(close) OVER {W} / close - 1 AS forward_return FROM daily),
ranked AS (SELECT *, CASE WHEN factor IS NOT NULL THEN rank() OVER (PARTITION BY date, factor IS NULL ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0 END AS rx,
  CASE WHEN forward_return IS NOT NULL THEN rank() OVER (PARTITION BY date, forward_return IS NULL ORDER BY forward_return) + (count(*) OVER (PARTITION BY date, forward_return) - 1) / 2.0 END AS ry FROM f),
both_sides AS (SELECT * FROM ranked WHERE factor IS NOT NULL AND forward_return IS NOT NULL)"""


def _frame(spark, sf_dir):
    return xs.forward_returns(xs.reversal(daily(spark, sf_dir), 5)).select("instrument", "date", "factor", "forward_return")


def _ic_sql(x, y):
    return f"""SELECT date, count(b.instrument) AS n, round(CASE WHEN count(b.instrument) >= 5 AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN corr({x}, {y}) END, 6) AS ic
FROM (SELECT DISTINCT date FROM daily) LEFT JOIN both_sides b USING (date) GROUP BY 1"""


@query("xs_ic_pearson", f"WITH {FRAME_SQL} {_ic_sql('b.factor', 'b.forward_return')}")
def xs_ic_pearson(spark, sf_dir):
    return rounded(xs.information_coefficients(_frame(spark, sf_dir), "pearson"))


@query("xs_ic_spearman", f"WITH {FRAME_SQL} {_ic_sql('b.rx', 'b.ry')}")
def xs_ic_spearman(spark, sf_dir):
    return rounded(xs.information_coefficients(_frame(spark, sf_dir)))


@query("xs_hac_t", f"""WITH {FRAME_SQL}, ic AS ({_ic_sql('b.rx', 'b.ry').replace('round(', '(').replace(', 6) AS ic', ') AS ic')}), d AS (SELECT date, ic - (SELECT avg(ic) FROM ic) AS d FROM ic WHERE ic IS NOT NULL),
g AS (SELECT d * d AS g0, d * lag(d) OVER (ORDER BY date) AS g1, d * lag(d, 2) OVER (ORDER BY date) AS g2 FROM d),
v AS (SELECT (sum(g0) + 2 * (2.0 / 3) * sum(g1) + 2 * (1.0 / 3) * sum(g2)) / (count(*) * count(*)) AS v, count(*) AS n FROM g)
SELECT n, round((SELECT avg(ic) FROM ic), 6) AS mean, round(CASE WHEN v > 0 THEN sqrt(v) END, 6) AS se FROM v""")
def xs_hac_t(spark, sf_dir):
    ics = xs.information_coefficients(_frame(spark, sf_dir))
    return rounded(xs.hac_mean(ics, "ic", "date", 2))


TESTS_SQL = """tests AS (SELECT p_brand AS name, avg(CASE WHEN p_size % 7 = 0 THEN 1.0 ELSE 0.0 END) / 3 AS p FROM part GROUP BY 1)"""


def _tests(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg((F.avg((F.col("p_size") % 7 == 0).cast("double")) / 3).alias("p"))


@query("xs_bh_q", f"""WITH {TESTS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS n FROM tests)
SELECT name, round(p, 6) AS p, round(least(min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS q FROM r""")
def xs_bh_q(spark, sf_dir):
    return rounded(xs.bh_q(_tests(spark, sf_dir)))


def _factors(spark, sf_dir):
    d = daily(spark, sf_dir)
    made = [("momentum", xs.momentum(d, 20, 2)), ("reversal", xs.reversal(d, 5)), ("volatility", xs.volatility(d, 10)), ("illiquidity", xs.illiquidity(d, 10))]
    returns = xs.forward_returns(d).select("instrument", "date", "forward_return")
    out = None
    for name, rows in made:
        one = rows.select(F.lit(name).alias("name"), "instrument", "date", "factor")
        out = one if out is None else out.unionByName(one)
    return out.join(returns, ["instrument", "date"])


@query("xs_screen")
def xs_screen(spark, sf_dir):
    return rounded(xs.screen(_factors(spark, sf_dir), hac_lags=2))


@query("xs_long_short", f"""WITH {FRAME_SQL}, c AS (SELECT *, rx - avg(rx) OVER (PARTITION BY date) AS w FROM ranked)
SELECT date, round(CASE WHEN sum(abs(w)) > 0 THEN sum(w * forward_return) / sum(abs(w)) END, 6) AS ls_return FROM c GROUP BY 1""")
def xs_long_short(spark, sf_dir):
    return rounded(xs.long_short(_frame(spark, sf_dir)))


@query("xs_factory")
def xs_factory(spark, sf_dir):
    return rounded(tools.factory(_factors(spark, sf_dir)).select("name", "mean", "t", "q", "dsr", "passed", "reason"))


SR_SQL = RETURNS_SQL + """, m AS (SELECT instrument, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, var_pop(ret) AS v,
  avg(ret * ret * ret) - 3 * avg(ret) * avg(ret * ret) + 2 * pow(avg(ret), 3) AS m3, kurtosis_pop(ret) AS kurt FROM returns GROUP BY 1),
sr AS (SELECT instrument, n, mean / sd AS sr, m3 / pow(v, 1.5) AS skew, kurt FROM m),
std AS (SELECT *, sqrt((1 + 0.5 * sr * sr - skew * sr + kurt / 4 * sr * sr) / (n - 1)) AS sr_std FROM sr)"""


def _returns(spark, sf_dir):
    return xs.with_returns(daily(spark, sf_dir)).select("instrument", "date", "ret")


@query("st_sharpe", f"WITH {SR_SQL} SELECT instrument, n, round(sr, 6) AS sr, round(sr_std, 6) AS sr_std FROM std")
def st_sharpe(spark, sf_dir):
    return rounded(st.sharpe(_returns(spark, sf_dir), ["instrument"]).select("instrument", "n", "sr", "sr_std"))


@query("st_psr_z", f"WITH {SR_SQL} SELECT instrument, round((sr - 0.05) / sr_std, 5) AS psr_z FROM std")
def st_psr_z(spark, sf_dir):
    return rounded(st.psr(_returns(spark, sf_dir), ["instrument"], 0.05).select("instrument", "psr_z"), 5)


@query("st_psr")
def st_psr(spark, sf_dir):
    return rounded(st.psr(_returns(spark, sf_dir), ["instrument"], 0.05).select("instrument", "psr"))


@query("st_dsr")
def st_dsr(spark, sf_dir):
    return rounded(st.dsr(_returns(spark, sf_dir), ["instrument"], 100).select("instrument", "dsr_z", "dsr"))


@query("st_min_backtest_length")
def st_min_backtest_length(spark, sf_dir):
    n = spark.range(2, 50).select(F.col("id").alias("n_trials"))
    return rounded(n.withColumn("years", st.min_backtest_length(F.col("n_trials"), F.lit(1.0))))


for _method, _adj in {
    "bonferroni": "p * n",
    "holm": "max(p * (n - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)",
    "bhy": "min(p * n * (SELECT sum(1.0 / i) FROM range(1, (SELECT count(*) + 1 FROM tests)) t(i)) / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)",
}.items():

    @query(f"st_{_method}", f"""WITH {TESTS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS n FROM tests)
SELECT name, round(p, 6) AS p, round(least({_adj}, 1.0), 6) AS p_adj FROM r""")
    def st_adjusted(spark, sf_dir, method=_method):
        return rounded(st.adjusted_p(_tests(spark, sf_dir), method))


@query("st_haircut")
def st_haircut(spark, sf_dir):
    return rounded(st.haircut(_returns(spark, sf_dir), ["instrument"]).select("instrument", "sr", "p", "p_adj", "sr_haircut"))


@query("st_overfitting")
def st_overfitting(spark, sf_dir):
    rows = _returns(spark, sf_dir).filter("ret IS NOT NULL")
    rows = rows.select(F.col("instrument").alias("strategy"), (F.month("date") % 8).alias("block"), "ret")
    return rounded(st.overfitting(rows, 8))


@query("perf_report", f"""WITH {RETURNS_SQL} SELECT instrument, count(ret) AS n,
round(CASE WHEN min(ret) <= -1 THEN -1.0 ELSE exp(sum(ln(1 + ret)) * 252 / count(ret)) - 1 END, 4) AS annual_return, round(stddev_samp(ret) * sqrt(252), 4) AS annual_volatility,
round(avg(ret) * sqrt(252) / stddev_samp(ret), 4) AS sharpe, round(avg(ret) * sqrt(252) / sqrt(avg(pow(least(ret, 0), 2))), 4) AS sortino,
round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate, round(max(ret), 4) AS best, round(min(ret), 4) AS worst FROM returns WHERE ret IS NOT NULL GROUP BY 1""")
def perf_report(spark, sf_dir):
    return rounded(perf.report(_returns(spark, sf_dir), "instrument"), 4)


EQUITY_SQL = RETURNS_SQL.replace("returns AS (", "raw_returns AS (") + """, returns AS (SELECT instrument, date, ret / 10 AS ret FROM raw_returns),
e AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY instrument ORDER BY date)) AS equity FROM returns),
dd AS (SELECT *, equity / greatest(max(equity) OVER (PARTITION BY instrument ORDER BY date), 1) - 1 AS drawdown FROM e)"""


def _calm(spark, sf_dir):
    return _returns(spark, sf_dir).withColumn("ret", F.col("ret") / 10)


@query("perf_drawdown", f"WITH {EQUITY_SQL} SELECT instrument, date, round(ln(equity), 5) + 0 AS log_equity, round(drawdown, 5) + 0 AS drawdown FROM dd")
def perf_drawdown(spark, sf_dir):
    out = perf.equity(_calm(spark, sf_dir), "instrument")
    return rounded(out.select("instrument", "date", F.log("equity").alias("log_equity"), "drawdown"), 5)


@query("perf_max_drawdown", f"WITH {EQUITY_SQL} SELECT instrument, round(min(drawdown), 5) AS max_drawdown FROM dd GROUP BY 1")
def perf_max_drawdown(spark, sf_dir):
    return rounded(perf.max_drawdown(_calm(spark, sf_dir), "instrument").select("instrument", "max_drawdown"), 5)


@query("perf_drawdown_table", f"""WITH {EQUITY_SQL}, w AS (SELECT *, CASE WHEN drawdown < -1e-12 THEN 1 ELSE 0 END AS wet FROM dd),
s AS (SELECT *, CASE WHEN wet = 1 AND coalesce(lag(wet) OVER {W}, 0) = 0 THEN 1 ELSE 0 END AS st,
  min(CASE WHEN wet = 0 THEN date END) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS dry FROM w),
ep AS (SELECT *, sum(st) OVER (PARTITION BY instrument ORDER BY date ROWS UNBOUNDED PRECEDING) AS ep FROM s),
g AS (SELECT instrument, min(date) AS start, arg_min(date, (drawdown, date)) AS trough, min(dry) AS recovery, min(drawdown) AS depth, count(*) AS n_days FROM ep WHERE wet = 1 GROUP BY instrument, ep)
SELECT instrument, start, trough, recovery, round(depth, 5) AS depth, n_days, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY depth, start) AS rank FROM g) WHERE rank <= 5""")
def perf_drawdown_table(spark, sf_dir):
    return rounded(perf.drawdown_table(_calm(spark, sf_dir), "instrument"), 5)


BENCH_SQL = RETURNS_SQL + """, mkt AS (SELECT date, avg(ret) AS bench, avg(ret * ret) AS size FROM returns WHERE ret IS NOT NULL GROUP BY 1), b AS (SELECT * FROM returns JOIN mkt USING (date) WHERE ret IS NOT NULL)"""


def _benched(spark, sf_dir):
    rows = _returns(spark, sf_dir).filter("ret IS NOT NULL")
    market = rows.groupBy("date").agg(F.avg("ret").alias("bench"), F.avg(F.col("ret") * F.col("ret")).alias("size"))
    return rows.join(market, "date")


@query("perf_relative", f"""WITH {BENCH_SQL} SELECT instrument, count(*) AS n, round(avg(ret - bench) * 252, 4) AS active_return, round(stddev_samp(ret - bench) * sqrt(252), 4) AS tracking_error,
round(avg(ret - bench) * sqrt(252) / stddev_samp(ret - bench), 4) AS information_ratio, round(regr_slope(ret, bench), 4) AS beta, round((avg(ret) - regr_slope(ret, bench) * avg(bench)) * 252, 4) AS alpha,
round(corr(ret, bench), 4) AS correlation, round(avg(ret) FILTER (WHERE bench > 0) / avg(bench) FILTER (WHERE bench > 0), 4) AS up_capture,
round(avg(ret) FILTER (WHERE bench < 0) / avg(bench) FILTER (WHERE bench < 0), 4) AS down_capture FROM b GROUP BY 1""")
def perf_relative(spark, sf_dir):
    return rounded(perf.relative(_benched(spark, sf_dir), "instrument"), 4)


@query("perf_attribution", f"""WITH {BENCH_SQL}, m AS (SELECT instrument, avg(ret) AS y, avg(bench) AS x, avg(size) AS z, var_pop(bench) AS xx, var_pop(size) AS zz, var_pop(ret) AS yy,
covar_pop(bench, size) AS xz, covar_pop(bench, ret) AS xy, covar_pop(size, ret) AS zy FROM b GROUP BY 1),
c AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM m)
SELECT instrument, round(y - bx * x - bz * z, 4) + 0 AS intercept, round(bx, 4) + 0 AS beta_bench, round(bz, 4) + 0 AS beta_size, round((bx * xy + bz * zy) / yy, 4) AS r2 FROM c""")
def perf_attribution(spark, sf_dir):
    return rounded(perf.attribution(_benched(spark, sf_dir), "instrument", ["bench", "size"]), 4)


@query("perf_tail", f"""WITH {RETURNS_SQL}, q AS (SELECT instrument, quantile_cont(ret, 0.05) AS q, count(ret) AS n, skewness(ret) AS skew, kurtosis(ret) AS kurtosis FROM returns GROUP BY 1)
SELECT q.instrument, q.n, round(-any_value(q.q), 4) AS var, round(-avg(r.ret), 4) AS cvar, round(any_value(q.skew), 4) AS skew, round(any_value(q.kurtosis), 4) AS kurtosis
FROM q JOIN returns r ON r.instrument = q.instrument AND r.ret <= q.q GROUP BY 1, 2""")
def perf_tail(spark, sf_dir):
    return rounded(perf.tail(_returns(spark, sf_dir), "instrument"), 4)


@query("perf_rolling", f"""WITH {BENCH_SQL} SELECT instrument, date, round(CASE WHEN count(ret) OVER w = 10 THEN stddev_samp(ret) OVER w * sqrt(252) END, 4) AS rolling_vol,
round(CASE WHEN count(ret) OVER w = 10 THEN avg(ret) OVER w * sqrt(252) / stddev_samp(ret) OVER w END, 4) AS rolling_sharpe,
round(CASE WHEN count(ret) OVER w = 10 THEN covar_samp(ret, bench) OVER w / var_samp(bench) OVER w END, 4) + 0 AS rolling_beta,
round(CASE WHEN count(ret) OVER w = 10 THEN avg(ret - bench) OVER w * sqrt(252) / stddev_samp(ret - bench) OVER w END, 4) AS rolling_ir
FROM b WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def perf_rolling(spark, sf_dir):
    out = perf.rolling(_benched(spark, sf_dir), "instrument", 10, "bench")
    return rounded(out.select("instrument", "date", "rolling_vol", "rolling_sharpe", "rolling_beta", "rolling_ir"), 4)


WEIGHTS_SQL = DAILY_SQL + f""", weights AS (SELECT instrument, date, close * volume / sum(close * volume) OVER (PARTITION BY date) AS weight, close / lag(close) OVER {W} - 1 AS ret FROM daily)"""


def _weights(spark, sf_dir):
    from pyspark.sql.window import Window

    value = F.col("close") * F.col("volume")
    rows = xs.with_returns(daily(spark, sf_dir))
    return rows.select("instrument", "date", (value / F.sum(value).over(Window.partitionBy("date"))).alias("weight"), "ret")


@query("perf_turnover", f"""WITH {WEIGHTS_SQL}, c AS (SELECT date, abs(weight - lag(weight) OVER {W}) AS c FROM weights), t AS (SELECT date, sum(c) AS t FROM c GROUP BY 1)
SELECT round(avg(t) / 2, 6) AS turnover, count(*) AS n_dates FROM t WHERE t IS NOT NULL""")
def perf_turnover(spark, sf_dir):
    return rounded(perf.turnover(_weights(spark, sf_dir)))


@query("perf_contribution", f"WITH {WEIGHTS_SQL}, c AS (SELECT instrument, lag(weight) OVER {W} * ret AS c FROM weights) SELECT instrument, round(sum(c), 5) AS contribution FROM c GROUP BY 1")
def perf_contribution(spark, sf_dir):
    return rounded(perf.contribution(_weights(spark, sf_dir)), 5)


@query("perf_nav", f"""WITH {DAILY_SQL}, f AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS ticker, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty,
  l_extendedprice / l_quantity AS price, 1.0 AS commission FROM lineitem), flow AS (SELECT date, sum(-qty * price - commission) AS c FROM f GROUP BY 1),
net AS (SELECT ticker, date, sum(qty) AS q FROM f GROUP BY 1, 2),
held AS (SELECT d.instrument, d.date, d.close * sum(coalesce(q, 0)) OVER (PARTITION BY d.instrument ORDER BY d.date) AS v FROM daily d LEFT JOIN net ON net.ticker = d.instrument AND net.date = d.date)
SELECT date, round(1e9 + sum(sum(c)) OVER (ORDER BY date), 2) AS cash, round(any_value(h.v), 2) AS holdings, round(1e9 + sum(sum(c)) OVER (ORDER BY date) + any_value(h.v), 2) AS nav
FROM flow JOIN (SELECT date, sum(v) AS v FROM held GROUP BY 1) h USING (date) GROUP BY date""")
def perf_nav(spark, sf_dir):
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"), F.col("l_suppkey").alias("ticker"), qty.alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.lit(1.0).alias("commission"))
    prices = daily(spark, sf_dir).select(F.col("instrument").alias("ticker"), "date", F.col("close").alias("price"))
    return rounded(perf.nav(fills, prices, 1e9), 2)
