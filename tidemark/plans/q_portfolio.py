"""Covariance, portfolio and execution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import execution as ex
from tidemark.operators import portfolio as pf
from tidemark.plans.datasets import RETURNS_SQL, daily
from tidemark.plans.q_bars import SIGNED_SQL
from tidemark.plans.q_research import _returns, rounded
from tidemark.plans.registry import query, table

X_SQL = """x AS (SELECT vec_id AS t, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def _matrix(spark, sf_dir):
    """t, i, x: every component of every embedding; components are the assets."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("i", "x"))
    return rows.select("t", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


def _cov(spark, sf_dir):
    return pf.covariance(_matrix(spark, sf_dir))


def _exact(value, digits):
    """Rounded as a decimal, so that the last bit of a sum or product can't turn a digit."""
    return F.round(F.col(value).cast("decimal(30,8)"), digits).cast("double").alias(value)


COV_SQL = X_SQL + ", cov AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS value FROM x a JOIN x b USING (t) GROUP BY 1, 2)"


@query("cov_sample", f"WITH {COV_SQL} SELECT i, j, round(value, 6) + 0 AS value FROM cov")
def cov_sample(spark, sf_dir):
    return rounded(_cov(spark, sf_dir))


@query("cov_lw", f"""WITH {X_SQL}, c AS (SELECT t, i, x - avg(x) OVER (PARTITION BY i) AS x FROM x), s AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / count(*) AS v FROM c a JOIN c b USING (t) GROUP BY 1, 2),
k AS (SELECT sum(q * q) AS s4, count(*) AS n FROM (SELECT t, sum(x * x) AS q FROM c GROUP BY 1)), m AS (SELECT count(*) FILTER (WHERE i = j) AS p, sum(v) FILTER (WHERE i = j) / count(*) FILTER (WHERE i = j) AS mu, sum(v * v) AS f FROM s),
d AS (SELECT mu, (f - p * mu * mu) / p AS d2, (s4 / n - f) / (n * p) AS b2 FROM m, k), e AS (SELECT mu, least(b2, d2) / d2 AS delta FROM d)
SELECT s.i, s.j, round(delta * CASE WHEN i = j THEN mu ELSE 0 END + (1 - delta) * v, 6) + 0 AS value, round(delta, 6) AS delta FROM s, e""")
def cov_lw(spark, sf_dir):
    return rounded(pf.ledoit_wolf(_matrix(spark, sf_dir)))


@query("cov_rmt")
def cov_rmt(spark, sf_dir):
    rows = _matrix(spark, sf_dir)
    n_obs = rows.agg(F.count_distinct("t")).first()[0]
    return rounded(pf.denoised(pf.covariance(rows), n_obs))


@query("cov_detone")
def cov_detone(spark, sf_dir):
    return rounded(pf.detoned(_cov(spark, sf_dir)))


@query("pf_hrp")
def pf_hrp(spark, sf_dir):
    return rounded(pf.hrp(_cov(spark, sf_dir)))


@query("pf_nco")
def pf_nco(spark, sf_dir):
    return rounded(pf.nco(_cov(spark, sf_dir)))


@query("pf_clusters")
def pf_clusters(spark, sf_dir):
    return pf.clusters(_cov(spark, sf_dir), 4)


@query("pf_inverse_vol", f"WITH {RETURNS_SQL}, v AS (SELECT instrument, stddev_samp(ret) AS vol FROM returns GROUP BY 1) SELECT instrument, round(vol, 6) AS vol, round((1 / vol) / sum(1 / vol) OVER (), 6) AS weight FROM v")
def pf_inverse_vol(spark, sf_dir):
    vols = _returns(spark, sf_dir).groupBy("instrument").agg(F.stddev_samp("ret").alias("vol"))
    return rounded(pf.inverse_vol(vols))


SIGNALS_SQL = RETURNS_SQL + """, sig AS (SELECT instrument, date, ret AS mu, ret - 0.1 - 0.02 * (instrument % 5) AS lower, ret + 0.1 + 0.02 * (instrument % 5) AS upper FROM returns WHERE ret IS NOT NULL)"""


def _signals(spark, sf_dir):
    half = 0.1 + 0.02 * (F.col("instrument") % 5)
    rows = _returns(spark, sf_dir).filter("ret IS NOT NULL")
    return rows.select("instrument", "date", F.col("ret").alias("mu"), (F.col("ret") - 0.1 - 0.02 * (F.col("instrument") % 5)).alias("lower"), (F.col("ret") + half).alias("upper"))


for _method, _raw in {"equal": "sign(mu)", "signal": "mu", "kelly": "mu / (2 * ((upper - lower) / 2) * ((upper - lower) / 2))", "risk_parity": "sign(mu) / ((upper - lower) / 2)"}.items():

    @query(f"pf_weights_{_method}", f"""WITH {SIGNALS_SQL}, r AS (SELECT *, CASE WHEN lower > 0 OR upper < 0 THEN {_raw} ELSE 0 END AS w FROM sig),
n AS (SELECT *, {'w' if _method == 'kelly' else 'coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY date), 0), 0)'} AS w1 FROM r), c AS (SELECT *, greatest(-0.1, least(0.1, w1)) AS w2 FROM n)
SELECT instrument, date, round(w2 * least(1.0, coalesce(1.0 / nullif(sum(abs(w2)) OVER (PARTITION BY date), 0), 1.0)), 7) AS weight FROM c""")
    def pf_weights(spark, sf_dir, method=_method):
        return rounded(pf.construct(_signals(spark, sf_dir), method).select("instrument", "date", "weight"), 7)


@query("size_kelly", "SELECT event_id, round(greatest(-1.0, least(1.0, 0.5 * (p * 1.5 - (1 - p)) / 1.5)), 6) AS size FROM (SELECT event_id, value / 500 AS p FROM events)")
def size_kelly(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(pf.kelly(F.col("value") / 500, 1.5), 6).alias("size"))


@query("size_vol_target", "SELECT event_id, round(CASE WHEN value > 100 THEN 1.0 * greatest(0.0, least(3.0, 20 / (value - 100))) ELSE 0 END, 6) AS size FROM events")
def size_vol_target(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(pf.vol_target(F.lit(1.0), F.col("value") - 100, 20.0), 6).alias("size"))


@query("size_drawdown", "SELECT event_id, round(greatest(0.0, least(1.0, 1 - (-value / 1000) / -0.2)), 6) AS size FROM events")
def size_drawdown(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(pf.drawdown_scaled(F.lit(1.0), -F.col("value") / 1000), 6).alias("size"))


@query("size_sigmoid")
def size_sigmoid(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(pf.bet_size(F.col("value") / 500, F.lit(1)), 6).alias("size"))


FILLS_SQL = """fills AS (SELECT l_suppkey AS ticker, l_shipdate AS ts, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS seq,
  CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty, l_extendedprice / l_quantity AS price, 1.0 AS commission FROM lineitem)"""


def _fills(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.col("l_shipdate").alias("ts"), F.row_number().over(w).alias("seq"), qty.alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.lit(1.0).alias("commission"))


@query("ex_avg_cost", f"""WITH RECURSIVE {FILLS_SQL}, walk AS (SELECT ticker, seq, qty AS pos, price AS cost, CAST(0 AS DOUBLE) AS pnl, -qty * price - 1.0 AS cash FROM fills WHERE seq = 1
UNION ALL SELECT f.ticker, f.seq, w.pos + f.qty, CASE WHEN w.pos = 0 OR w.pos * f.qty > 0 THEN (w.cost * abs(w.pos) + f.price * abs(f.qty)) / (abs(w.pos) + abs(f.qty)) WHEN abs(f.qty) > abs(w.pos) THEN f.price WHEN w.pos + f.qty = 0 THEN 0 ELSE w.cost END,
  w.pnl + CASE WHEN w.pos * f.qty < 0 THEN (f.price - w.cost) * least(abs(f.qty), abs(w.pos)) * sign(w.pos) ELSE 0 END, w.cash - f.qty * f.price - 1.0 FROM walk w JOIN fills f ON f.ticker = w.ticker AND f.seq = w.seq + 1)
SELECT ticker, CAST(seq AS INTEGER) AS seq, pos AS position, round(cost, 6) AS avg_cost, round(pnl, 2) AS realized, round(cash, 2) AS cash FROM walk""")
def ex_avg_cost(spark, sf_dir):
    out = ex.average_cost(_fills(spark, sf_dir))
    return out.select("ticker", "seq", "position", F.round("avg_cost", 6).alias("avg_cost"), F.round("realized", 2).alias("realized"), F.round("cash", 2).alias("cash"))


def _exact_sql(value, digits):
    return f"CAST(round(CAST({value} AS DECIMAL(30, 8)), {digits}) AS DOUBLE)"


@query("ex_shortfall", f"""WITH f AS (SELECT l_orderkey AS order_id, sum(l_quantity) AS filled, CAST(sum(CAST(l_quantity * (l_extendedprice / l_quantity) AS DECIMAL(28, 8))) AS DOUBLE) AS v, CAST(sum(CAST(l_tax * 10 AS DECIMAL(28, 8))) AS DOUBLE) AS commission FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS order_id, 100.0 AS qty, o_totalprice / 100 AS decision, o_totalprice / 90 AS final FROM orders),
j AS (SELECT o.order_id, qty, decision, final, coalesce(filled, 0) AS filled, v, coalesce(commission, 0) AS commission FROM o LEFT JOIN f USING (order_id))
SELECT order_id, filled, {_exact_sql("v / nullif(filled, 0)", 6)} AS vwap, {_exact_sql("coalesce(v - filled * decision, 0)", 3)} AS impact, {_exact_sql("commission", 4)} AS commission, {_exact_sql("(qty - filled) * (final - decision)", 3)} AS missed,
{_exact_sql("coalesce(v - filled * decision, 0) + commission + (qty - filled) * (final - decision)", 3)} AS total FROM j""")
def ex_shortfall(spark, sf_dir):
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_tax") * 10).alias("commission"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit(100.0).alias("qty"), (F.col("o_totalprice") / 100).alias("decision"), (F.col("o_totalprice") / 90).alias("final"))
    out = ex.shortfall(orders, fills)
    return out.select("order_id", "filled", _exact("vwap", 6), _exact("impact", 3), _exact("commission", 4), _exact("missed", 3), _exact("total", 3))


@query("ex_reconcile", """WITH a AS (SELECT l_suppkey AS ticker, sum(l_quantity) AS q, round(avg(l_tax), 6) AS c FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1),
b AS (SELECT l_suppkey AS ticker, sum(l_quantity) + CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS q, round(avg(l_tax), 6) + CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END AS c FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1)
SELECT * FROM (SELECT coalesce(a.ticker, b.ticker) AS ticker, a.q AS internal_qty, a.c AS internal_cost, b.q AS broker_qty, b.c AS broker_cost,
CASE WHEN a.q IS NULL THEN 'UNKNOWN_TO_INTERNAL' WHEN b.q IS NULL THEN 'UNKNOWN_TO_BROKER' WHEN a.q <> b.q THEN 'QUANTITY' WHEN abs(a.c - b.c) > 0.01 THEN 'COST' END AS kind FROM a FULL JOIN b ON a.ticker = b.ticker) WHERE kind IS NOT NULL""")
def ex_reconcile(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker")).agg(F.sum("l_quantity").alias("qty"), F.round(F.avg("l_tax"), 6).alias("avg_cost"))
    broker = per.filter("ticker % 5 <> 0").select("ticker", (F.col("qty") + F.when(F.col("ticker") % 11 == 0, 1).otherwise(0)).alias("qty"), (F.col("avg_cost") + F.when(F.col("ticker") % 13 == 0, 1).otherwise(0)).alias("avg_cost"))
    return ex.reconcile(per.filter("ticker % 7 <> 0"), broker)


@query("ex_cost_model", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * 2 / 10000.0), 5) AS price, greatest(l_quantity * 0.05, 1.0) AS commission FROM lineitem""")
def ex_cost_model(spark, sf_dir):
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    price, fee = ex.linear_cost(qty, F.col("l_extendedprice"), 2.0, 0.05)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(price, 5).alias("price"), fee.alias("commission"))


ORDERS_SQL = """o AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'MARKET' WHEN 1 THEN 'LIMIT' WHEN 2 THEN 'STOP' ELSE 'STOP_LIMIT' END AS type, CASE WHEN event_id % 2 = 0 THEN 10.0 ELSE -10.0 END AS qty, value AS ref, 60.0 AS lim, 40.0 AS stop FROM events),
k AS (SELECT *, CASE WHEN qty > 0 THEN ref <= lim ELSE ref >= lim END AS lok, CASE WHEN qty > 0 THEN ref >= stop ELSE ref <= stop END AS sok, ref * (1 + sign(qty) * 1 / 10000.0) AS p FROM o),
f AS (SELECT *, CASE type WHEN 'MARKET' THEN true WHEN 'LIMIT' THEN lok WHEN 'STOP' THEN sok ELSE sok AND lok END AS filled FROM k)"""


@query("ex_paper_fills", f"""WITH {ORDERS_SQL} SELECT event_id, type, filled, round(CASE WHEN filled THEN CASE WHEN type IN ('LIMIT', 'STOP_LIMIT') THEN CASE WHEN qty > 0 THEN least(p, lim) ELSE greatest(p, lim) END ELSE p END END, 6) AS fill_price FROM f""")
def ex_paper_fills(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("MARKET", "LIMIT", "STOP", "STOP_LIMIT"))), (F.col("user_id") % 4 + 1).cast("int"))
    orders = table(spark, sf_dir, "events").select("event_id", kind.alias("type"), F.when(F.col("event_id") % 2 == 0, 10.0).otherwise(-10.0).alias("qty"), F.col("value").alias("ref"), F.lit(60.0).alias("limit"), F.lit(40.0).alias("stop"))
    return ex.paper_fills(orders).select("event_id", "type", "filled", F.round("fill_price", 6).alias("fill_price"))


@query("ex_trailing_stop", f"""WITH {SIGNED_SQL}, s AS (SELECT *, max(price) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * (1 - 0.3) AS stop FROM signed)
SELECT instrument, seq, round(stop, 6) AS stop, max(CASE WHEN price <= stop THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) = 1 AS triggered FROM s""")
def ex_trailing_stop(spark, sf_dir):
    from tidemark.operators.bars import ticks_from_events

    out = ex.trailing_stop(ticks_from_events(table(spark, sf_dir, "events")), "instrument", ["ts", "seq"], 0.3)
    return rounded(out.select("instrument", "seq", "stop", "triggered"))


@query("ex_order_fsm", """WITH e AS (SELECT user_id AS order_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'SUBMITTED' WHEN 'signup' THEN 'PARTIAL' WHEN 'purchase' THEN 'FILLED' WHEN 'error' THEN 'REJECTED' ELSE 'CANCELLED' END AS status,
CASE WHEN event_type IN ('signup', 'purchase') THEN CAST(10 AS DOUBLE) END AS fill_qty, CAST(50 AS DOUBLE) AS target FROM events), b AS (SELECT *, coalesce(lag(status) OVER w, 'NEW') AS before, sum(coalesce(fill_qty, 0)) OVER (PARTITION BY order_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS filled FROM e WINDOW w AS (PARTITION BY order_id ORDER BY seq))
SELECT order_id, seq, before, status, filled, ((before = 'NEW' AND status IN ('SUBMITTED', 'REJECTED', 'CANCELLED')) OR (before = 'SUBMITTED' AND status IN ('PARTIAL', 'FILLED', 'CANCELLED', 'REJECTED')) OR (before = 'PARTIAL' AND status IN ('PARTIAL', 'FILLED', 'CANCELLED'))) AND filled <= 50 AS ok FROM b""")
def ex_order_fsm(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "SUBMITTED").when(F.col("event_type") == "signup", "PARTIAL").when(F.col("event_type") == "purchase", "FILLED").when(F.col("event_type") == "error", "REJECTED").otherwise("CANCELLED")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("event_type").isin("signup", "purchase"), 10.0).alias("fill_qty"), F.lit(50.0).alias("target"))
    return ex.order_states(e).select("order_id", "seq", "before", "status", "filled", "ok")


@query("ex_hash_chain")
def ex_hash_chain(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("value"))
    return ex.hash_chain(e, "user_id", ["event_id"], ["event_type", "value", "event_id"])


BOOK_SQL = RETURNS_SQL + """, last AS (SELECT instrument AS ticker, arg_max(close, date) AS price FROM daily GROUP BY 1),
r AS (SELECT ticker % 4 AS book, ticker, price, (ticker % 9 - 4) * 0.02 AS weight, (ticker % 9 - 4) * 0.02 - 0.01 AS lower, (ticker % 9 - 4) * 0.02 + 0.01 AS upper, (ticker % 6) * 10.0 AS held, 1000000.0 AS nav FROM last)"""


def _book(spark, sf_dir):
    last = daily(spark, sf_dir).groupBy(F.col("instrument").alias("ticker")).agg(F.max_by("close", "date").alias("price"))
    mu = (F.col("ticker") % 9 - 4) * 0.02
    return last.select((F.col("ticker") % 4).alias("book"), "ticker", "price", mu.alias("weight"), (mu - 0.01).alias("lower"), (mu + 0.01).alias("upper"), ((F.col("ticker") % 6) * 10.0).alias("held"))


@query("ex_rebalance", f"""WITH {BOOK_SQL}, c AS (SELECT *, greatest(-0.1, least(0.1, CASE WHEN lower > 0 OR upper < 0 THEN weight ELSE 0 END)) AS w FROM r), s AS (SELECT *, w * least(1.0, coalesce(1.0 / nullif(sum(abs(w)) OVER (PARTITION BY book), 0), 1.0)) AS w1 FROM c),
t AS (SELECT *, w1 * least(1.0, coalesce(0.98 / nullif(sum(abs(w1)) OVER (PARTITION BY book), 0), 1.0)) AS w2 FROM s), q AS (SELECT *, round_even(w2 * nav / price - held, 0) AS q FROM t), n AS (SELECT *, CASE WHEN abs(q) * price >= 100 THEN q ELSE 0 END AS q1 FROM q),
u AS (SELECT *, least(1.0, coalesce(0.5 / nullif(sum(abs(q1) * price) OVER (PARTITION BY book) / nav, 0), 1.0)) AS s FROM n), v AS (SELECT *, CASE WHEN s < 1 THEN round_even(q1 * s, 0) ELSE q1 END AS q2 FROM u)
SELECT book, ticker, CASE WHEN abs(q2) * price >= 100 THEN q2 ELSE 0 END AS order_qty FROM v""")
def ex_rebalance(spark, sf_dir):
    rows = _book(spark, sf_dir)
    nav = rows.select("book").distinct().withColumn("nav", F.lit(1000000.0))
    out = ex.rebalance(rows, nav, max_turnover=0.5)
    return out.select("book", "ticker", "order_qty")


@query("ex_risk_gate", f"""WITH {BOOK_SQL}, o AS (SELECT *, CAST((ticker % 13 - 5) * 10 AS DOUBLE) AS qty, 150000.0 AS cash, CASE WHEN ticker % 17 = 0 THEN NULL ELSE 400000.0 END AS adv FROM r),
k AS (SELECT *, abs(qty) * price AS n, CASE WHEN abs(qty) * price > 1000000 THEN 'notional' WHEN abs((held + qty) * price) > 0.2 * nav THEN 'weight' WHEN adv IS NULL OR abs(qty) * price > 0.1 * adv THEN 'participation' END AS reason FROM o),
c AS (SELECT *, cash + sum(CASE WHEN reason IS NULL AND qty < 0 THEN n ELSE 0 END) OVER (PARTITION BY book) - sum(CASE WHEN reason IS NULL AND qty > 0 THEN n ELSE 0 END) OVER (PARTITION BY book ORDER BY n, ticker ROWS UNBOUNDED PRECEDING) AS spare FROM k)
SELECT book, ticker, qty, CASE WHEN reason IS NULL AND qty > 0 AND spare < 0 THEN 'cash' ELSE reason END AS reason FROM c""")
def ex_risk_gate(spark, sf_dir):
    rows = _book(spark, sf_dir).withColumns({"nav": F.lit(1000000.0), "qty": (F.col("ticker") % 13 - 5) * 10.0, "cash": F.lit(150000.0), "adv": F.when(F.col("ticker") % 17 != 0, 400000.0)})
    return ex.risk_gate(rows).select("book", "ticker", "qty", "reason")
