"""Queries of the catalog calls, learners, forecasts, states, backtests, signatures and evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import backtest as bt
from tidemark.operators import conformal as cf
from tidemark.operators import crosssection as xs
from tidemark.operators import forecast as fc
from tidemark.operators import learners as ln
from tidemark.operators import pit
from tidemark.operators import research as rs
from tidemark.plans.datasets import DAILY_SQL, RETURNS_SQL, daily
from tidemark.plans.q_bars import TICKS_SQL, _ticks
from tidemark.plans.q_conformal import PRED_SQL, _intervals, _pred
from tidemark.plans.q_labels import SERIES_SQL, _series
from tidemark.plans.q_research import round_half_away, rounded
from tidemark.plans.registry import query, table
from tidemark.sources import store

# --- catalog -------------------------------------------------------------------------------------------------------------


@query("cat_keys", "SELECT DISTINCT l_suppkey AS ticker FROM lineitem")
def cat_keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker")).distinct()


EAV_SQL = """eav AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 'Q' ELSE 'A' END AS freq, o_orderpriority AS metric, o_totalprice AS value FROM orders)"""


def _eav(spark, sf_dir):
    freq = F.when(F.col("o_orderstatus") == "F", "Q").otherwise("A")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"), freq.alias("freq"), F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"))


def _catalog(spark, sf_dir):
    """A catalog over views that are made here instead of read from folders."""
    own = store.Catalog(spark, {})
    own.views = {"income_stmt": _eav(spark, sf_dir), "daily": daily(spark, sf_dir).withColumnRenamed("instrument", "ticker")}
    return own


@query("cat_metrics", f"WITH {EAV_SQL} SELECT DISTINCT metric FROM eav")
def cat_metrics(spark, sf_dir):
    return _catalog(spark, sf_dir).metrics()


@query("cat_income", f"WITH {EAV_SQL} SELECT ticker, date, metric, value FROM eav WHERE ticker IN (1, 2, 4, 7) AND freq = 'Q' AND metric = '1-URGENT'")
def cat_income(spark, sf_dir):
    return _catalog(spark, sf_dir).income([1, 2, 4, 7], "Q", "1-URGENT").select("ticker", "date", "metric", "value")


@query("cat_price_fundamentals", f"""WITH {DAILY_SQL}, {EAV_SQL}, wide AS (SELECT ticker, date, max(value) FILTER (WHERE metric = '1-URGENT') AS urgent, max(value) FILTER (WHERE metric = '2-HIGH') AS high FROM eav WHERE freq = 'Q' GROUP BY 1, 2)
SELECT d.instrument AS ticker, d.date, round(d.close, 4) AS close, w.urgent, w.high FROM daily d ASOF LEFT JOIN wide w ON w.ticker = d.instrument AND w.date <= d.date""")
def cat_price_fundamentals(spark, sf_dir):
    own = _catalog(spark, sf_dir)
    own.views["income_stmt"] = own.views["income_stmt"].withColumn("metric", F.when(F.col("metric") == "1-URGENT", "urgent").when(F.col("metric") == "2-HIGH", "high_"))
    out = own.price_fundamentals(None, ["urgent", "high_"])
    return out.select("ticker", "date", round_half_away("close", 4).alias("close"), "urgent", F.col("high_").alias("high"))


@query("sig_latest", f"WITH {EAV_SQL}, r AS (SELECT * FROM eav WHERE date BETWEEN DATE '1995-01-01' AND DATE '1997-06-30') SELECT ticker, max(date) AS date, count(*) AS n FROM r GROUP BY 1")
def sig_latest(spark, sf_dir):
    rows = _eav(spark, sf_dir)
    last = store.latest_signal(rows, "1997-06-30", "1995-01-01").select("ticker", "date")
    n = rows.filter("date BETWEEN DATE'1995-01-01' AND DATE'1997-06-30'").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return last.join(n, "ticker")


@query("sig_panel_weights", f"""WITH {RETURNS_SQL}, w AS (SELECT instrument AS ticker, arg_max(ret, date) AS weight FROM returns WHERE ret IS NOT NULL AND date <= DATE '1994-06-30' GROUP BY 1)
SELECT k.ticker, round(coalesce(weight, 0), 6) AS weight FROM (SELECT DISTINCT instrument AS ticker FROM daily) k LEFT JOIN w USING (ticker)""")
def sig_panel_weights(spark, sf_dir):
    weights = xs.with_returns(daily(spark, sf_dir)).filter("ret IS NOT NULL").select(F.col("instrument").alias("ticker"), "date", F.col("ret").alias("weight"))
    keys = daily(spark, sf_dir).select(F.col("instrument").alias("ticker")).distinct()
    return rounded(store.panel_weights(weights, keys, "1994-06-30"))


@query("cat_members", "SELECT DISTINCT o_custkey AS ticker FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1996-01-02' AND o_orderstatus <> 'P'")
def cat_members(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date"), (F.col("o_orderstatus") != "P").alias("member"))
    return store.members(rows, F.lit("1996-01-02").cast("date"), member="member")


IDS_SQL = "ids AS (SELECT p_partkey % 50 AS id, p_name AS symbol, DATE '1995-01-01' AS valid_from, CASE WHEN p_size % 2 = 0 THEN DATE '1996-01-01' END AS valid_to FROM part)"


def _ids(spark, sf_dir):
    end = F.when(F.col("p_size") % 2 == 0, F.lit("1996-01-01").cast("date"))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("id"), F.col("p_name").alias("symbol"), F.lit("1995-01-01").cast("date").alias("valid_from"), end.alias("valid_to"))


@query("pit_merge_identities", f"WITH {IDS_SQL} SELECT symbol, DATE '1997-03-01' AS valid_to, CAST(9 AS BIGINT) AS successor FROM ids WHERE id = 7 AND valid_to IS NULL")
def pit_merge_identities(spark, sf_dir):
    return pit.merge_identities(_ids(spark, sf_dir), 7, 9, "1997-03-01", "1997-03-02").select("symbol", "valid_to", "successor")


@query("pit_mint", f"""WITH {IDS_SQL}, k AS (SELECT symbol, min(id) AS id FROM ids GROUP BY 1), n AS (SELECT DISTINCT c_name AS symbol FROM customer)
SELECT (SELECT count(*) FROM n) + (SELECT count(*) FROM k) AS n_symbols, (SELECT count(*) FROM n WHERE symbol NOT IN (SELECT symbol FROM k)) AS n_new, (SELECT max(id) FROM ids) + (SELECT count(*) FROM n WHERE symbol NOT IN (SELECT symbol FROM k)) AS last_id""")
def pit_mint(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("symbol")).unionByName(ids.select("symbol"))
    made = pit.mint(ids, names)
    first = ids.agg(F.max("id").alias("f"))
    return made.crossJoin(F.broadcast(first)).agg(F.count_distinct("symbol").alias("n_symbols"), F.count_distinct(F.when(F.col("id") > F.col("f"), F.col("id"))).alias("n_new"), F.max("id").alias("last_id"))


@query("pit_worst_parity", f"""WITH {DAILY_SQL} SELECT instrument, date, round(abs(close / open - 1), 6) AS off FROM daily WHERE open <> 0 ORDER BY abs(close / open - 1) DESC, instrument, date LIMIT 10""")
def pit_worst_parity(spark, sf_dir):
    panel = daily(spark, sf_dir)
    return rounded(pit.worst_disagreements(panel, panel, ["instrument", "date"], "close", "open").select("instrument", "date", "off"))


@query("xs_wide_panels", "SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS date, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1, 2")
def xs_wide_panels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("asset"), F.to_date("l_shipdate").alias("date"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return rounded(rs.wide_panels(rows, ["discount", "tax"]))


# --- states and orders ---------------------------------------------------------------------------------------------------


@query("ex_trades", """SELECT o_orderkey AS order_id, 100.0 AS qty, coalesce(filled, 0) AS filled, round(v / nullif(filled, 0), 4) AS avg_price, round(coalesce(commission, 0), 6) AS commission FROM orders
LEFT JOIN (SELECT l_orderkey AS order_id, sum(l_quantity) AS filled, sum(l_extendedprice) AS v, sum(l_tax) AS commission FROM lineitem GROUP BY 1) f ON f.order_id = o_orderkey""")
def ex_trades(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.lit(100.0).alias("qty"))
    fills = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_tax").alias("commission"))
    return bt.trades(orders, fills).select("order_id", "qty", "filled", F.round("avg_price", 4).alias("avg_price"), F.round("commission", 6).alias("commission"))


@query("ex_decision_prices", "SELECT user_id AS order_id, arg_min(value, event_id) AS decision FROM events WHERE value IS NOT NULL GROUP BY 1")
def ex_decision_prices(spark, sf_dir):
    return bt.decision_prices(table(spark, sf_dir, "events").select(F.col("user_id").alias("order_id"), F.col("event_id").alias("seq"), F.col("value").alias("ref")))


POS_SQL = "pos AS (SELECT l_suppkey AS ticker, l_suppkey % 4 AS book, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS qty, round(avg(l_extendedprice / l_quantity), 4) AS avg_cost FROM lineitem GROUP BY 1, 2)"


def _positions(spark, sf_dir):
    qty = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("ticker"), (F.col("l_suppkey") % 4).alias("book")).agg(F.sum(qty).alias("qty"), F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("avg_cost"))


@query("ex_max_leverage", f"""WITH {POS_SQL}, g AS (SELECT *, abs(qty) * avg_cost AS gross FROM pos)
SELECT book, ticker, sum(gross) OVER (PARTITION BY book ORDER BY gross, ticker ROWS UNBOUNDED PRECEDING) > 0.5 * 2000000 AS dropped FROM g""")
def ex_max_leverage(spark, sf_dir):
    orders = _positions(spark, sf_dir).withColumns({"held": F.lit(0.0), "price": F.col("avg_cost"), "nav": F.lit(2000000.0)})
    return bt.max_gross_leverage(orders, 0.5).select("book", "ticker", "dropped")


@query("ex_protective_stops", f"""WITH {POS_SQL} SELECT ticker, k AS type, -qty AS qty, CASE WHEN k = 'STOP' THEN round(avg_cost * (1 - sign(qty) * 0.1), 4) END AS stop, CASE WHEN k = 'TRAIL' THEN 0.05 END AS trail
FROM pos, (VALUES ('STOP'), ('TRAIL')) t(k) WHERE qty <> 0""")
def ex_protective_stops(spark, sf_dir):
    out = bt.protective_stops(_positions(spark, sf_dir), 0.1, 0.05)
    return out.withColumn("stop", F.round("stop", 4))


@query("ex_states", f"""WITH RECURSIVE ev AS (SELECT l_suppkey AS ticker, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS seq,
CASE WHEN l_linenumber = 6 THEN 'split' WHEN l_linenumber = 7 THEN 'dividend' ELSE 'fill' END AS kind, l_quantity AS qty, round(l_extendedprice / l_quantity, 2) AS price FROM lineitem),
walk AS (SELECT ticker, CAST(0 AS BIGINT) AS seq, CAST(0 AS DOUBLE) AS pos, CAST(0 AS DOUBLE) AS cost, CAST(0 AS DOUBLE) AS cash FROM (SELECT DISTINCT ticker FROM ev)
UNION ALL SELECT e.ticker, e.seq, CASE e.kind WHEN 'fill' THEN w.pos + e.qty WHEN 'split' THEN w.pos * 2 ELSE w.pos END,
CASE e.kind WHEN 'fill' THEN (w.cost * abs(w.pos) + e.price * abs(e.qty)) / (abs(w.pos) + abs(e.qty)) WHEN 'split' THEN w.cost / 2 ELSE w.cost END,
CASE e.kind WHEN 'fill' THEN w.cash - e.qty * e.price - 1.0 WHEN 'dividend' THEN w.cash + w.pos * 0.5 ELSE w.cash END FROM walk w JOIN ev e ON e.ticker = w.ticker AND e.seq = w.seq + 1)
SELECT ticker, CAST(seq AS INTEGER) AS seq, pos AS position, round(cost, 5) AS avg_cost, round(cash, 2) AS cash FROM walk WHERE seq > 0""")
def ex_states(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    kind = F.when(F.col("l_linenumber") == 6, "split").when(F.col("l_linenumber") == 7, "dividend").otherwise("fill")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"), F.row_number().over(w).alias("seq"), kind.alias("kind"), F.col("l_quantity").alias("qty"),
        round_half_away(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"), F.lit(1.0).alias("commission"), F.lit(2.0).alias("ratio"), F.lit(0.5).alias("per_share"),
    )
    out = bt.states(rows, at=("seq",))
    return out.select("ticker", "seq", "position", round_half_away("avg_cost", 5).alias("avg_cost"), round_half_away("cash", 2).alias("cash"))


@query("ex_recovered", "SELECT user_id AS ticker, round(sum(value), 4) AS qty FROM events GROUP BY 1")
def ex_recovered(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ticker"), F.col("event_id").alias("fill_id"), F.col("event_id").alias("order_id"), F.lit("fill").alias("kind"),
        F.col("value").alias("qty"), F.lit(1.0).alias("price"), F.lit(0.0).alias("commission"), (F.col("event_id") * 2).alias("seq"),
    )
    twice = rows.unionByName(rows.withColumn("seq", F.col("seq") + 1))  # every record was written twice
    return bt.recovered(twice)["positions"].select("ticker", F.round("qty", 4).alias("qty"))


def _targets(spark, sf_dir):
    """Two runs: every ticker equally, and the same with a tilt by the ticker's last digit."""
    last = daily(spark, sf_dir).groupBy(F.col("instrument").alias("ticker")).agg(F.min("date").alias("date"))
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    even = last.select(F.lit("even").alias("run_id"), "date", "ticker", (1.0 / n).alias("weight"))
    return even.unionByName(last.select(F.lit("tilt").alias("run_id"), "date", "ticker", ((F.col("ticker") % 10) / (5.0 * n)).alias("weight")))


def _marks(spark, sf_dir):
    return daily(spark, sf_dir).select("date", F.col("instrument").alias("ticker"), F.col("close").alias("price"))


@query("bt_replay")
def bt_replay(spark, sf_dir):
    return rounded(bt.replay(_marks(spark, sf_dir), _targets(spark, sf_dir), bt.Constraints(min_notional=1000.0, every_day=False)))


@query("bt_report")
def bt_report(spark, sf_dir):
    return rounded(bt.run_backtest(_marks(spark, sf_dir), _targets(spark, sf_dir), bt.Constraints(min_notional=1000.0, every_day=False))["report"])


@query("perf_calmar", f"""WITH {RETURNS_SQL}, r AS (SELECT *, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY instrument ORDER BY date)) AS e FROM returns WHERE ret IS NOT NULL),
d AS (SELECT *, e / greatest(max(e) OVER (PARTITION BY instrument ORDER BY date), 1.0) - 1 AS dd FROM r),
x AS (SELECT instrument, min(dd) AS m, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS a FROM d GROUP BY 1) SELECT instrument, CASE WHEN m < 0 THEN round((a / abs(m)) / (1 + abs(a / abs(m))), 5) END AS calmar FROM x""")
def perf_calmar(spark, sf_dir):
    rows = xs.with_returns(daily(spark, sf_dir)).filter("ret IS NOT NULL")
    out = bt.calmar(rows, "instrument")  # a ratio without bound: compared on a bounded scale
    return out.select("instrument", F.round(F.col("calmar") / (1 + F.abs("calmar")), 5).alias("calmar"))


# --- conformal and risk --------------------------------------------------------------------------------------------------

K2 = "least(ceil((count(*) + 1) * 0.95 - 1e-12) + 1, count(*))"


@query("cf_cqr_asymmetric", f"""WITH {PRED_SQL}, c AS (SELECT pred * 0.8 - y AS b, y - pred * 1.2 AS a FROM pred WHERE id % 2 = 0), k AS (SELECT {K2} AS k FROM c),
qb AS (SELECT b FROM (SELECT b, row_number() OVER (ORDER BY b) AS r FROM c), k WHERE r = k), qa AS (SELECT a FROM (SELECT a, row_number() OVER (ORDER BY a) AS r FROM c), k WHERE r = k)
SELECT id, line, round(pred * 0.8 - b, 4) AS lower, round(pred * 1.2 + a, 4) AS upper FROM test, qb, qa""")
def cf_cqr_asymmetric(spark, sf_dir):
    ends = {"lo": F.col("pred") * 0.8, "hi": F.col("pred") * 1.2}
    cal, test = (x.withColumns(ends) for x in _pred(spark, sf_dir))
    out = fc.conformalized_quantiles(cal, test, 0.1, symmetric=False)
    return out.select("id", "line", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


QUANT = f"q0 AS (SELECT s AS q FROM (SELECT s, row_number() OVER (ORDER BY s) AS r FROM cal) WHERE r = (SELECT {K2.replace('0.95', '0.9')} FROM cal))"


@query("cf_width_tradeoff", f"""WITH {PRED_SQL}, {QUANT}, iv AS (SELECT m AS method, y, pred - q * f AS lower, pred + q * f AS upper FROM test, q0, (VALUES ('half', 0.5), ('whole', 1.0)) t(m, f))
SELECT method, count(*) AS n, round(avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(upper - lower), 3) AS mean_width FROM iv GROUP BY 1""")
def cf_width_tradeoff(spark, sf_dir):
    iv = _intervals(spark, sf_dir)
    mid, half = (F.col("lower") + F.col("upper")) / 2, (F.col("upper") - F.col("lower")) / 2
    both = iv.withColumn("method", F.lit("whole")).unionByName(iv.withColumns({"method": F.lit("half"), "lower": mid - half / 2, "upper": mid + half / 2}))
    out = fc.width_tradeoff(both, 0.1)
    return out.select("method", "n", F.round("coverage", 6).alias("coverage"), F.round("mean_width", 3).alias("mean_width"))


EMB_SQL = """e AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) * 0.5 AS pred FROM embeddings), cal AS (SELECT abs(y - pred) AS s FROM e WHERE id % 2 = 0)"""


@query("cf_efficiency", f"""WITH {EMB_SQL}, {QUANT}, iv AS (SELECT y, pred - q AS l0, pred + q AS u0, pred - q / 2 AS l1, pred + q / 2 AS u1 FROM e, q0 WHERE id % 2 = 1)
SELECT round(avg(u0 - l0), 5) AS width_base, round(avg(u1 - l1), 5) AS width_new, round(avg(u1 - l1) / avg(u0 - l0), 6) AS width_ratio,
round(avg(CASE WHEN y BETWEEN l1 AND u1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN y BETWEEN l0 AND u0 THEN 1.0 ELSE 0.0 END), 6) AS coverage_gain FROM iv""")
def cf_efficiency(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("y"), (F.get("embedding", F.lit(1)).cast("double") * 0.5).alias("pred"))
    base = cf.split_intervals(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), 0.1)
    half = (F.col("upper") - F.col("lower")) / 4
    new = base.withColumns({"lower": F.col("pred") - half, "upper": F.col("pred") + half})
    out = fc.efficiency(base, new)
    return out.select(F.round("width_base", 5).alias("width_base"), F.round("width_new", 5).alias("width_new"), F.round("width_ratio", 6).alias("width_ratio"), F.round("coverage_gain", 6).alias("coverage_gain"))


@query("var_rolling", f"""WITH {RETURNS_SQL}, r AS (SELECT * FROM returns WHERE ret IS NOT NULL),
v AS (SELECT instrument, date, ret, CASE WHEN count(*) OVER w = 20 THEN -quantile_cont(ret, 0.1) OVER w END AS var FROM r WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT instrument, date, round(var, 5) AS var, -ret > var AS violation FROM v""")
def var_rolling(spark, sf_dir):
    rows = xs.with_returns(daily(spark, sf_dir)).filter("ret IS NOT NULL").select("instrument", "date", "ret")
    out = fc.rolling_var(rows, "instrument", ["date"], 0.9, 20, "historical")
    return out.select("instrument", "date", F.round("var", 5).alias("var"), "violation")


@query("cf_walk_forward")
def cf_walk_forward(spark, sf_dir):
    rows = xs.with_returns(daily(spark, sf_dir)).filter("ret IS NOT NULL").withColumn("x", F.lag("ret").over(Window.partitionBy("instrument").orderBy("date")))
    out = fc.walk_forward(rows.select("instrument", "date", "x", F.col("ret").alias("y")), "instrument", ["date"], ["x"], initial=30, refit=10, window=50, embargo=1)
    return rounded(out.select("instrument", "date", "pred", "lower", "upper"))


@query("vol_garch")
def vol_garch(spark, sf_dir):
    rows = xs.with_returns(daily(spark, sf_dir)).filter("ret IS NOT NULL").select("instrument", "date", "ret")
    return rounded(fc.garch_intervals(rows, "instrument", ["date"]))


# --- learners ------------------------------------------------------------------------------------------------------------


@query("lrn_linear", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def lrn_linear(spark, sf_dir):
    model = ln.fit_linear(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(model.intercept, 2), round(model.coef[0], 4))], "intercept double, slope double")


@query("lrn_feature_scores", """WITH l AS (SELECT l_returnflag AS y, f AS feature, CASE f WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END AS v FROM lineitem, (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) t(f)),
p AS (SELECT feature, y, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM l GROUP BY 1, 2), a AS (SELECT feature, sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS g, sum(w) AS w FROM p GROUP BY 1)
SELECT feature, round(sum(p.n * pow(m - g, 2)) * (any_value(nn) - any_value(k)) / (any_value(a.w) * (any_value(k) - 1)), 5) AS f FROM p JOIN a USING (feature) GROUP BY 1""")
def lrn_feature_scores(spark, sf_dir):
    return rounded(ln.feature_scores(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_returnflag"), 5)


def _spanned(spark, sf_dir):
    """Spans of two rows on the users' series, with two inputs and whether the next price is higher."""
    rows = _series(spark, sf_dir)
    w = Window.partitionBy("instrument").orderBy("pos")
    out = rows.withColumns({"x1": F.col("price") - F.lag("price").over(w), "x2": (F.col("pos") % 7).cast("double"), "next": F.lead("price").over(w)})
    out = out.filter("x1 IS NOT NULL AND next IS NOT NULL").withColumns({"t0": F.col("pos"), "t1": F.col("pos") + 1, "y": (F.col("next") > F.col("price")).cast("int")})
    return out.select("instrument", "t0", "t1", "x1", "x2", "y", F.when(F.col("x1") > 0, -1).otherwise(1).alias("side"), (F.col("next") - F.col("price")).alias("ret"))


@query("lrn_cv_score")
def lrn_cv_score(spark, sf_dir):
    return rounded(ln.cv_score(_spanned(spark, sf_dir), ["x1", "x2"], "y", n_splits=3, embargo=0.02))


@query("lrn_meta_label")
def lrn_meta_label(spark, sf_dir):
    rows = _spanned(spark, sf_dir)
    model = ln.MetaLabeler(["x1", "x2"], economic_rationale="prices of a bounded series return to their mean", n_splits=3).fit(rows)
    return rounded(model.predict(rows).select("instrument", "t0", "meta_prob", "position"))


@query("lrn_importance_sfi")
def lrn_importance_sfi(spark, sf_dir):
    return rounded(ln.importance_sfi(_spanned(spark, sf_dir), ["x1", "x2"], "y", n_splits=3))


# --- evaluations and signatures --------------------------------------------------------------------------------------------


@query("st_deflated_windows", f"""WITH {RETURNS_SQL}, r AS (SELECT *, ntile(4) OVER (PARTITION BY instrument ORDER BY date) AS w FROM returns WHERE ret IS NOT NULL), p AS (SELECT instrument, w, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252), 4) AS s FROM r GROUP BY 1, 2)
SELECT instrument, w AS window, s AS sharpe FROM p""")
def st_deflated_windows(spark, sf_dir):
    rows = xs.with_returns(daily(spark, sf_dir)).filter("ret IS NOT NULL")
    out = rs.deflated_evaluation(rows, "instrument", ["date"], n_trials=5)
    return out.select("instrument", F.posexplode("window_sharpes").alias("i", "s")).select("instrument", (F.col("i") + 1).alias("window"), F.round("s", 4).alias("sharpe"))


@query("st_block_length")
def st_block_length(spark, sf_dir):
    return rs.block_length(_series(spark, sf_dir), "instrument", ["pos"], "price", 20)


@query("st_haircuts")
def st_haircuts(spark, sf_dir):
    return rounded(rs.haircuts(xs.with_returns(daily(spark, sf_dir)).filter("ret IS NOT NULL"), ["instrument"], rho=0.1))


@query("bars_calibrated", f"WITH {TICKS_SQL} SELECT instrument, round(sum(price * size) / count(DISTINCT CAST(ts AS DATE)) / 50, 6) AS threshold FROM ticks GROUP BY 1")
def bars_calibrated(spark, sf_dir):
    return rounded(rs.threshold_for(_ticks(spark, sf_dir), "dollar"))


@query("sig_path", f"""WITH {SERIES_SQL}, w AS (SELECT instrument, pos, price - lag(price, 7) OVER (PARTITION BY instrument ORDER BY pos) AS d FROM series)
SELECT instrument, CAST(pos AS INTEGER) AS pos, CASE WHEN d IS NOT NULL THEN 1.0 END AS time, round(d, 5) AS change, CAST(round(CAST(d * d AS DECIMAL(30, 8)), 3) AS DOUBLE) AS squared FROM w""")
def sig_path(spark, sf_dir):
    out = rs.path_signatures(_series(spark, sf_dir), "instrument", ["pos"], ["price"], window=8, depth=2, how=("addtime",))
    return out.select("instrument", "pos", F.round("sig_1", 6).alias("time"), F.round("sig_2", 5).alias("change"), F.round(F.col("sig_2_2").cast("decimal(30,8)"), 3).cast("double").alias("squared"))


@query("brk_analysis")
def brk_analysis(spark, sf_dir):
    return rounded(rs.break_analysis(_series(spark, sf_dir), "instrument", ["pos"], "price"))


@query("cov_benchmark")
def cov_benchmark(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("i", "x"))
    return rounded(rs.covariance_benchmark(rows, 3))

