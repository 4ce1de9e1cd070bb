"""Conformal and risk queries: predictions of line item prices, class probabilities from embeddings, supplier returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import conformal as cf
from tidemark.operators import crosssection as xs
from tidemark.plans.datasets import RETURNS_SQL, daily
from tidemark.plans.q_research import rounded
from tidemark.plans.registry import query, table

PRED_SQL = """pred AS (SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag AS stratum, l_extendedprice AS y, l_quantity * 1500.0 AS pred, l_quantity AS x, l_discount FROM lineitem),
cal AS (SELECT *, abs(y - pred) AS s FROM pred WHERE id % 2 = 0), test AS (SELECT * FROM pred WHERE id % 2 = 1)"""
K = "least(ceil((count(*) + 1) * 0.9 - 1e-12) + 1, count(*))"
QUANT_SQL = PRED_SQL + f""", r AS (SELECT s, row_number() OVER (ORDER BY s) AS r FROM cal), q0 AS (SELECT s AS q FROM r WHERE r = (SELECT {K} FROM cal)),
rs AS (SELECT stratum, s, row_number() OVER (PARTITION BY stratum ORDER BY s) AS r FROM cal), ks AS (SELECT stratum, {K} AS k, count(*) AS n FROM cal GROUP BY 1), q1 AS (SELECT rs.stratum, s AS q, n FROM rs JOIN ks ON ks.stratum = rs.stratum AND r = k),
iv AS (SELECT test.*, pred - q0.q AS lower, pred + q0.q AS upper FROM test, q0)"""


def _pred(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("stratum"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("pred"), F.col("l_quantity").alias("x"), "l_discount")
    return rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1")


def _intervals(spark, sf_dir, by=None):
    return cf.split_intervals(*_pred(spark, sf_dir), 0.1, by)


@query("cf_split", f"WITH {QUANT_SQL} SELECT id, line, y, round(lower, 4) AS lower, round(upper, 4) AS upper FROM iv")
def cf_split(spark, sf_dir):
    return _intervals(spark, sf_dir).select("id", "line", "y", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


@query("cf_quantile_by_stratum", f"WITH {QUANT_SQL} SELECT stratum, n, round(q, 4) AS q FROM q1")
def cf_quantile_by_stratum(spark, sf_dir):
    cal, _ = _pred(spark, sf_dir)
    return rounded(cf.quantile(cal.withColumn("s", cf.absolute(F.col("y"), F.col("pred"))), "s", 0.1, ["stratum"]), 4)


@query("cf_mondrian", f"""WITH {QUANT_SQL} SELECT id, line, round(pred - coalesce(q1.q, q0.q), 4) AS lower, round(pred + coalesce(q1.q, q0.q), 4) AS upper FROM test LEFT JOIN q1 USING (stratum), q0""")
def cf_mondrian(spark, sf_dir):
    return rounded(_intervals(spark, sf_dir, ["stratum"]).select("id", "line", "lower", "upper"), 4)


@query("cf_cqr_scores", f"WITH {PRED_SQL} SELECT id, line, round(greatest(pred * 0.5 - y, y - pred * 1.5), 4) AS score FROM pred WHERE id % 2 = 0")
def cf_cqr_scores(spark, sf_dir):
    cal, _ = _pred(spark, sf_dir)
    return cal.select("id", "line", F.round(cf.quantile_gap(F.col("y"), F.col("pred") * 0.5, F.col("pred") * 1.5), 4).alias("score"))


@query("cf_metrics", f"""WITH {QUANT_SQL}, m AS (SELECT stratum, count(*) AS n, avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END) AS coverage, avg(upper - lower) AS mean_width, median(upper - lower) AS median_width, stddev_pop(upper - lower) AS std_width,
avg(upper - lower + 20 * (greatest(lower - y, 0) + greatest(y - upper, 0))) AS winkler, avg(greatest(0.05 * (y - lower), (0.05 - 1) * (y - lower))) AS pinball_lower, avg(greatest(0.95 * (y - upper), (0.95 - 1) * (y - upper))) AS pinball_upper FROM iv GROUP BY 1)
SELECT stratum, n, round(coverage, 5) AS coverage, round(mean_width, 3) AS mean_width, round(median_width, 3) AS median_width, round(std_width, 3) AS std_width, round(winkler, 3) AS winkler, round(pinball_lower, 3) AS pinball_lower, round(pinball_upper, 3) AS pinball_upper,
round(mean_width * (1 + CASE WHEN coverage < 0.9 THEN exp(-50 * (coverage - 0.9)) ELSE 0 END), 3) AS cwc FROM m""")
def cf_metrics(spark, sf_dir):
    return rounded(cf.interval_metrics(_intervals(spark, sf_dir), 0.1, ["stratum"]).withColumn("coverage", F.round("coverage", 5)).select("stratum", "n", "coverage", *(F.round(c, 3).alias(c) for c in ("mean_width", "median_width", "std_width", "winkler", "pinball_lower", "pinball_upper", "cwc"))))


@query("cf_cond_coverage", f"""WITH {QUANT_SQL}, e AS (SELECT quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS e FROM iv)
SELECT CAST(len(list_filter(e, lambda v: v < x)) AS INTEGER) AS bin, count(*) AS n, round(avg(CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM iv, e GROUP BY 1""")
def cf_cond_coverage(spark, sf_dir):
    return rounded(cf.conditional_coverage(_intervals(spark, sf_dir), "x", 5))


@query("cf_worst_slab", f"""WITH {QUANT_SQL}, c AS (SELECT stratum, avg(i) OVER w AS c, count(*) OVER w AS n FROM (SELECT *, CASE WHEN y BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END AS i FROM iv)
WINDOW w AS (PARTITION BY stratum ORDER BY x, y, id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT stratum, round(min(CASE WHEN n = 50 THEN c END), 6) AS worst_coverage FROM c GROUP BY 1""")
def cf_worst_slab(spark, sf_dir):
    rows = _intervals(spark, sf_dir).withColumn("tie", F.struct("y", "id"))
    return rounded(cf.worst_slab(rows, "stratum", "x", 50, tie="tie"))


# class probabilities: inverse distances to three fixed corners, from the first three components of the embedding
PROBS_SQL = """w AS (SELECT vec_id, label % 3 AS label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
p AS (SELECT vec_id, CAST(label AS INTEGER) AS label, exp(a * 3) AS ea, exp(b * 3) AS eb, exp(c * 3) AS ec FROM w), n AS (SELECT vec_id, label, [ea / (ea + eb + ec), eb / (ea + eb + ec), ec / (ea + eb + ec)] AS probs FROM p)"""


def _probs(spark, sf_dir):
    e = [F.exp(F.get("embedding", F.lit(i)).cast("double") * 3) for i in range(3)]
    total = e[0] + e[1] + e[2]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("label"), F.array(*(x / total for x in e)).alias("probs"))
    return rows.filter("vec_id % 2 = 0"), rows.filter("vec_id % 2 = 1")


def _sets_sql(score, member):
    return f"""WITH {PROBS_SQL}, s AS (SELECT {score} AS s FROM n WHERE vec_id % 2 = 0), r AS (SELECT s, row_number() OVER (ORDER BY s) AS r FROM s), q AS (SELECT s AS q FROM r WHERE r = (SELECT {K} FROM s)),
t AS (SELECT vec_id, probs, list_filter([0, 1, 2], lambda i: {member}) AS m FROM n, q WHERE vec_id % 2 = 1)
SELECT vec_id, array_to_string(CASE WHEN len(m) > 0 THEN m ELSE [list_position(probs, list_max(probs)) - 1] END, ',') AS members FROM t"""


def _above(own):
    return f"round(coalesce(list_sum(list_filter(probs, lambda p: p > {own})), 0) + {own}, 9)"


@query("cf_lac", _sets_sql("1 - probs[label + 1]", "probs[i + 1] >= 1 - q"))
def cf_lac(spark, sf_dir):
    out = cf.sets(*_probs(spark, sf_dir), 0.1)
    return out.select("vec_id", F.array_join(F.transform("members", lambda i: i.cast("string")), ",").alias("members"))


@query("cf_aps", _sets_sql(_above("probs[label + 1]"), _above("probs[i + 1]") + " <= q"))
def cf_aps(spark, sf_dir):
    out = cf.sets(*_probs(spark, sf_dir), 0.1, method="aps")
    return out.select("vec_id", F.array_join(F.transform("members", lambda i: i.cast("string")), ",").alias("members"))


@query("cf_set_metrics")
def cf_set_metrics(spark, sf_dir):
    return rounded(cf.set_metrics(cf.sets(*_probs(spark, sf_dir), 0.1)))


def _scores(spark, sf_dir):
    return xs.with_returns(daily(spark, sf_dir)).filter("ret IS NOT NULL").select("instrument", "date", "ret", F.abs("ret").alias("score"))


@query("cf_aci")
def cf_aci(spark, sf_dir):
    return rounded(cf.adaptive(_scores(spark, sf_dir), "instrument", ["date"]).select("instrument", "date", "half_width", "alpha_t"))


@query("cf_dtaci")
def cf_dtaci(spark, sf_dir):
    return rounded(cf.adaptive(_scores(spark, sf_dir), "instrument", ["date"], dynamic=True).select("instrument", "date", "half_width", "alpha_t"))


@query("var_hist_es", f"""WITH {RETURNS_SQL}, l AS (SELECT instrument, -ret AS loss FROM returns WHERE ret IS NOT NULL), n AS (SELECT instrument, count(*) AS n FROM l GROUP BY 1),
v AS (SELECT instrument, n, list_sort(list(loss)) AS s, least(ceil((n + 1) * 0.95) / n, 1.0) * (n - 1) AS spot FROM l JOIN n USING (instrument) GROUP BY 1, 2),
q AS (SELECT *, s[CAST(floor(spot) AS INTEGER) + 1] + (spot - floor(spot)) * (s[least(CAST(floor(spot) AS INTEGER) + 2, n)] - s[CAST(floor(spot) AS INTEGER) + 1]) AS var FROM v)
SELECT instrument, n, round(var, 5) AS var, round(CASE WHEN len(list_filter(s, lambda x: x >= var)) < 5 THEN list_max(s) ELSE list_avg(list_filter(s, lambda x: x >= var)) END, 5) AS es FROM q""")
def var_hist_es(spark, sf_dir):
    return rounded(cf.value_at_risk(_scores(spark, sf_dir), "instrument"), 5)


VIOL_SQL = RETURNS_SQL + ", v AS (SELECT instrument, date, ret < -0.3 AS violation FROM returns WHERE ret IS NOT NULL)"


def _violations(spark, sf_dir):
    return _scores(spark, sf_dir).select("instrument", "date", (F.col("ret") < -0.3).alias("violation"))


@query("var_kupiec_lr", f"""WITH {VIOL_SQL}, c AS (SELECT instrument, count(*) AS n, CAST(sum(CASE WHEN violation THEN 1 ELSE 0 END) AS BIGINT) AS x FROM v GROUP BY 1)
SELECT instrument, n, x, round(CASE WHEN x = 0 OR x = n THEN 0 ELSE 2 * (x * ln(x / n) + (n - x) * ln((n - x) / n) - x * ln(0.05) - (n - x) * ln(0.95)) END, 4) AS lr FROM c""")
def var_kupiec_lr(spark, sf_dir):
    return rounded(cf.kupiec(_violations(spark, sf_dir), "instrument", 0.95).drop("p"), 4)


@query("var_christoffersen_lr", f"""WITH {VIOL_SQL}, t AS (SELECT instrument, CAST(violation AS INTEGER) AS b, lag(CAST(violation AS INTEGER)) OVER (PARTITION BY instrument ORDER BY date) AS a FROM v),
c AS (SELECT instrument, count(*) FILTER (WHERE a = 0 AND b = 0) AS n00, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01, count(*) FILTER (WHERE a = 1 AND b = 0) AS n10, count(*) FILTER (WHERE a = 1 AND b = 1) AS n11 FROM t WHERE a IS NOT NULL GROUP BY 1)
SELECT instrument, n00, n01, n10, n11, round(2 * (n00 * ln(n00 / (n00 + n01)) + n01 * ln(n01 / (n00 + n01)) + n10 * ln(n10 / (n10 + n11)) + CASE WHEN n11 > 0 THEN n11 * ln(n11 / (n10 + n11)) ELSE 0 END
- (n00 + n10) * ln((n00 + n10) / (n00 + n01 + n10 + n11)) - (n01 + n11) * ln((n01 + n11) / (n00 + n01 + n10 + n11))), 4) AS lr FROM c""")
def var_christoffersen_lr(spark, sf_dir):
    return rounded(cf.christoffersen(_violations(spark, sf_dir), "instrument", ["date"]).drop("p"), 4)


@query("vol_har", f"""WITH {RETURNS_SQL}, r AS (SELECT instrument, date, ret * ret AS rv FROM returns WHERE ret IS NOT NULL)
SELECT instrument, date, {', '.join(f'round(CASE WHEN count(rv) OVER w{k} = {k} THEN avg(rv) OVER w{k} END, 5) AS rv_{k}' for k in (1, 5, 22))} FROM r
WINDOW {', '.join(f'w{k} AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)' for k in (1, 5, 22))}""")
def vol_har(spark, sf_dir):
    rows = _scores(spark, sf_dir).withColumn("rv", F.col("ret") * F.col("ret"))
    return rounded(cf.har_features(rows, "instrument", ["date"]).select("instrument", "date", "rv_1", "rv_5", "rv_22"), 5)


@query("cf_alpha_signal", f"""WITH {QUANT_SQL} SELECT id, line, round(upper - lower, 4) AS width, round(2 * abs(pred) / (upper - lower), 4) AS strength, lower > 0 OR upper < 0 AS tradeable,
CASE WHEN lower > 0 THEN 1 WHEN upper < 0 THEN -1 ELSE 0 END AS direction FROM iv""")
def cf_alpha_signal(spark, sf_dir):
    rows = _intervals(spark, sf_dir)
    return rounded(rows.select("id", "line", *(c.alias(n) for n, c in cf.alpha_signal(F.col("lower"), F.col("upper"), F.col("pred")).items())), 4)
