"""Catalog and point-in-time queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.plans.datasets import AS_OF, DAILY_SQL, VERSIONS_SQL, daily, versions
from tidemark.plans.registry import query, table
from tidemark.sources import catalog

KNOWN_SQL = VERSIONS_SQL + f""", known AS (
  SELECT entity, event_date, knowledge_date, seq, value FROM (
    SELECT *, row_number() OVER (PARTITION BY entity, event_date ORDER BY knowledge_date DESC, seq DESC) AS rn
    FROM versions WHERE knowledge_date <= TIMESTAMP '{AS_OF}') WHERE rn = 1)"""

EAV = ["quantity", "discount", "tax"]
EAV_SQL = """wide AS (
  SELECT l_orderkey AS id, l_linenumber AS line, max(l_quantity) AS quantity, max(l_discount) AS discount, max(l_tax) AS tax
  FROM lineitem GROUP BY 1, 2)"""


def _wide(spark, sf_dir):
    cols = [F.max(f"l_{m}").alias(m) for m in EAV]
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line")).agg(*cols)


@query("cat_daily_scan", f"""WITH {DAILY_SQL} SELECT instrument, date, close FROM daily
WHERE instrument IN (1, 2, 3) AND date >= DATE '1997-01-01' AND date <= DATE '1998-12-31'""")
def cat_daily_scan(spark, sf_dir):
    return catalog.scan(daily(spark, sf_dir), [1, 2, 3], "1997-01-01", "1998-12-31", ["instrument", "date", "close"], key="instrument")


@query("cat_eav_unpivot", f"""WITH {EAV_SQL}
SELECT id, line, 'quantity' AS metric, quantity AS value FROM wide UNION ALL
SELECT id, line, 'discount', discount FROM wide UNION ALL SELECT id, line, 'tax', tax FROM wide""")
def cat_eav_unpivot(spark, sf_dir):
    return catalog.lengthen(_wide(spark, sf_dir), ["id", "line"], EAV)


@query("cat_eav_pivot", f"WITH {EAV_SQL} SELECT id, line, quantity, discount, tax FROM wide")
def cat_eav_pivot(spark, sf_dir):
    return catalog.widen(catalog.lengthen(_wide(spark, sf_dir), ["id", "line"], EAV), ["id", "line"], EAV)


@query("cat_view_summary", f"""WITH {DAILY_SQL} SELECT 'daily' AS view, count(DISTINCT instrument) AS n_keys, count(*) AS n_rows,
min(date) AS first_date, max(date) AS last_date FROM daily""")
def cat_view_summary(spark, sf_dir):
    return catalog.summary(daily(spark, sf_dir), "daily", "instrument", "date")


@query("cat_date_range", f"WITH {DAILY_SQL} SELECT instrument, min(date) AS first_date, max(date) AS last_date FROM daily GROUP BY 1")
def cat_date_range(spark, sf_dir):
    return daily(spark, sf_dir).groupBy("instrument").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("cat_quality_report", f"""WITH {DAILY_SQL}, r AS (SELECT instrument, count(*) AS n_rows,
  CAST(sum(CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null,
  CAST(sum(CASE WHEN close <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad_close, CAST(sum(CASE WHEN high < low THEN 1 ELSE 0 END) AS BIGINT) AS n_crossed,
  CAST(sum(CASE WHEN volume = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_no_volume, count(*) - count(DISTINCT date) AS n_double,
  min(date) AS first_date, max(date) AS last_date FROM daily GROUP BY 1) SELECT *, '' AS issues FROM r""")
def cat_quality_report(spark, sf_dir):
    return catalog.quality_report(daily(spark, sf_dir))


@query("cat_left_equi_join", """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders
ON c_custkey = o_custkey AND CAST(o_orderdate AS DATE) = DATE '1998-06-15'""")
def cat_left_equi_join(spark, sf_dir):
    day = table(spark, sf_dir, "orders").filter(F.to_date("o_orderdate") == F.lit("1998-06-15").cast("date"))
    return table(spark, sf_dir, "customer").join(day, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("cat_symbology_json", """SELECT CAST(n_nationkey AS VARCHAR) AS instrument, n_name AS symbol, DATE '1996-01-01' AS valid_from, DATE '1998-01-01' AS valid_to
FROM nation WHERE n_regionkey <> 2""")
def cat_symbology_json(spark, sf_dir):
    symbol = F.when(F.col("n_regionkey") == 2, F.lit("None")).otherwise(F.col("n_name"))
    span = F.struct(F.lit("1996-01-01").alias("d0"), F.lit("1998-01-01").alias("d1"), symbol.alias("s"))
    payload = F.to_json(F.create_map(F.col("n_nationkey").cast("string"), F.array(span)))
    return catalog.symbology(table(spark, sf_dir, "nation").select(payload.alias("payload")))


@query("pit_as_of", f"WITH {KNOWN_SQL} SELECT entity, event_date, knowledge_date, seq, value FROM known")
def pit_as_of(spark, sf_dir):
    return pit.as_of(versions(spark, sf_dir), ["entity"], AS_OF)


@query("pit_watermark", f"WITH {VERSIONS_SQL} SELECT coalesce(max(CASE WHEN knowledge_date <= TIMESTAMP '{AS_OF}' THEN seq END), -1) AS watermark FROM versions")
def pit_watermark(spark, sf_dir):
    return pit.watermark(versions(spark, sf_dir), AS_OF)


@query("pit_asof_join_snapshot", f"""WITH {KNOWN_SQL} SELECT c_custkey AS entity, c_mktsegment, event_date AS event_date_r, knowledge_date AS knowledge_date_r,
seq AS seq_r, value AS value_r FROM customer LEFT JOIN known ON c_custkey IS NOT DISTINCT FROM entity""")
def pit_asof_join_snapshot(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    return pit.snapshot_join(left, versions(spark, sf_dir), ["entity"], AS_OF)


@query("pit_asof_join_event_time", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts AS seen, value FROM events WHERE event_type = 'view')
SELECT l.event_id, l.user_id, l.ts, r.value, r.seen AS seen_matched FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.seen""")
def pit_asof_join_event_time(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), "value")
    return pit.asof_join(left, right, ["user_id"], "ts", "seen", ["value"])


@query("pit_latest_per_key", f"""WITH {DAILY_SQL} SELECT instrument, max(date) AS date, arg_max(close, date) AS close FROM daily
WHERE date <= DATE '{AS_OF}' AND close > 0 GROUP BY 1""")
def pit_latest_per_key(spark, sf_dir):
    return pit.latest_valid(daily(spark, sf_dir), AS_OF)


IDS_SQL = """ids AS (SELECT p_brand AS symbol, p_partkey AS id, DATE '1995-01-01' + CAST(p_size * 30 AS INTEGER) AS valid_from,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(p_size * 30 + 200 AS INTEGER) END AS valid_to FROM part)"""


def _ids(spark, sf_dir):
    start = F.expr("date_add(DATE'1995-01-01', p_size * 30)")
    end = F.when(F.col("p_size") % 5 != 0, F.expr("date_add(DATE'1995-01-01', p_size * 30 + 200)"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("id"), start.alias("valid_from"), end.alias("valid_to"))


@query("pit_interval_resolve", f"""WITH {IDS_SQL}, s AS (SELECT DISTINCT p_brand AS symbol FROM part)
SELECT s.symbol, min(id) AS id FROM s LEFT JOIN ids ON s.symbol = ids.symbol AND valid_from <= DATE '1996-03-01' AND (valid_to IS NULL OR valid_to > DATE '1996-03-01') GROUP BY 1""")
def pit_interval_resolve(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    return pit.resolve(ids, ids.select("symbol").distinct(), "1996-03-01")


@query("pit_identifier_overlaps", f"""WITH {IDS_SQL}, w AS (SELECT *, lead(valid_from) OVER (PARTITION BY symbol ORDER BY valid_from, id) AS next_from FROM ids)
SELECT symbol, id, valid_from, valid_to, next_from FROM w WHERE next_from IS NOT NULL AND (valid_to IS NULL OR valid_to > next_from)""")
def pit_identifier_overlaps(spark, sf_dir):
    return pit.identifier_overlaps(_ids(spark, sf_dir))


@query("pit_quarantine_anti", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1")
def pit_quarantine_anti(spark, sf_dir):
    mapping = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    _, out = pit.mapped_and_quarantined(table(spark, sf_dir, "lineitem"), mapping, "l_partkey")
    return out.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("pit_cross_vendor_parity", f"""WITH {DAILY_SQL} SELECT count(*) AS n_compared, round(avg(CASE WHEN abs(open / close - 1) > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS disagreement_rate
FROM daily WHERE open IS NOT NULL AND close IS NOT NULL AND close <> 0""")
def pit_cross_vendor_parity(spark, sf_dir):
    d = daily(spark, sf_dir)
    out = pit.vendor_parity(d, d, ["instrument", "date"], "open", "close", True, 0.05)
    return out.withColumn("disagreement_rate", F.round("disagreement_rate", 6))


RATIOS = ", ".join(f"({i}, {r})" for i, r in enumerate(pit.SPLIT_RATIOS))
SPLITS_SQL = DAILY_SQL + f""", g AS (SELECT *, lag(close) OVER w / open AS gap,
  median(volume) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m
  FROM daily WINDOW w AS (PARTITION BY instrument ORDER BY date)),
c AS (SELECT instrument, date, arg_min(CASE WHEN abs(gap / r - 1) <= 0.025 AND coalesce(volume >= 0.3 * r * m, true) THEN r ELSE 1 / r END, i) AS split_ratio
  FROM g, (VALUES {RATIOS}) AS t(i, r)
  WHERE abs(close / open - 1) <= 0.2 AND ((abs(gap / r - 1) <= 0.025 AND coalesce(volume >= 0.3 * r * m, true)) OR abs(gap * r - 1) <= 0.025) GROUP BY 1, 2),
split AS (SELECT daily.*, split_ratio FROM daily LEFT JOIN c USING (instrument, date))"""


@query("pit_split_detect", f"WITH {SPLITS_SQL} SELECT instrument, date, round(split_ratio, 6) AS split_ratio FROM split WHERE split_ratio IS NOT NULL")
def pit_split_detect(spark, sf_dir):
    found = pit.detect_splits(daily(spark, sf_dir)).filter("split_ratio IS NOT NULL")
    return found.select("instrument", "date", F.round("split_ratio", 6).alias("split_ratio"))


EVERY_QUARTER_SQL = DAILY_SQL + """, split AS (SELECT *, CASE WHEN dayofmonth(date) = 15 AND month(date) % 3 = 0 THEN 1.5 END AS split_ratio FROM daily)"""


def _every_quarter(spark, sf_dir):
    on = (F.dayofmonth("date") == 15) & (F.month("date") % 3 == 0)
    return daily(spark, sf_dir).withColumn("split_ratio", F.when(on, F.lit(1.5)))


@query("pit_split_adjust", f"""WITH {EVERY_QUARTER_SQL}, a AS (SELECT *, coalesce(product(coalesce(split_ratio, 1)) OVER (PARTITION BY instrument ORDER BY date
ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS adj_factor FROM split) SELECT instrument, date, adj_factor, CAST(round(CAST(close / adj_factor AS DECIMAL(30, 8)), 4) AS DOUBLE) AS adj_close FROM a""")
def pit_split_adjust(spark, sf_dir):
    return pit.adjust_splits(_every_quarter(spark, sf_dir)).select("instrument", "date", "adj_factor", F.round(F.col("adj_close").cast("decimal(30,8)"), 4).cast("double").alias("adj_close"))


@query("pit_adjusted_prices", f"""WITH {KNOWN_SQL}, s AS (SELECT DISTINCT entity, event_date AS ex FROM known WHERE month(event_date) = 6)
SELECT k.entity, k.event_date, round(k.value * coalesce(product(1 / 2.0) FILTER (WHERE s.ex IS NOT NULL), 1), 6) AS adj_value
FROM known k LEFT JOIN s ON s.entity = k.entity AND s.ex > k.event_date GROUP BY k.entity, k.event_date, k.value""")
def pit_adjusted_prices(spark, sf_dir):
    rows = versions(spark, sf_dir)
    actions = rows.filter("month(event_date) = 6").withColumns({"type": F.lit("split"), "raw_factor": F.lit(2.0)})
    out = pit.adjusted_prices(rows, actions, AS_OF, price="value")
    return out.select("entity", "event_date", F.round("adj_value", 6).alias("adj_value"))


@query("pit_residual_rate", f"""WITH {EVERY_QUARTER_SQL}, r AS (SELECT close / lag(close) OVER (PARTITION BY instrument ORDER BY date) - 1 AS r FROM split)
SELECT round(avg(CASE WHEN abs(r) > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS residual_rate, count(*) AS n_returns FROM r WHERE r IS NOT NULL""")
def pit_residual_rate(spark, sf_dir):
    return pit.residual_rate(daily(spark, sf_dir), "close").withColumn("residual_rate", F.round("residual_rate", 6))


@query("pit_delistings", f"""WITH {DAILY_SQL} SELECT instrument, min(date) AS first_date, max(date) AS last_date, count(*) AS n_days,
max(date) < (SELECT max(date) FROM daily) - 2 AS delisted FROM daily GROUP BY 1""")
def pit_delistings(spark, sf_dir):
    return pit.delistings(daily(spark, sf_dir), gap_days=2)


@query("pit_liquidity_universe", f"""WITH {DAILY_SQL}, k AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM daily WHERE date < DATE '{AS_OF}'))
SELECT instrument, round(median(close * volume), 4) AS median_dollar_volume FROM daily JOIN k USING (date) WHERE k BETWEEN 6 AND 131
GROUP BY 1 ORDER BY median(close * volume) DESC, instrument LIMIT 20""")
def pit_liquidity_universe(spark, sf_dir):
    out = pit.liquidity_universe(daily(spark, sf_dir), AS_OF, 20)
    return out.withColumn("median_dollar_volume", F.round("median_dollar_volume", 4))


@query("pit_panel_report", f"""WITH {DAILY_SQL} SELECT count(DISTINCT instrument) AS n_instruments, count(*) AS n_rows, bool_and(open > 0 AND high > 0 AND low > 0 AND close > 0) AS all_positive,
bool_and(high >= low) AS high_above_low, count(*) = count(DISTINCT (instrument, date)) AS unique_key, min(date) AS first_date, max(date) AS last_date FROM daily""")
def pit_panel_report(spark, sf_dir):
    return pit.panel_report(daily(spark, sf_dir))
