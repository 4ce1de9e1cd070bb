"""Entropy, fractional differencing and structural-break queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import kernels
from tidemark.operators import entropy as en
from tidemark.plans.q_labels import SERIES_SQL, _series
from tidemark.plans.q_research import rounded
from tidemark.plans.registry import query, table


def _h(cols, source="documents", alias="h"):
    return f"SELECT {cols}, count(*) AS c FROM {source} GROUP BY ALL"


@query("info_shannon", f"""WITH c AS ({_h('source, lang')}), p AS (SELECT *, c / sum(c) OVER (PARTITION BY source) AS p FROM c),
h AS (SELECT source, count(*) AS n_symbols, -sum(p * ln(p)) / ln(2) AS entropy FROM p GROUP BY 1)
SELECT source, n_symbols, round(entropy, 6) AS entropy, round(ln(n_symbols) / ln(2), 6) AS max_entropy, round(CASE WHEN n_symbols > 1 THEN entropy / (ln(n_symbols) / ln(2)) ELSE 0 END, 6) AS normalized FROM h""")
def info_shannon(spark, sf_dir):
    return rounded(en.shannon(table(spark, sf_dir, "documents"), ["source"], "lang"))


@query("info_mutual", """WITH t AS (SELECT user_id % 10 AS g, event_type AS x, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS y FROM events),
xy AS (SELECT g, x, y, count(*) AS c FROM t GROUP BY ALL), px AS (SELECT g, x, sum(c) AS c FROM xy GROUP BY ALL), py AS (SELECT g, y, sum(c) AS c FROM xy GROUP BY ALL),
hxy AS (SELECT g, -sum(p * ln(p)) / ln(2) AS h FROM (SELECT g, c / sum(c) OVER (PARTITION BY g) AS p FROM xy) GROUP BY 1), hx AS (SELECT g, -sum(p * ln(p)) / ln(2) AS h FROM (SELECT g, c / sum(c) OVER (PARTITION BY g) AS p FROM px) GROUP BY 1),
hy AS (SELECT g, -sum(p * ln(p)) / ln(2) AS h FROM (SELECT g, c / sum(c) OVER (PARTITION BY g) AS p FROM py) GROUP BY 1)
SELECT g, round(hxy.h, 5) AS h_xy, round(hx.h, 5) AS h_x, round(hy.h, 5) AS h_y, round(hxy.h - hy.h, 5) AS conditional, round(hx.h + hy.h - hxy.h, 5) AS mutual, round((hx.h + hy.h - hxy.h) / least(hx.h, hy.h), 5) AS normalized_mutual
FROM hxy JOIN hx USING (g) JOIN hy USING (g)""")
def info_mutual(spark, sf_dir):
    t = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("g"), F.col("event_type").alias("x"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("y"))
    return rounded(en.joint(t, ["g"], "x", "y"), 5)


SYMBOL_SQL = SERIES_SQL + ", sym AS (SELECT *, CASE WHEN price > lag(price) OVER (PARTITION BY instrument ORDER BY pos) THEN '1' ELSE '0' END AS symbol FROM series)"


def _symbols(spark, sf_dir):
    from pyspark.sql.window import Window

    change = F.col("price") - F.coalesce(F.lag("price").over(Window.partitionBy("instrument").orderBy("pos")), F.col("price"))
    return _series(spark, sf_dir).withColumn("symbol", en.encode_binary(change))


@query("info_rolling", f"""WITH {SYMBOL_SQL}, p AS (SELECT instrument, pos, count(*) OVER w AS n, avg(CASE WHEN symbol = '1' THEN 1.0 ELSE 0.0 END) OVER w AS p FROM sym WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT instrument, CAST(pos AS INTEGER) AS pos, round(CASE WHEN n = 10 THEN CASE WHEN p IN (0, 1) THEN 0 ELSE -(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2) END END, 5) AS entropy FROM p""")
def info_rolling(spark, sf_dir):
    out = en.rolling_entropy(_symbols(spark, sf_dir), "instrument", ["pos"], "symbol", 10).select("instrument", "pos", "entropy")
    return rounded(out.withColumn("entropy", F.col("entropy") + 0.0), 5)


@query("info_complexity")
def info_complexity(spark, sf_dir):
    return rounded(en.sequence_complexity(_symbols(spark, sf_dir), "instrument", ["pos"], "symbol"))


@query("info_quantile_symbols", f"""WITH {SERIES_SQL}, e AS (SELECT instrument, quantile_cont(price, [0.25, 0.5, 0.75]) AS e FROM series GROUP BY 1)
SELECT s.instrument, CAST(pos AS INTEGER) AS pos, CAST(len(list_filter(e, lambda x: x < price)) AS VARCHAR) AS symbol FROM series s JOIN e USING (instrument)""")
def info_quantile_symbols(spark, sf_dir):
    return en.encode_quantile(_series(spark, sf_dir), "price", 4, ["instrument"]).select("instrument", "pos", "symbol")


_FFD = kernels.ffd_weights(0.4, 0.02)[::-1].tolist()


@query("ffd", f"""WITH {SERIES_SQL} SELECT instrument, CAST(pos AS INTEGER) AS pos, round({' + '.join(f'{w!r} * lag(price, {k}) OVER w' for k, w in enumerate(_FFD))}, 5) AS ffd
FROM series WINDOW w AS (PARTITION BY instrument ORDER BY pos)""")
def ffd(spark, sf_dir):
    return rounded(en.frac_diff(_series(spark, sf_dir), "instrument", ["pos"], "price", 0.4, 0.02).select("instrument", "pos", "ffd"), 5)


def _rss(cond):
    return f"(regr_syy(price, pos) FILTER (WHERE {cond}) - coalesce(pow(regr_sxy(price, pos) FILTER (WHERE {cond}), 2) / nullif(regr_sxx(price, pos) FILTER (WHERE {cond}), 0), 0))"


@query("brk_chow_f", f"""WITH {SERIES_SQL}, r AS (SELECT instrument, count(*) AS n, {_rss('true')} AS a, {_rss('pos < 20')} AS b, {_rss('pos >= 20')} AS c, count(*) FILTER (WHERE pos < 20) AS na FROM series GROUP BY 1)
SELECT instrument, n, round(CASE WHEN na > 2 AND n - na > 2 THEN ((a - b - c) / 2) / ((b + c) / (n - 4)) END, 4) AS chow_f FROM r""")
def brk_chow_f(spark, sf_dir):
    return rounded(en.chow(_series(spark, sf_dir), "instrument", "pos", "price", 20).drop("p"), 4)


@query("brk_cusum", f"""WITH {SERIES_SQL}, b AS (SELECT instrument, pos, price, count(price) OVER w AS k, avg(price) OVER w AS m, stddev_samp(price) OVER w AS s FROM series WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT instrument, CAST(pos AS INTEGER) AS pos, round(sum(CASE WHEN k >= 10 AND s > 0 THEN (price - m) / (s * sqrt(1 + 1.0 / k)) END) OVER (PARTITION BY instrument ORDER BY pos), 4) AS cusum FROM b""")
def brk_cusum(spark, sf_dir):
    return rounded(en.recursive_cusum(_series(spark, sf_dir), "instrument", "pos", "price"), 4)


@query("brk_adf")
def brk_adf(spark, sf_dir):
    return rounded(en.adf(_series(spark, sf_dir), "instrument", ["pos"], "price"))


@query("brk_sadf")
def brk_sadf(spark, sf_dir):
    return rounded(en.bubbles(_series(spark, sf_dir), "instrument", ["pos"], "price", expanding=True))


@query("brk_gsadf")
def brk_gsadf(spark, sf_dir):
    return rounded(en.bubbles(_series(spark, sf_dir), "instrument", ["pos"], "price"))


@query("brk_episodes", f"""WITH {SERIES_SQL}, u AS (SELECT *, CASE WHEN price > 60 THEN 1 ELSE 0 END AS up FROM series), n AS (SELECT *, CASE WHEN up = 1 AND coalesce(lag(up) OVER (PARTITION BY instrument ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS fresh FROM u),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY instrument ORDER BY pos) AS ep FROM n)
SELECT instrument, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) AS INTEGER) AS "end", max(price) AS peak, count(*) AS duration FROM e WHERE up = 1 GROUP BY instrument, ep HAVING count(*) >= 2""")
def brk_episodes(spark, sf_dir):
    return en.episodes(_series(spark, sf_dir), "instrument", 60.0, value="price")


@query("info_regime", f"""WITH {SYMBOL_SQL}, p AS (SELECT instrument, pos, count(*) OVER w AS n, avg(CASE WHEN symbol = '1' THEN 1.0 ELSE 0.0 END) OVER w AS p FROM sym WINDOW w AS (PARTITION BY instrument ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
h AS (SELECT instrument, pos, CASE WHEN n = 10 THEN round(CASE WHEN p IN (0, 1) THEN 0 ELSE -(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2) END, 9) END AS h FROM p),
x AS (SELECT instrument, pos, (h - min(h) OVER (PARTITION BY instrument)) / nullif(max(h) OVER (PARTITION BY instrument) - min(h) OVER (PARTITION BY instrument), 0) AS x FROM h)
SELECT instrument, CAST(pos AS INTEGER) AS pos, CASE WHEN x < 0.3 THEN 'mean_revert' WHEN x > 0.7 THEN 'random' WHEN x IS NOT NULL THEN 'trending' END AS regime FROM x""")
def info_regime(spark, sf_dir):
    out = en.rolling_entropy(_symbols(spark, sf_dir), "instrument", ["pos"], "symbol", 10).withColumn("entropy", F.round(F.col("entropy") + 0.0, 9))
    return en.entropy_regime(out, "instrument").select("instrument", "pos", "regime")


@query("info_causal_symbols", f"""WITH {SERIES_SQL}, h AS (SELECT *, list(price) OVER (PARTITION BY instrument ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM series)
SELECT instrument, CAST(pos AS INTEGER) AS pos, CASE WHEN len(h) >= 20 THEN CAST(least(len(list_filter(h, lambda x: x < price)) * 4 // len(h), 3) AS VARCHAR) END AS symbol FROM h""")
def info_causal_symbols(spark, sf_dir):
    return en.encode_quantile_causal(_series(spark, sf_dir), "instrument", ["pos"], "price", 4, 20).select("instrument", "pos", "symbol")
