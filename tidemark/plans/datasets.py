"""Market-style views of the driver's tables, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.registry import table

AS_OF = "1998-06-30"

DAILY_SQL = """daily AS (
  SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS date,
         first(px ORDER BY l_orderkey, l_linenumber, l_partkey, px) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY l_orderkey, l_linenumber, l_partkey, px) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) GROUP BY 1, 2)"""

RETURNS_SQL = DAILY_SQL + """, returns AS (
  SELECT instrument, date, close / lag(close) OVER (PARTITION BY instrument ORDER BY date) - 1 AS ret FROM daily)"""

VERSIONS_SQL = """versions AS (
  SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS event_date,
         o_orderdate + CASE WHEN o_orderstatus = 'F' THEN INTERVAL 7 DAY ELSE INTERVAL 0 DAY END AS knowledge_date,
         o_orderkey AS seq, o_totalprice AS value
  FROM orders)"""


def daily(spark, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier: price is the unit price of its shipments."""
    rows = table(spark, sf_dir, "lineitem").withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "px")
    return rows.groupBy(F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("px", at).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", at).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def versions(spark, sf_dir: str) -> DataFrame:
    """Bitemporal rows from orders: one entity per customer, known a week later where the order is finished."""
    late = F.when(F.col("o_orderstatus") == "F", F.expr("INTERVAL 7 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"),
        F.to_date(F.date_trunc("month", "o_orderdate")).alias("event_date"),
        (F.col("o_orderdate") + late).alias("knowledge_date"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("value"),
    )
