"""Canonical inputs built from the star-schema tables: raw facts are aggregated to periods first.

Each builder has its DuckDB twin as CTEs that end in a relation of the same name. ``t`` is a day number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import realised
from riskweave.operators.series import returns_from_prices


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _day(unit: str, column: str):
    return F.unix_date(F.to_date(F.date_trunc(unit, column))).cast("bigint")


def prices_li(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("series"), _day(unit, "l_shipdate").alias("t")).agg(F.avg("l_extendedprice").alias("px"))


def panel_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly returns of the mean extended price by return flag."""
    return returns_from_prices(prices_li(spark, sf_dir))


def prices_ord(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), _day(unit, "o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("px"))


def panel_ord_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly returns of the mean order price by priority."""
    return returns_from_prices(prices_ord(spark, sf_dir))


def panel_ord_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return returns_from_prices(prices_ord(spark, sf_dir, "week"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of event values by type."""
    e = read(spark, sf_dir, "events").where("value > 0")
    ticks = e.select(F.col("event_type").alias("series"), _day("day", "ts").alias("t"), F.col("value").alias("price"), "ts", "event_id")
    return realised.bars_from_ticks(ticks, ["ts", "event_id"])


def obligors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: probability from the share of their orders in status F, exposure from the key."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"))
    return o.select(F.col("o_custkey").alias("obligor"), (F.lit(0.2) * F.col("f") / F.col("n") + 0.01).alias("probability"), (F.pmod(F.col("o_custkey"), F.lit(20)) + 1).cast("double").alias("exposure"))


#: Trailing-window forecasts at 97.5 %: multiples of a 26-period deviation.
WINDOW, VAR_K, ES_K = 26, 1.96, 2.34


def forecasts(spark: SparkSession, sf_dir: str, window: int = WINDOW) -> DataFrame:
    """(series, t, r, var, es): forecasts from the periods before each return."""
    from riskweave.operators.frames import by_time

    w = by_time().rowsBetween(-window, -1)
    p = panel_li(spark, sf_dir)
    rows = p.withColumn("sd", F.stddev_samp("r").over(w)).withColumn("k", F.row_number().over(by_time())).where(F.col("k") > window)
    return rows.select("series", "t", "r", (VAR_K * F.col("sd")).alias("var"), (ES_K * F.col("sd")).alias("es"))


def _px_sql(name: str, table: str, key: str, unit: str, date: str, price: str) -> str:
    return f"""px AS (SELECT {key} AS series, date_diff('day', DATE '1970-01-01', CAST(date_trunc('{unit}', {date}) AS DATE)) AS t, avg({price}) AS px FROM {table} GROUP BY 1, 2),
{name} AS (SELECT series, t, r FROM (SELECT series, t, px / lag(px) OVER (PARTITION BY series ORDER BY t) - 1 AS r FROM px) WHERE r IS NOT NULL)"""


PANEL_LI = _px_sql("panel", "lineitem", "l_returnflag", "week", "l_shipdate", "l_extendedprice")
PANEL_ORD_M = _px_sql("panel", "orders", "o_orderpriority", "month", "o_orderdate", "o_totalprice")
#: Only the months that every priority has.
PANEL_ORD_A = _px_sql("loose", "orders", "o_orderpriority", "month", "o_orderdate", "o_totalprice") + """,
panel AS (SELECT * FROM loose WHERE t IN (SELECT t FROM loose GROUP BY t HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM loose)))"""
PANEL_ORD_W = _px_sql("panel", "orders", "o_orderpriority", "week", "o_orderdate", "o_totalprice")
BARS = """bars AS (SELECT event_type AS series, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS t, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close
FROM events WHERE value > 0 GROUP BY 1, 2)"""
OBLIGORS = """obligors AS (SELECT o_custkey AS obligor, 0.2 * CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) + 0.01 AS probability, CAST(o_custkey % 20 + 1 AS DOUBLE) AS exposure FROM orders GROUP BY o_custkey)"""


def forecasts_sql(window: int = WINDOW, name: str = "forecasts") -> str:
    return f"""{name} AS (SELECT series, t, r, {VAR_K}::DOUBLE * sd AS var, {ES_K}::DOUBLE * sd AS es FROM (
SELECT series, t, r, stddev_samp(r) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) AS sd, row_number() OVER (PARTITION BY series ORDER BY t) AS k FROM panel) WHERE k > {window})"""
