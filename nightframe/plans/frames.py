"""How the test tables stand in for nights, events and groups.

``nights``: one row per order date; the mean price stands for hours of use (``v``), and, joined by date, the mean
shipped quantity for a second measure (``w``). ``log``: the events table with a subject, a time, a type and a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.functions.exprs import exact_mean
from nightframe.operators.events import apnea_events, flow_samples

APNEA = ("error", "click", "purchase")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def usage(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    return orders.agg(F.count(F.lit(1)).alias("n"), (exact_mean("o_totalprice") / 31415.926).alias("v"))


def shipped(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
    return lines.agg(F.avg("l_quantity").alias("w"))


def nights(spark: SparkSession, folder: str) -> DataFrame:
    return usage(spark, folder).join(shipped(spark, folder), "day", "left")


def log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def apneas(spark: SparkSession, folder: str) -> DataFrame:
    return apnea_events(log(spark, folder), "event_type", "ts", "value", ["user_id"], APNEA)


def flow(spark: SparkSession, folder: str) -> DataFrame:
    return flow_samples(log(spark, folder), "event_type", "ts", F.col("value") / 100, ["user_id"], "view")


#: The same tables in DuckDB.
NIGHTS = """
usage_ AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, avg(o_totalprice) / 31415.926::DOUBLE AS v FROM orders GROUP BY 1),
shipped_ AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS w FROM lineitem GROUP BY 1),
nights AS (SELECT u.day, n, v, w FROM usage_ u LEFT JOIN shipped_ s ON u.day = s.day)
"""
EVENTS = """
apneas AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, coalesce(value, 0) AS dur FROM events WHERE event_type IN ('error', 'click', 'purchase')),
flow AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value / 100 AS level FROM events WHERE event_type = 'view')
"""
