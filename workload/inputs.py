"""The given tables and a few business-like views of them, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"  # fixed "now" of time-relative queries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with date, place, segment and three measures.

    No join hints: the optimizer broadcasts the small tables by their actual size.
    """
    lineitem = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    buyers = customer.join(places, customer.c_nationkey == places.n_nationkey)
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(buyers, orders.o_custkey == buyers.c_custkey)
        .select(
            F.col("o_orderdate").cast("date").alias("order_date"),
            F.col("r_name").alias("region"),
            F.col("n_name").alias("country"),
            F.col("c_mktsegment").alias("segment"),
            F.col("l_extendedprice").alias("revenue"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
        )
    )


SALES = """sales AS (
  SELECT CAST(o.o_orderdate AS DATE) AS order_date, r.r_name AS region, n.n_name AS country,
         c.c_mktsegment AS segment, l.l_extendedprice AS revenue, l.l_quantity AS quantity, l.l_discount AS discount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def events_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with planted gaps, padding, mixed dates, repeated and empty rows."""
    events = table(spark, sf_dir, "events")
    i = F.col("event_id")
    slashed = F.concat_ws("/", F.month("ts"), F.dayofmonth("ts"), F.year("ts"))
    defects = events.select(
        "event_id",
        F.when(i % 29 == 0, None)
        .when(i % 13 == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")))
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        F.when(i % 11 != 0, F.col("value")).alias("value"),
        F.when(i % 25 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("user_text"),
        F.when(i % 3 == 0, slashed).otherwise(F.col("ts").cast("date").cast("string")).alias("day_text"),
    )
    names = ["event_type", "value", "user_text", "day_text"]
    repeated = defects.filter(i % 50 == 0).select(*names)
    empty = defects.filter(i % 100 == 0).select(*[F.lit(None).cast(defects.schema[n].dataType).alias(n) for n in names])
    return defects.select(*names).unionByName(repeated).unionByName(empty)


EVENTS_DIRTY = """d AS (
  SELECT event_id,
    CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '  ' || event_type || ' ' ELSE event_type END AS event_type,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value,
    CASE WHEN event_id % 25 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS user_text,
    CASE WHEN event_id % 3 = 0 THEN CAST(month(ts) AS VARCHAR) || '/' || CAST(day(ts) AS VARCHAR) || '/' || CAST(year(ts) AS VARCHAR)
         ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS day_text
  FROM events),
events_dirty AS (
  SELECT event_type, value, user_text, day_text FROM d
  UNION ALL SELECT event_type, value, user_text, day_text FROM d WHERE event_id % 50 = 0
  UNION ALL SELECT NULL, NULL, NULL, NULL FROM d WHERE event_id % 100 = 0)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("owner_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at")
    )


ACTIVITY = "activity AS (SELECT event_id AS id, user_id AS owner_id, event_type AS kind, ts AS created_at FROM events)"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("owner_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("bigint")).alias("row_count"),
        F.col("o_orderdate").alias("created_at"),
    )


CATALOG = """catalog AS (
  SELECT o_orderkey AS id, o_custkey AS owner_id, 'order ' || CAST(o_orderkey AS VARCHAR) AS name, o_orderstatus AS status,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS row_count, o_orderdate AS created_at
  FROM orders)"""
