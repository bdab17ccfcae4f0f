"""Listing, user, subscription, payment and favourite frames over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorloom.sources.tables import table

SUBSCRIPTIONS_SQL = """SELECT o_orderkey AS id, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'canceled' ELSE 'past_due' END AS status,
  o_orderpriority AS plan, o_orderdate AS starts_at,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS expires_at FROM orders"""
PAYMENTS_SQL = """SELECT o_orderkey AS id, o_custkey AS user_id,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  CAST(o_totalprice AS DECIMAL(12,2)) AS amount, o_orderdate AS paid_at FROM orders"""
FAVORITES_SQL = """SELECT l_suppkey AS user_id, l_partkey AS listing_id, min(l_shipdate) AS created_at
  FROM lineitem GROUP BY 1, 2"""
LISTINGS_SQL = """SELECT p_partkey AS id, lower(p_brand) AS brand, p_name AS model, 1974 + p_size AS year,
  CAST(round(p_retailprice * 1000) AS INT) AS price,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey * 37 % 700000 AS INT) END AS mileage,
  CASE p_type WHEN 'ECONOMY' THEN 'petrol' WHEN 'STANDARD' THEN 'diesel' WHEN 'PROMO' THEN 'electric'
    WHEN 'SMALL' THEN 'hybrid' WHEN 'LARGE' THEN 'gas' ELSE NULL END AS fuel,
  concat('src', CAST(p_partkey % 5 AS VARCHAR)) AS source FROM part"""


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "canceled").otherwise("past_due").alias("status"),
        F.col("o_orderpriority").alias("plan"),
        F.col("o_orderdate").alias("starts_at"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("status"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
        F.col("o_orderdate").alias("paid_at"),
    )


def favorites(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    keys = (F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("listing_id"))
    return items.groupBy(*keys).agg(F.min("l_shipdate").alias("created_at"))


def listings(spark: SparkSession, folder: str) -> DataFrame:
    fuel = F.create_map(*(F.lit(x) for x in ("ECONOMY", "petrol", "STANDARD", "diesel", "PROMO", "electric", "SMALL", "hybrid", "LARGE", "gas")))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.lower("p_brand").alias("brand"),
        F.col("p_name").alias("model"),
        (F.lit(1974) + F.col("p_size")).alias("year"),
        F.round(F.col("p_retailprice") * 1000).cast("int").alias("price"),
        F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") * 37 % 700000).cast("int")).alias("mileage"),
        F.try_element_at(fuel, F.col("p_type")).alias("fuel"),
        F.concat(F.lit("src"), (F.col("p_partkey") % 5).cast("string")).alias("source"),
    )
