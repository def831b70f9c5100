"""Mutation logs over the test tables: key, sequence, batch_id, tombstone, value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' latest properties; an error event deletes. About 67 versions a key; batches of 100."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        (F.col("event_id") + 1).alias("sequence"),
        F.expr("event_id div 100").alias("batch_id"),
        gone.alias("tombstone"),
        F.when(gone, "").otherwise(F.col("props")).alias("value"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' latest order priority; a pending order deletes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    gone = F.col("o_orderstatus") == "P"
    return o.select(
        F.concat(F.lit("cust:"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("key"),
        (F.col("o_orderkey") + 1).alias("sequence"),
        F.expr("o_orderkey div 100").alias("batch_id"),
        gone.alias("tombstone"),
        F.when(gone, "").otherwise(F.col("o_orderpriority")).alias("value"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version a key, whose key is stored, so that key predicates reach the scan."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_name").alias("key"), (F.col("c_custkey") + 1).alias("sequence"), F.lit(False).alias("tombstone"), F.col("c_mktsegment").alias("value"))


#: The same logs for DuckDB.
SQL = """
l1 AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id + 1 AS sequence, event_id // 100 AS batch_id,
              event_type = 'error' AS tombstone, CASE WHEN event_type = 'error' THEN '' ELSE props END AS value FROM events),
l2 AS (SELECT 'cust:' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS key, o_orderkey + 1 AS sequence, o_orderkey // 100 AS batch_id,
              o_orderstatus = 'P' AS tombstone, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS value FROM orders)
"""
