"""Change logs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.sources.schema import DEL, PURGE, PUT


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change for each event; errors delete or purge, signups put an empty value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    revision = F.col("event_id") + 1
    error = F.col("event_type") == "error"
    key = F.concat(F.lit("user."), F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit("."), (F.col("event_id") % 7).cast("string"))
    op = F.when(error & (F.col("event_id") % 10 == 0), PURGE).when(error, DEL).otherwise(PUT)
    value = F.when(~error, F.when(F.col("event_type") == "signup", F.lit("")).otherwise(F.col("props"))).cast("binary")
    return e.select(revision.alias("revision"), key.alias("key"), op.alias("op"), value.alias("value"), F.lit(None).cast("binary").alias("version"), revision.alias("arrival"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One change for each order; open orders delete the customer's key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    revision = F.col("o_orderkey") + 1
    key = F.concat(F.lit("cust."), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))
    op = F.when(F.col("o_orderstatus") == "O", DEL).otherwise(PUT)
    value = F.when(op == PUT, F.col("o_orderpriority")).cast("binary")
    return o.select(revision.alias("revision"), key.alias("key"), op.alias("op"), value.alias("value"), F.lit(None).cast("binary").alias("version"), revision.alias("arrival"))
