"""The star-schema tables and the customer profile derived from them."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """Several tables at once; their schemas are read side by side rather than one after the other."""
    with ThreadPoolExecutor(len(names)) as pool:
        return list(pool.map(lambda name: table(spark, folder, name), names))


def customer_profile(spark: SparkSession, folder: str, snapshot: dt.date = dt.date(2000, 1, 1)) -> DataFrame:
    """One row per customer with an order before the snapshot.

    Features use orders before the snapshot; the label is 1 when no order follows within a year.
    Orders are reduced to one row per customer before any join, and the line items only meet the
    last year's orders.
    """
    customers, nations, regions, orders, lines, parts = tables(
        spark, folder, "customer", "nation", "region", "orders", "lineitem", "part"
    )
    kind = orders.schema["o_orderdate"].dataType

    def moment(months: int) -> Column:
        return F.add_months(F.lit(snapshot), months).cast("timestamp_ntz").cast(kind)

    placed = F.col("o_orderdate")
    past = placed < moment(0)
    recent = past & (placed >= moment(-12))
    ahead = (placed >= moment(0)) & (placed < moment(12))

    history = (
        orders.where(placed < moment(12))
        .groupBy("o_custkey")
        .agg(
            F.min(F.when(past, placed)).alias("first_order"),
            F.max(F.when(past, placed)).alias("last_order"),
            F.sum(F.when(recent, F.col("o_totalprice").cast("decimal(18,2)")).otherwise(F.lit(0))).alias("spend"),
            F.max(F.when(past & (F.col("o_orderpriority") == "1-URGENT"), 1).otherwise(0)).alias("has_urgent"),
            F.count_if(ahead).alias("n_ahead"),
        )
        .where(F.col("first_order").isNotNull())
    )
    products = (
        orders.where(recent)
        .select("o_orderkey", "o_custkey")
        .join(lines.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(parts.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("o_custkey")
        .agg(F.countDistinct("p_type").alias("n_types"))
    )
    places = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return (
        customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(history, F.col("c_custkey") == F.col("o_custkey"))
        .drop("o_custkey")
        .join(products, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("surname"),
            F.col("r_name").alias("geography"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
            (F.lit(snapshot.year) - F.year("first_order")).cast("int").alias("tenure"),
            F.coalesce("n_types", F.lit(0)).cast("int").alias("num_products"),
            F.col("has_urgent").cast("int").alias("has_urgent"),
            F.when(F.col("last_order") >= moment(-6), 1).otherwise(0).alias("is_active_member"),
            F.col("spend").cast("double").alias("est_spend"),
            F.lit(snapshot.year - 1).cast("int").alias("year"),
            F.when(F.col("n_ahead") > 0, 0).otherwise(1).alias("exited"),
        )
    )
