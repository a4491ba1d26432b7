"""The customer table, derived from order, line, event and customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.functions.churn import average_order_value, churn_rfm
from clientlens.functions.expressions import bounded


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_history(orders: DataFrame) -> DataFrame:
    """Per customer: last and first order date, order count, spend. Partial sums run
    before the shuffle, so one customer with most of the orders costs one row per task."""
    return orders.groupBy(F.col("o_custkey").alias("_cust")).agg(
        F.max("o_orderdate").alias("last_order"),
        F.min("o_orderdate").alias("first_order"),
        F.count("*").alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spend"),
    )


def line_behaviour(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    """Per customer: brands bought, share of discounted and of returned lines.

    Lines first collapse to (customer, brand) counts on the map side. Join strategies are
    left to the optimizer, which broadcasts by size and splits skewed keys at run time.
    """
    lines = (
        lineitem.select("l_orderkey", "l_partkey", "l_discount", "l_returnflag")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    )
    by_brand = lines.groupBy(F.col("o_custkey").alias("_cust"), "p_brand").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("l_discount") >= 0.05).alias("n_discounted"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
    )
    return by_brand.groupBy("_cust").agg(
        F.count("p_brand").alias("brands"),
        (F.sum("n_discounted") / F.sum("n")).alias("discount_share"),
        (F.sum("n_returned") / F.sum("n")).alias("return_share"),
    )


def event_behaviour(events: DataFrame) -> DataFrame:
    """Per user: share of engaged events and number of error events."""
    return events.groupBy(F.col("user_id").alias("_cust")).agg(
        (100.0 * F.count_if(F.col("event_type").isin("view", "click", "purchase")) / F.count("*"))
        .alias("engagement"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )


def customer_table(spark: SparkSession, folder: str, money_scale: float = 500.0) -> DataFrame:
    """One row per customer with at least one order, in the canonical schema.

    Recency counts from the day after the latest order in the table.
    """
    orders = table(spark, folder, "orders")
    as_of = orders.agg(F.max("o_orderdate")).scalar()
    history = order_history(orders)
    lines = line_behaviour(table(spark, folder, "lineitem"), orders, table(spark, folder, "part"))
    behaviour = event_behaviour(table(spark, folder, "events"))
    places = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("r_name").alias("Region"))
    )
    whole = lambda value, low, high: bounded(value, float(low), float(high)).cast("int")
    wide = (
        table(spark, folder, "customer")
        .join(history, F.col("c_custkey") == history["_cust"])
        .drop("_cust")
        .join(lines, F.col("c_custkey") == lines["_cust"], "left")
        .drop("_cust")
        .join(behaviour, F.col("c_custkey") == behaviour["_cust"], "left")
        .drop("_cust")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    )
    days = F.date_diff(as_of.cast("date"), F.col("last_order").cast("date")) + 1
    canonical = wide.select(
        F.col("c_custkey").alias("Customer_ID"),
        whole(days, 1, 365).alias("Recency_Days"),
        whole(F.col("n_orders"), 1, 200).alias("Frequency_Orders"),
        F.greatest(F.col("spend").cast("double") / money_scale, F.lit(1.0)).alias("Monetary_Spend"),
        whole(F.coalesce(F.floor(F.col("brands") / 3.0), F.lit(3)), 1, 10).alias("Category_Diversity"),
        F.coalesce("engagement", F.lit(50.0)).alias("Engagement_Score"),
        whole(F.coalesce(F.floor(F.col("errors") / 5.0), F.lit(1)), 0, 20).alias("Support_Tickets"),
        F.coalesce("discount_share", F.lit(0.15)).alias("Discount_Ratio"),
        F.least(F.coalesce("return_share", F.lit(0.05)), F.lit(0.5)).alias("Return_Rate"),
        F.col("c_mktsegment").alias("Preferred_Channel"),
        F.lit("Unknown").alias("Gender"),
        F.lit(35).alias("Age"),
        F.col("Region"),
        F.date_format("first_order", "yyyy-MM").alias("First_Order_Month"),
    )
    return canonical.withColumn(
        "Avg_Order_Value", average_order_value(F.col("Monetary_Spend"), F.col("Frequency_Orders"))
    ).withColumn("Churn_Risk_Index", churn_rfm())
