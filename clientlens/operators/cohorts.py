"""Retention: modelled curves and heat map, and retention observed in the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientlens.functions import catalog
from clientlens.functions.expressions import bounded, rounded
from clientlens.session import small_table


def retention_curves(persona_rows: DataFrame) -> DataFrame:
    """AGG-19: thirteen-month curve of each segment, shifted by its churn."""
    profiles = small_table(
        persona_rows.sparkSession,
        {"_key": list(catalog.RETENTION_PROFILES), "_base": list(catalog.RETENTION_PROFILES.values())},
    )
    shift = 1.0 - 0.25 * (F.col("avg_churn_risk") - 0.20)
    month = lambda v, i: F.when(i == 0, F.lit(100.0)).otherwise(rounded(bounded(v * shift, 2.0, 100.0), 1))
    return (
        persona_rows.join(profiles, F.col("persona_key") == F.col("_key"), "left")
        .withColumn("retention_curve", F.transform("_base", month))
        .withColumn("m12_retention", F.element_at("retention_curve", -1))
        .select(
            "cluster_id", "persona_key", "persona_title", "color", "customer_count",
            "retention_curve", "m12_retention",
            rounded(100.0 - F.col("m12_retention"), 1).alias("m12_churn_rate"),
        )
    )


def retention_heatmap(df: DataFrame) -> DataFrame:
    """AGG-20: modelled triangle of twelve cohorts; only the row count of ``df`` enters."""
    names = F.array(*[F.lit(c) for c in catalog.HEATMAP_COHORTS])
    decay = F.array(*[F.lit(v) for v in catalog.HEATMAP_DECAY])
    base = df.agg(F.greatest(F.lit(50), F.floor(F.count("*") / 12)).cast("long").alias("_base"))
    cohorts = base.select("_base", F.posexplode(names).alias("cohort_index", "cohort"))
    size = F.floor(F.col("_base") * (1.0 + 0.15 * F.sin("cohort_index"))).cast("long")
    cells = cohorts.select(
        "cohort_index", "cohort", size.alias("initial_size"),
        F.explode(F.sequence(F.lit(0), 12 - F.col("cohort_index"))).alias("month"),
    )
    value = F.element_at(decay, F.col("month") + 1) * (
        1.0 + 0.05 * F.cos(F.col("cohort_index") + F.col("month"))
    )
    return cells.select(
        "cohort_index", "cohort", "initial_size", "month",
        rounded(bounded(value, 5.0, 100.0), 1).alias("retention_pct"),
        (F.col("month") == 12 - F.col("cohort_index")).alias("is_last"),
    )


def observed_retention(orders: DataFrame) -> DataFrame:
    """AGG-21: share of each first-order month's customers who order k months later.

    Each customer's months are collected as a set on the map side, so one shuffle carries
    at most one entry per customer and month, and a customer with most of the orders is
    no larger than any other.
    """
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1
    active = orders.groupBy("o_custkey").agg(F.collect_set(month).alias("_months"))
    steps = active.select(F.array_min("_months").alias("_first"), F.explode("_months").alias("_m"))
    counts = steps.groupBy("_first", (F.col("_m") - F.col("_first")).alias("months_later")).agg(
        F.count("*").alias("active_customers")
    )
    # a cohort has one row per month, so its window is small
    founders = F.max(F.when(F.col("months_later") == 0, F.col("active_customers")))
    sized = counts.withColumn("cohort_size", founders.over(Window.partitionBy("_first")))
    label = F.format_string("%04d-%02d", F.floor(F.col("_first") / 12).cast("int"), F.col("_first") % 12 + 1)
    return sized.select(
        label.alias("cohort"),
        F.col("months_later").cast("int").alias("months_later"),
        "cohort_size",
        "active_customers",
        (F.col("active_customers") / F.col("cohort_size")).alias("retention"),
    )
