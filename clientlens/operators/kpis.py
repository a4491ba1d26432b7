"""Overview figures, filters, top lists and projections on the customer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions import catalog
from clientlens.functions.expressions import all_of, exact_avg, exact_sum, rounded
from clientlens.operators.ranking import exact_quantiles
from clientlens.session import small_table


def overview(df: DataFrame, cluster_col: str = "KMeans_Cluster") -> DataFrame:
    """AGG-1: one row of headline figures; noise is not a cluster."""
    label = F.col(cluster_col)
    return df.agg(
        F.count("*").alias("total_customers"),
        rounded(exact_sum(F.col("Monetary_Spend")), 2).alias("total_revenue"),
        rounded(exact_avg(F.col("Monetary_Spend")), 2).alias("avg_spend_per_customer"),
        rounded(exact_avg(F.col("Recency_Days")), 1).alias("avg_recency_days"),
        rounded(exact_avg(F.col("Frequency_Orders")), 1).alias("avg_frequency_orders"),
        rounded(exact_avg(F.col("Churn_Risk_Index")), 3).alias("avg_churn_risk"),
        F.countDistinct(F.when(label != -1, label)).alias("optimal_clusters_count"),
    )


def high_risk_customers(df: DataFrame, cluster_col: str = "KMeans_Cluster", limit: int = 25) -> DataFrame:
    """TOP-1: highest churn first, then spend, then id; 1 to 100 rows may be asked for."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return (
        df.orderBy(F.col("Churn_Risk_Index").desc(), F.col("Monetary_Spend").desc(), "Customer_ID")
        .limit(limit)
        .select(
            F.col("Customer_ID").alias("customer_id"),
            F.col(cluster_col).cast("int").alias("cluster"),
            rounded("Churn_Risk_Index", 3).alias("churn_risk_index"),
            rounded("Monetary_Spend", 2).alias("monetary_spend"),
            F.col("Recency_Days").alias("recency_days"),
            F.col("Frequency_Orders").alias("frequency_orders"),
            F.lit("contact").alias("recommended_action"),
        )
    )


def cohort_condition(target: str, median_spend: float | None = None) -> Column:
    """FLT-1 predicate of a target cohort."""
    churn = F.col("Churn_Risk_Index")
    return {
        "at_risk": churn >= 0.50,
        "high_value_risk": (churn >= 0.40) & (F.col("Monetary_Spend") >= F.lit(median_spend)),
        "lost": F.col("Recency_Days") >= 90,
    }.get(target, F.lit(True))


def cohort_conditions(df: DataFrame, targets: list[str], **limits) -> dict[str, Column]:
    """The predicates of several targets; a target nobody meets takes all rows.

    One pass counts every audience. The median is looked up only when a target needs it.
    """
    median = None
    if "high_value_risk" in targets:
        median = exact_quantiles(df, {"Monetary_Spend": [0.5]}, **limits)["Monetary_Spend"][0.5]
    conditions = {t: cohort_condition(t, median) for t in dict.fromkeys(targets)}
    sizes = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(conditions.values())]).first()
    return {
        t: c if sizes[f"n{i}"] else F.lit(True) for i, (t, c) in enumerate(conditions.items())
    }


def target_cohort(df: DataFrame, target: str, **limits) -> DataFrame:
    """FLT-1: the rows a campaign would address."""
    return df.where(cohort_conditions(df, [target], **limits)[target])


def micro_segment(
    df: DataFrame, persona: str | None = None, max_churn_pct: float = 100.0,
    min_spend: float = 0.0, max_recency: int = 365,
) -> DataFrame:
    """FLT-2 on a table with a ``persona`` column."""
    conditions = [
        F.col("Churn_Risk_Index") * 100.0 <= max_churn_pct,
        F.col("Monetary_Spend") >= min_spend,
        F.col("Recency_Days") <= max_recency,
    ]
    if persona:
        conditions.append(F.col("persona") == persona)
    return df.where(all_of(conditions))


def without_noise(df: DataFrame, label_col: str) -> DataFrame:
    """FLT-3."""
    return df.where(F.col(label_col) != -1)


def distinct_labels(df: DataFrame, label_col: str) -> DataFrame:
    """SET-2: cluster labels in use, noise left out."""
    return without_noise(df.select(label_col), label_col).distinct()


def convert_money(df: DataFrame, columns: list[str], currency_col: str) -> DataFrame:
    """PRJ-7: money columns in each row's currency; unknown currencies keep the amount."""
    rates = small_table(
        df.sparkSession,
        {"_currency": list(catalog.CURRENCY_RATES), "_rate": list(catalog.CURRENCY_RATES.values())},
    )
    joined = df.join(rates, F.col(currency_col) == F.col("_currency"), "left")
    rate = F.coalesce("_rate", F.lit(1.0))
    return joined.withColumns({c: F.col(c) * rate for c in columns}).drop("_currency", "_rate")


def alert_candidates(df: DataFrame, churn_col: str = "Churn_Risk_Index", flag_col: str = "Is_Anomaly") -> DataFrame:
    """FLT-5: rows that raise an alert, with the kind of alert."""
    churn, flag = F.col(churn_col) > 0.70, F.coalesce(F.col(flag_col), F.lit(False))
    return df.where(churn | flag).withColumn(
        "alert_type", F.when(churn, catalog.ALERT_CHURN).otherwise(catalog.ALERT_ANOMALY)
    )
