"""Churn formulas, churn drivers, risk bands and anomaly types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions import catalog
from clientlens.functions.expressions import bounded, first_match, rounded


def average_order_value(spend: Column, orders: Column) -> Column:
    return rounded(spend / F.when(orders == 0, 1).otherwise(orders), 2)


def churn_from_rfm(
    recency: Column,
    orders: Column,
    engagement: Column,
    tickets: Column,
    recency_factor: float = 1.0,
) -> Column:
    """Unrounded table formula (PRJ-2), null if an input is; ``recency_factor`` damps the recency term."""
    return (
        0.4 * bounded(recency / 120.0, high=1.0) * recency_factor
        + 0.3 * bounded(1.0 - orders / 20.0, low=0.0)
        + 0.2 * bounded(1.0 - engagement / 100.0, low=0.0)
        + 0.1 * bounded(tickets / 5.0, high=1.0)
    )


def churn_rfm() -> Column:
    """PRJ-2, the default of a customer table without its own churn column."""
    return rounded(
        churn_from_rfm(
            F.col("Recency_Days"), F.col("Frequency_Orders"),
            F.col("Engagement_Score"), F.col("Support_Tickets"),
        ),
        3,
    )


def _behaviour_mix(weights: tuple[float, float, float, float], tickets_at: float, returns_at: float,
                   capped: bool = False) -> Column:
    def part(value: Column, at: float) -> Column:
        return bounded(value / at, high=1.0) if capped else value / at

    engagement = bounded(F.col("Engagement_Score"), high=100.0) if capped else F.col("Engagement_Score")
    raw = (
        weights[0] * part(F.col("Recency_Days"), 365.0)
        + weights[1] * (1.0 - engagement / 100.0)
        + weights[2] * part(F.col("Support_Tickets"), tickets_at)
        + weights[3] * part(F.col("Return_Rate"), returns_at)
    )
    return bounded(raw, 0.0, 1.0)


def churn_generated() -> Column:
    """PRJ-3, the formula of the synthetic source."""
    return rounded(_behaviour_mix((0.45, 0.25, 0.15, 0.15), 15.0, 0.40), 4)


def churn_single() -> Column:
    """PRJ-4, used when new records without a churn column enter the feature matrix."""
    return rounded(_behaviour_mix((0.50, 0.25, 0.15, 0.10), 12.0, 0.30), 4)


def churn_predicted() -> Column:
    """PRJ-5, the churn score returned with a prediction: every factor capped at 1."""
    return rounded(_behaviour_mix((0.45, 0.25, 0.15, 0.15), 15.0, 0.40, capped=True), 3)


def churn_label(df: DataFrame) -> Column:
    """FLT-7: 1 = churned."""
    if "Churn_Risk_Index" in df.columns:
        hit = F.col("Churn_Risk_Index") > 0.35
    else:
        hit = (
            (F.col("Recency_Days") > 30)
            | (F.col("Support_Tickets") >= 2)
            | (F.col("Engagement_Score") < 55)
        )
    return F.when(hit, 1.0).otherwise(0.0)


def risk_band(probability: Column) -> Column:
    """UDF-3: struct(risk_category, badge_color)."""
    *upper, lowest = catalog.RISK_BANDS
    band = lambda name, color: F.struct(
        F.lit(name).alias("risk_category"), F.lit(color).alias("badge_color")
    )
    rules = [(probability >= at, band(name, color)) for at, name, color in upper]
    return first_match(rules, band(lowest[1], lowest[2]))


def anomaly_type(flag: Column) -> Column:
    """UDF-1: name of the pattern behind a flagged row."""
    spend, orders = F.col("Monetary_Spend"), F.col("Frequency_Orders")
    tickets, returns, recency = F.col("Support_Tickets"), F.col("Return_Rate"), F.col("Recency_Days")
    return first_match(
        [
            (~flag, F.lit(catalog.ANOMALY_NORMAL)),
            ((spend > 15000) | ((spend > 8000) & (orders > 40)), F.lit(catalog.ANOMALY_WHALE)),
            ((tickets >= 5) | ((tickets >= 3) & (returns > 0.3)),
             F.lit(catalog.ANOMALY_FRICTION)),
            (returns > 0.35, F.lit(catalog.ANOMALY_RETURNS)),
            ((recency > 180) & (spend > 5000), F.lit(catalog.ANOMALY_DORMANT)),
        ],
        F.lit(catalog.ANOMALY_OTHER),
    )


def churn_drivers(df: DataFrame) -> Column:
    """UDF-2: array of driver structs ordered by impact size, feature order on ties.

    Columns the table lacks count as their baseline. Everything stays inside one row,
    so ranking the eight drivers needs no shuffle.
    """
    drivers = []
    for position, feature in enumerate(catalog.MODEL_FEATURES):
        base, weight = catalog.CHURN_BASELINES[feature], catalog.CHURN_WEIGHTS[feature]
        value = F.col(feature).cast("double") if feature in df.columns else F.lit(base)
        raw = (value - base) / base * weight
        drivers.append(
            F.struct(
                (-F.abs(rounded(raw, 4))).alias("order_key"),
                F.lit(position).alias("position"),
                F.lit(feature).alias("feature"),
                F.lit(feature.replace("_", " ")).alias("display_name"),
                rounded(value, 2).alias("value"),
                F.lit(base).alias("baseline"),
                rounded(raw, 4).alias("impact"),
                F.when(raw > 0, "increases_churn").otherwise("reduces_churn").alias("direction"),
            )
        )
    return F.sort_array(F.array(*drivers))


def with_churn_drivers(df: DataFrame, churn: Column) -> DataFrame:
    """Add ``drivers`` (with importance shares), the two top-3 lists and a sentence."""
    total = F.aggregate(F.col("_d"), F.lit(0.0), lambda acc, d: acc + F.abs(d["impact"]))
    share = lambda d: rounded(F.abs(d["impact"]) / F.col("_t") * 100.0, 1)
    out = (
        df.withColumn("_d", churn_drivers(df))
        .withColumn("_t", total)
        .withColumn("_t", F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t")))
        .withColumn(
            "drivers",
            F.transform(
                "_d",
                lambda d: F.struct(
                    d["feature"].alias("feature"), d["display_name"].alias("display_name"),
                    d["value"].alias("value"), d["baseline"].alias("baseline"),
                    d["impact"].alias("impact"), d["direction"].alias("direction"),
                    share(d).alias("importance_pct"),
                ),
            ),
        )
    )
    top = lambda direction: F.slice(F.filter("drivers", lambda d: d["direction"] == direction), 1, 3)
    out = (
        out.withColumn("overall_churn_risk", rounded(churn, 3))
        .withColumn("top_risk_drivers", top("increases_churn"))
        .withColumn("top_retention_drivers", top("reduces_churn"))
    )
    risk, anchor = F.get("top_risk_drivers", F.lit(0)), F.get("top_retention_drivers", F.lit(0))
    sentence = F.concat(
        F.when(
            F.size("top_risk_drivers") > 0,
            F.concat(F.lit("Main churn risk: "), risk["display_name"], F.lit(" at "),
                     risk["value"].cast("string"), F.lit(". ")),
        ).otherwise("No feature raises churn risk. "),
        F.when(
            F.size("top_retention_drivers") > 0,
            F.concat(F.lit("Main loyalty anchor: "), anchor["display_name"], F.lit(" at "),
                     anchor["value"].cast("string"), F.lit(".")),
        ).otherwise(""),
    )
    return out.withColumn("churn_summary", sentence).drop("_d", "_t")
