"""What-if comparison of retention scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.functions.churn import churn_from_rfm
from clientlens.functions.expressions import bounded, exact_sum, rounded
from clientlens.operators.kpis import cohort_conditions


@dataclass(frozen=True)
class Scenario:
    name: str = "default"
    engagement_boost_pct: float = 15.0
    ticket_reduction: float = 2.0
    discount_incentive_pct: float = 10.0
    email_touchpoints: int = 2
    target_cohort: str = "all"


def compare_scenarios(df: DataFrame, scenarios: list[Scenario], **limits) -> DataFrame:
    """AGG-18: one row per scenario, all from a single aggregation pass.

    Each scenario is a set of conditional sums, so the customer rows are neither copied
    nor joined. Products are summed as decimals to be independent of partitioning.
    """
    audience = cohort_conditions(df, [s.target_cohort for s in scenarios], **limits)
    churn, spend = F.col("Churn_Risk_Index"), F.col("Monetary_Spend")
    sums = []
    for i, s in enumerate(scenarios):
        inside = audience[s.target_cohort]
        part = lambda value: F.when(inside, value)
        damping = 1.0 - max(0.0, min(0.20, s.email_touchpoints * 0.05))
        after = rounded(
            bounded(
                churn_from_rfm(
                    F.col("Recency_Days"),
                    F.col("Frequency_Orders"),
                    bounded(F.col("Engagement_Score") * (1.0 + s.engagement_boost_pct / 100.0), high=100.0),
                    bounded(F.col("Support_Tickets") - s.ticket_reduction, low=0.0),
                    damping,
                ),
                0.0,
                1.0,
            ),
            3,
        )
        sums += [
            F.count_if(inside).alias(f"n{i}"),
            exact_sum(part(spend)).alias(f"spend{i}"),
            exact_sum(part(churn)).alias(f"churn{i}"),
            exact_sum(part(after)).alias(f"after{i}"),
            F.count_if(inside & (churn >= 0.50)).alias(f"high{i}"),
            F.count_if(inside & (after >= 0.50)).alias(f"left{i}"),
            exact_sum(part(spend * churn), 8).alias(f"risk{i}"),
            exact_sum(part(spend * after), 8).alias(f"rest{i}"),
        ]
    wide = df.agg(*sums)
    rows = []
    for i, s in enumerate(scenarios):
        c = lambda name: F.col(f"{name}{i}")
        recovered = c("risk") - c("rest")
        unit_cost = c("spend") / c("n") * (s.discount_incentive_pct / 100.0) + s.email_touchpoints * 0.50
        cost = c("n") * unit_cost
        rows.append(
            F.struct(
                F.lit(s.name).alias("scenario"),
                F.lit(s.target_cohort).alias("target_cohort"),
                c("n").alias("target_audience_count"),
                rounded(c("churn") / c("n"), 3).alias("initial_avg_churn"),
                rounded(c("after") / c("n"), 3).alias("simulated_avg_churn"),
                rounded((c("churn") / c("n") - c("after") / c("n")) * 100.0, 1).alias("churn_reduction_pct"),
                c("high").alias("initial_high_risk_count"),
                c("left").alias("simulated_high_risk_count"),
                F.greatest(F.lit(0).cast("long"), c("high") - c("left")).alias("rescued_customers"),
                rounded(F.greatest(F.lit(0.0), recovered), 2).alias("recovered_revenue"),
                rounded(cost, 2).alias("total_campaign_cost"),
                rounded(recovered - cost, 2).alias("net_value_generated"),
                F.when(cost > 0, rounded(F.try_divide(recovered, cost), 2)).otherwise(0.0).alias("roi_factor"),
                F.lit(float(s.engagement_boost_pct)).alias("engagement_boost_pct"),
                F.lit(float(s.ticket_reduction)).alias("ticket_reduction"),
                F.lit(float(s.discount_incentive_pct)).alias("discount_incentive_pct"),
                F.lit(s.email_touchpoints).alias("email_touchpoints"),
            )
        )
    return wide.select(F.inline(F.array(*rows)))
