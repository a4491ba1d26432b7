"""Segment profiles, persona rules, persona and campaign texts, campaign priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.functions import catalog
from clientlens.functions.expressions import exact_avg, exact_sum, first_match, rounded
from clientlens.operators.ranking import exact_quantiles
from clientlens.session import small_table, stage

RULE_QUANTILES = {
    "Monetary_Spend": [0.70, 0.50],
    "Frequency_Orders": [0.65, 0.50],
    "Recency_Days": [0.40, 0.60],
}

_MEANS = {
    "avg_recency_days": ("Recency_Days", 1),
    "avg_frequency_orders": ("Frequency_Orders", 1),
    "avg_monetary_spend": ("Monetary_Spend", 2),
    "avg_order_value": ("Avg_Order_Value", 2),
    "avg_engagement_score": ("Engagement_Score", 1),
    "avg_discount_ratio": ("Discount_Ratio", 2),
    "avg_churn_risk": ("Churn_Risk_Index", 3),
}


def cluster_profile(df: DataFrame, cluster_col: str) -> DataFrame:
    """One unrounded row per cluster: count, revenue, means, shares of the whole table.

    The cluster rows are written before their totals are taken, so the table is scanned
    once and later joins know how small the profile is.
    """
    grouped = df.groupBy(F.col(cluster_col).cast("int").alias("cluster_id")).agg(
        F.count("*").alias("customer_count"),
        exact_sum(F.col("Monetary_Spend")).alias("total_revenue"),
        *[exact_avg(F.col(source)).alias(name) for name, (source, _) in _MEANS.items()],
    )
    grouped = stage(grouped, "profile")
    totals = grouped.agg(
        F.struct(
            F.sum("customer_count").alias("customers"), exact_sum(F.col("total_revenue")).alias("revenue")
        )
    ).scalar()
    return grouped.withColumn("_t", totals).select(
        "*",
        (F.col("customer_count") / F.col("_t.customers") * 100.0).alias("customer_percentage"),
        (F.try_divide(F.col("total_revenue"), F.col("_t.revenue")) * 100.0).alias("revenue_percentage"),
    ).drop("_t")


def persona_key(q: dict[str, dict[float, float]]) -> Column:
    """AGG-4 on unrounded cluster means, first rule wins; noise has its own texts."""
    spend, orders = F.col("avg_monetary_spend"), F.col("avg_frequency_orders")
    recency, discount = F.col("avg_recency_days"), F.col("avg_discount_ratio")
    m, f, r = q["Monetary_Spend"], q["Frequency_Orders"], q["Recency_Days"]
    return first_match(
        [
            (F.col("cluster_id") == -1, F.lit("GENERAL")),
            ((spend > m[0.70]) & (orders > f[0.65]) & (recency < r[0.40]), F.lit("CHAMPION")),
            ((recency > r[0.60]) & (spend > m[0.50]), F.lit("AT_RISK")),
            (discount > 0.55, F.lit("BARGAIN")),
            ((orders <= 4) & (recency < 40), F.lit("NEW_BUYER")),
            (orders >= f[0.50], F.lit("LOYALIST")),
        ],
        F.lit("GENERAL"),
    )


def persona_texts(spark: SparkSession) -> DataFrame:
    """Default texts by key: title, colour and icon, and the rule that was met."""
    key, title, color, icon = zip(*catalog.PERSONAS)
    rules = [catalog.PERSONA_RULES[k] for k in key]
    return small_table(
        spark,
        {"text_key": list(key), "persona_title": list(title), "tagline": list(title), "description": rules,
         "strategy": [f"plan for {k}" for k in key], "color": list(color), "icon": list(icon)},
    )


def personas(
    df: DataFrame, cluster_col: str = "KMeans_Cluster",
    quantiles: dict[str, dict[float, float]] | None = None, texts: DataFrame | None = None, **limits,
) -> DataFrame:
    """AGG-2/4: profile, persona and texts of every cluster, metrics rounded. ``texts`` has
    the columns of ``persona_texts``, which are the default.

    ``raw_avg_churn_risk`` and ``raw_total_revenue`` stay unrounded for later use.
    """
    q = quantiles or exact_quantiles(df, RULE_QUANTILES, **limits)
    keyed = cluster_profile(df, cluster_col).withColumn("persona_key", persona_key(q))
    text_key = F.when(F.col("cluster_id") == -1, "NOISE").otherwise(F.col("persona_key"))
    joined = keyed.withColumn("_k", text_key).join(
        texts or persona_texts(df.sparkSession), F.col("_k") == F.col("text_key"), "left"
    )
    return joined.select(
        "cluster_id", "persona_key", "persona_title", "tagline", "description", "strategy",
        "color", "icon", "customer_count",
        rounded("customer_percentage", 2).alias("customer_percentage"),
        rounded("total_revenue", 2).alias("total_revenue"),
        rounded("revenue_percentage", 2).alias("revenue_percentage"),
        *[rounded(name, digits).alias(name) for name, (_, digits) in _MEANS.items()],
        F.col("avg_churn_risk").alias("raw_avg_churn_risk"),
        F.col("total_revenue").alias("raw_total_revenue"),
    )


def with_persona(df: DataFrame, persona_rows: DataFrame, cluster_col: str) -> DataFrame:
    """JN-1: persona title and colour on every row, with defaults for unknown clusters."""
    names = stage(
        persona_rows.select(
            F.col("cluster_id").alias("_cluster"), F.col("persona_title").alias("persona"),
            F.col("color").alias("persona_color"),
        ),
        "names",
    )
    return (
        df.join(names, F.col(cluster_col) == F.col("_cluster"), "left")
        .drop("_cluster")
        .withColumn(
            "persona",
            F.coalesce("persona", F.concat(F.lit("Cluster "), F.col(cluster_col).cast("string"))),
        )
        .withColumn("persona_color", F.coalesce("persona_color", F.lit(catalog.DEFAULT_PERSONA_COLOR)))
    )


def campaign_texts(spark: SparkSession) -> DataFrame:
    """Default campaign names and measures by key."""
    keys = catalog.CAMPAIGN_KEYS
    return small_table(
        spark,
        {"_campaign": keys, "recommended_campaign": [f"campaign for {k}" for k in keys],
         "success_metric": [f"response of {k}" for k in keys]},
    )


def with_campaign(df: DataFrame, key: str = "persona_key", texts: DataFrame | None = None) -> DataFrame:
    """JN-2: campaign and success metric by persona; unknown keys take GENERAL. ``texts`` has
    the columns of ``campaign_texts``."""
    known = F.when(F.col(key).isin(catalog.CAMPAIGN_KEYS), F.col(key)).otherwise("GENERAL")
    return (
        df.withColumn("_key", known)
        .join(texts or campaign_texts(df.sparkSession), F.col("_key") == F.col("_campaign"), "left")
        .drop("_key", "_campaign")
    )


COPY_FIELDS = ["email_subject", "email_body", "sms_text", "ad_headline", "ad_description", "call_to_action", "discount_offer"]


def copy_texts(spark: SparkSession) -> DataFrame:
    """Placeholders for the campaign copy of every key, to be replaced by the caller's texts."""
    keys, titles = catalog.COPY_KEYS, {k: t for k, t, *_ in catalog.PERSONAS}
    fields = {name: [f"{{{k}.{name}}}" for k in keys] for name in COPY_FIELDS}
    return small_table(spark, {"_copy": keys, "_title": [titles[k] for k in keys], **fields})


def campaign_copy(
    requests: DataFrame, key: str = "persona_key", title: str | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """Campaign texts for a table of persona keys; unknown keys take LOYALIST, a given
    non-empty title replaces the default one. ``texts`` has the columns of ``copy_texts``."""
    texts = texts or copy_texts(requests.sparkSession)
    known = F.when(F.col(key).isin(catalog.COPY_KEYS), F.col(key)).otherwise("LOYALIST")
    shown = F.col("_title")
    if title is not None:
        shown = F.when(F.coalesce(F.col(title), F.lit("")) != "", F.col(title)).otherwise(shown)
    return (
        requests.withColumn("copy_key", known)
        .join(texts, F.col("copy_key") == F.col("_copy"), "left")
        .withColumn("copy_title", shown)
        .drop("_copy", "_title")
    )


def campaign_priority(persona_rows: DataFrame) -> DataFrame:
    """AGG-9: campaigns by priority, highest first."""
    scored = persona_rows.withColumn(
        "priority_score",
        rounded(
            0.45 * F.col("revenue_percentage")
            + 35.0 * F.col("avg_churn_risk")
            + 0.20 * F.col("customer_percentage"),
            2,
        ),
    ).withColumn(
        "expected_revenue_at_risk",
        rounded(F.col("raw_total_revenue") * F.col("raw_avg_churn_risk"), 2),
    )
    return (
        with_campaign(scored)
        .select(
            "cluster_id", "persona_title", "priority_score", "expected_revenue_at_risk",
            "recommended_campaign", "success_metric",
            F.col("customer_count").alias("estimated_audience"),
        )
        .orderBy(F.col("priority_score").desc(), "cluster_id")
    )
