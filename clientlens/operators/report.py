"""The executive report: one row per fact, with its section, key, value and a plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions.expressions import exact_sum

TOP_CAMPAIGNS = 5


def executive_report(
    persona_rows: DataFrame, campaigns: DataFrame, anomaly_counts: DataFrame, run_facts: dict[str, Column]
) -> DataFrame:
    """SNK-8: (line_no, section, key, value, text), text being ``section.key = value``.

    ``run_facts`` are text columns without inputs (literals or scalar subqueries), such as
    source, training time, models, k, best benchmark and stability, in the order they are
    to appear. Segments follow as rows of their own, numbered by cluster, then the campaigns
    of highest priority. Reads segment-level rows only.
    """
    number = lambda c, digits: F.format_string(f"%.{digits}f", c)
    fact = lambda section, place, key, value: F.struct(
        F.lit(section).alias("part"), F.lit(place).alias("place"), F.lit(key).alias("key"), value.cast("string").alias("value")
    )
    totals = persona_rows.agg(
        F.sum("customer_count").alias("customers"),
        exact_sum(F.col("raw_total_revenue")).alias("revenue"),
        F.count("*").alias("segments"),
        F.max_by("cluster_id", F.struct("total_revenue", -F.col("cluster_id"))).alias("rich"),
        F.max_by("cluster_id", F.struct("avg_churn_risk", -F.col("cluster_id"))).alias("risky"),
    ).withColumn("out", anomaly_counts.select(F.struct("count", "percentage")).scalar())
    run = [fact(0, i, key, value) for i, (key, value) in enumerate(run_facts.items())]
    head = totals.select(F.inline(F.array(
        *run,
        fact(1, 0, "customers", F.col("customers")), fact(1, 1, "segments", F.col("segments")),
        fact(1, 2, "revenue", number(F.col("revenue"), 2)),
        fact(1, 3, "spend_per_customer", number(F.col("revenue") / F.col("customers"), 2)),
        fact(1, 4, "outliers", F.col("out")["count"]), fact(1, 5, "outlier_percentage", number(F.col("out")["percentage"], 2)),
        fact(1, 6, "top_revenue_cluster", F.col("rich")), fact(1, 7, "top_churn_cluster", F.col("risky")),
    ))).withColumn("sub", F.lit(0))
    each = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    segments = persona_rows.select(
        F.lit(2).alias("part"), F.col("cluster_id").alias("place"), F.posexplode(F.array(
            each("persona", F.col("persona_title")), each("customers", F.col("customer_count")),
            each("revenue", number(F.col("total_revenue"), 2)), each("churn", number(F.col("avg_churn_risk"), 3)),
        )).alias("sub", "f"),
    ).select("part", "place", F.concat_ws(".", F.col("place").cast("string"), "f.key").alias("key"), "f.value", "sub")
    best = campaigns.orderBy(F.col("priority_score").desc(), "cluster_id").limit(TOP_CAMPAIGNS).agg(F.array_sort(F.collect_list(
        F.struct((-F.col("priority_score")).alias("o"), "cluster_id", "priority_score", "expected_revenue_at_risk", "recommended_campaign")
    )).alias("all")).select(F.posexplode("all").alias("place", "c"))
    plan = best.select(F.lit(3).alias("part"), "place", F.posexplode(F.array(
        each("campaign", F.col("c.recommended_campaign")), each("priority", number(F.col("c.priority_score"), 2)),
        each("revenue_at_risk", number(F.col("c.expected_revenue_at_risk"), 2)),
    )).alias("sub", "f"), "c.cluster_id").select(
        "part", "place", F.concat_ws(".", F.col("cluster_id").cast("string"), "f.key").alias("key"), "f.value", "sub")
    names = F.array(*[F.lit(n) for n in ("run", "overview", "segment", "campaign")])
    ordered = head.unionByName(segments).unionByName(plan).agg(
        F.array_sort(F.collect_list(F.struct("part", "place", "sub", "key", "value"))).alias("all")
    ).select(F.posexplode("all").alias("_p", "l"))  # a few rows a segment
    section = F.element_at(names, F.col("l.part") + 1)
    return ordered.select(
        (F.col("_p") + 1).alias("line_no"), section.alias("section"), F.col("l.key").alias("key"), F.col("l.value").alias("value"),
        F.concat(section, F.lit("."), F.col("l.key"), F.lit(" = "), F.coalesce(F.col("l.value"), F.lit(""))).alias("text"),
    )
