"""RFM quintile scores, the 5x5 grid and the cohort roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.functions import catalog
from clientlens.functions.expressions import exact_avg, first_match, rounded
from clientlens.operators.ranking import with_bins
from clientlens.session import small_table, stage


def rfm_scores(df: DataFrame, mode: str = "analytics", id_col: str = "Customer_ID", **limits) -> DataFrame:
    """Add R_Score, F_Score, M_Score, RFM_Score_Sum and RFM_Group.

    ``training`` ranks recency upwards and reverses its labels, with at most as many bins
    as rows; ``analytics`` ranks recency downwards into five bins. They differ on ties and
    at bin edges. Ties fall in id order.
    """
    recency, orders, spend = F.col("Recency_Days"), F.col("Frequency_Orders"), F.col("Monetary_Spend")
    if mode == "training":
        scored = with_bins(
            df, id_col, {"R_Score": recency, "F_Score": orders, "M_Score": spend},
            reverse=frozenset({"R_Score"}), shrink_to_rows=True, **limits,
        )
    elif mode == "analytics":
        scored = with_bins(
            df, id_col, {"R_Score": -recency, "F_Score": orders, "M_Score": spend}, **limits
        )
    else:
        raise ValueError(f"unknown mode: {mode}")
    digits = [F.col(c).cast("string") for c in ("R_Score", "F_Score", "M_Score")]
    return scored.withColumn(
        "RFM_Score_Sum", F.col("R_Score") + F.col("F_Score") + F.col("M_Score")
    ).withColumn("RFM_Group", F.concat(*digits))


def cohort_code(recency_score: Column, frequency_score: Column) -> Column:
    """AGG-6 cohort 0..5 of an (R, F) cell, first rule wins."""
    r, f = recency_score, frequency_score
    rules = [
        ((r >= 4) & (f >= 4), F.lit(0)),
        ((r >= 4) & (f <= 2), F.lit(1)),
        ((r >= 3) & (f >= 3), F.lit(2)),
        ((r <= 2) & (f >= 4), F.lit(3)),
        ((r == 3) & (f <= 2), F.lit(4)),
    ]
    return first_match(rules, F.lit(5))


def rfm_cells(spark: SparkSession) -> DataFrame:
    r, f, title, color = zip(*catalog.RFM_CELLS)
    return small_table(
        spark,
        {"r_score": list(r), "f_score": list(f), "title": list(title), "color": list(color),
         "action": [f"R {a}, F {b}" for a, b in zip(r, f)]},
    )


def rfm_grid(scored: DataFrame) -> DataFrame:
    """All 25 cells with customer count and mean spend; empty cells hold zeros."""
    cells = scored.groupBy(F.col("R_Score").alias("_r"), F.col("F_Score").alias("_f")).agg(
        F.count("*").alias("count"), exact_avg(F.col("Monetary_Spend")).alias("mean")
    )
    return (
        rfm_cells(scored.sparkSession)
        .join(cells, (F.col("r_score") == F.col("_r")) & (F.col("f_score") == F.col("_f")), "left")
        .select(
            F.col("r_score").cast("int").alias("r_score"),
            F.col("f_score").cast("int").alias("f_score"),
            F.coalesce("count", F.lit(0)).cast("long").alias("count"),
            rounded(F.coalesce("mean", F.lit(0.0)), 2).alias("avg_spend"),
            "title", "action", "color",
        )
    )


def rfm_cohorts(scored: DataFrame) -> DataFrame:
    """Customer count and share of each of the six cohorts."""
    code, name, color = zip(*catalog.RFM_COHORTS)
    names = small_table(
        scored.sparkSession,
        {"cohort": list(code), "cohort_name": list(name), "color": list(color)},
    )
    sizes = scored.groupBy(
        cohort_code(F.col("R_Score"), F.col("F_Score")).cast("long").alias("code")
    ).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    sizes = stage(sizes, "cohorts")
    total = sizes.agg(F.sum("n")).scalar()
    return names.join(sizes, F.col("cohort") == F.col("code"), "left").select(
        F.col("cohort").cast("int").alias("cohort"),
        "cohort_name",
        n.cast("long").alias("count"),
        rounded(F.coalesce(F.try_divide(n, total), F.lit(0.0)) * 100, 1).alias("percentage"),
        "color",
    )


def with_cohort(scored: DataFrame, out: str = "Segment") -> DataFrame:
    return scored.withColumn(out, cohort_code(F.col("R_Score"), F.col("F_Score")).cast("int"))
