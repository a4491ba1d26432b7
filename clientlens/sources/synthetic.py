"""Synthetic customers as a distributed table source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.functions import catalog
from clientlens.functions.churn import average_order_value, churn_generated
from clientlens.functions.expressions import first_match


DRAWS = ["archetype", *[name for name, _ in catalog.ARCHETYPE_COLUMNS], "channel", "region", "gender"]


def _draw(name: str, seed: int) -> Column:
    """Uniform [0, 1) from the row number: the same row always draws the same value. One
    digest holds four draws of eight hexadecimal digits."""
    block, place = divmod(DRAWS.index(name), 4)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(block)), F.col("_row")))
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _choice(draw: Column, weighted: list[tuple[str, float]]) -> Column:
    total, rules = 0.0, []
    for value, weight in weighted[:-1]:
        total += weight
        rules.append((draw < total, F.lit(value)))
    return first_match(rules, F.lit(weighted[-1][0])) if rules else F.lit(weighted[-1][0])


def customers_from_rows(rows: DataFrame, row_col: str, seed: int = 42) -> DataFrame:
    """A synthetic customer for every row of ``rows``; ``row_col`` is 0, 1, 2, ….

    Archetypes follow the fixed shares by draw, each column a draw from its archetype's
    range. Every value is a function of (seed, column, row), so there is no driver loop,
    no shuffle, and a repeated task writes the same rows.
    """
    numbered = rows.select(F.col(row_col).cast("long").alias("_row"))
    kinds = [(name, share) for name, share, *_ in catalog.ARCHETYPES]
    out = numbered.withColumn("_kind", _choice(_draw("archetype", seed), kinds))

    def by_kind(pick) -> Column:
        rules = [(F.col("_kind") == a[0], pick(a)) for a in catalog.ARCHETYPES]
        return first_match(rules[:-1], rules[-1][1])

    columns: dict[str, Column] = {
        "Customer_ID": F.concat(F.lit("CUST-"), (F.col("_row") + 10001).cast("string"))
    }
    for position, (name, whole) in enumerate(catalog.ARCHETYPE_COLUMNS):
        low = by_kind(lambda a: F.lit(float(a[2][position][0])))
        high = by_kind(lambda a: F.lit(float(a[2][position][1])))
        value = low + _draw(name, seed) * (high - low)
        columns[name] = F.floor(value).cast("int") if whole else value
    columns["Preferred_Channel"] = by_kind(lambda a: _choice(_draw("channel", seed), a[3]))
    columns["Region"] = by_kind(
        lambda a: _choice(_draw("region", seed), list(zip(catalog.REGIONS, a[4])))
    )
    columns["Gender"] = _choice(_draw("gender", seed), catalog.GENDERS)
    columns["Archetype"] = F.col("_kind")
    drawn = out.select(*[expr.alias(name) for name, expr in columns.items()])
    return drawn.withColumn(
        "Avg_Order_Value", average_order_value(F.col("Monetary_Spend"), F.col("Frequency_Orders"))
    ).withColumn("Churn_Risk_Index", churn_generated())


def synthetic_customers(spark: SparkSession, n: int = 50_000, seed: int = 42) -> DataFrame:
    return customers_from_rows(spark.range(n), "id", seed)
