"""Column helpers: bounds, order-independent sums, one-row statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY_SCALE = 6


def bounded(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to [low, high]. ``least``/``greatest`` skip nulls, so nulls are kept apart."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)


def exact_sum(value: Column, scale: int = MONEY_SCALE) -> Column:
    """Sum that does not depend on partitioning: doubles are added as whole numbers of
    10^-scale, in decimals wide enough for any table."""
    units = F.rint(value * 10.0**scale).cast("decimal(38,0)")
    return F.sum(units).cast("double") / 10.0**scale


def exact_avg(value: Column, scale: int = MONEY_SCALE) -> Column:
    return exact_sum(value, scale) / F.count(value)


def rounded(value: Column | str, digits: int) -> Column:
    """Half-to-even rounding in binary, as numeric libraries do it.

    ``round`` goes through decimal text per value; this stays in generated code.
    """
    number = F.col(value) if isinstance(value, str) else value
    return F.rint(number * 10.0**digits) / 10.0**digits


def with_stats(df: DataFrame, stats: DataFrame, name: str = "_g") -> DataFrame:
    """Attach a one-row table to every row as a struct column.

    A scalar subquery runs once and its row travels as a constant: no join, no shuffle.
    """
    row = stats.select(F.struct(*stats.columns))
    return df.withColumn(name, row.scalar())


def first_match(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """Ordered rules as one CASE: the first true condition wins."""
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def tuple_greater(key: Column, ident: Column, bound_key, bound_id) -> Column:
    """(key, ident) > (bound_key, bound_id) in lexicographic order."""
    return (key > F.lit(bound_key)) | ((key == F.lit(bound_key)) & (ident > F.lit(bound_id)))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two double arrays."""
    diffs = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)
