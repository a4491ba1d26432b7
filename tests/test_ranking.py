import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientlens.operators import ranking

NARROW = {"sort_rows": 40, "sample_rows": 60}


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows: a third share one value, the rest are spread."""
    rng = np.random.default_rng(7)
    values = np.where(np.arange(2000) % 3 == 0, 5.0, rng.normal(5, 3, 2000).round(3))
    pdf = pd.DataFrame({"id": np.arange(2000), "v": values, "w": rng.integers(0, 4, 2000).astype(float)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("limits", [{}, NARROW])
def test_quantiles_are_exact(skewed, limits):
    pdf, df = skewed
    wanted = [0.0, 0.1, 0.4, 0.5, 0.65, 0.97, 1.0]
    found = ranking.exact_quantiles(df, {"v": wanted, "w": wanted}, **limits)
    for column in ("v", "w"):
        assert np.allclose([found[column][p] for p in wanted], pdf[column].quantile(wanted).tolist(), rtol=1e-12)


@pytest.mark.parametrize("limits", [{}, NARROW])
def test_bins_equal_quantile_cut_of_first_rank(skewed, limits):
    pdf, df = skewed
    got = ranking.with_bins(df, "id", {"a": F.col("v"), "b": -F.col("w")}, **limits).toPandas().sort_values("id")
    cut = lambda s: pd.qcut(s.rank(method="first"), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert (got["a"].to_numpy() == cut(pdf["v"]).to_numpy()).all()
    assert (got["b"].to_numpy() == cut(-pdf["w"]).to_numpy()).all()
    sizes = got["a"].value_counts()
    assert sizes.max() - sizes.min() <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 9, 13, 31])
def test_bins_closed_form_on_small_tables(spark, n):
    df = spark.range(n).select(F.col("id"), F.col("id").cast("double").alias("v"))
    got = [r["s"] for r in ranking.with_bins(df, "id", {"s": F.col("v")}).orderBy("id").collect()]
    assert got == [max(1, -(-(k * 5) // (n - 1))) if n > 1 else 1 for k in range(n)]


def test_constant_column_with_repeated_ids_does_not_stall(spark):
    df = spark.range(500).select(F.lit(1).alias("id"), F.lit(2.0).alias("v"))
    assert ranking.exact_quantiles(df, {"v": [0.5]}, **NARROW)["v"][0.5] == 2.0


def test_percent_ranks_and_row_numbers_in_many_ranges(skewed, monkeypatch):
    monkeypatch.setattr(ranking, "SORT_ROWS", 100)
    monkeypatch.setattr(ranking, "SAMPLE_ROWS", 300)
    pdf, df = skewed
    got = ranking.with_percent_ranks(df, ["v", "w"]).toPandas().sort_values("id")
    for column in ("v", "w"):
        assert np.allclose(got[f"{column}_pct"], pdf[column].rank(pct=True))
    numbered = ranking.with_row_number(df, "id", "n").toPandas().sort_values("id")
    assert (numbered["n"].to_numpy() == np.arange(1, 2001)).all()


def test_result_does_not_depend_on_partitions(skewed):
    _, df = skewed
    one = ranking.with_bins(df.coalesce(1), "id", {"a": F.col("v")}).select("id", "a")
    four = ranking.with_bins(df.repartition(4), "id", {"a": F.col("v")}).select("id", "a")
    assert one.exceptAll(four).count() == 0
    sample = lambda d: {r["id"] for r in ranking.stable_sample(d, "id", 50).collect()}
    assert sample(df.coalesce(1)) == sample(df.repartition(4)) and len(sample(df)) == 50
