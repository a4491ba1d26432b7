"""The clustering matrix: log, scale, one-hot, assemble."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.functions import catalog
from clientlens.functions.churn import average_order_value, churn_rfm, churn_single


def with_engineered(df: DataFrame, new_records: bool = False) -> DataFrame:
    """Add order value and churn where the table lacks them.

    A stored table takes the table churn formula, with neutral values for absent inputs;
    new records take the single-record one.
    """
    out = df
    if "Avg_Order_Value" not in df.columns:
        have = {"Monetary_Spend", "Frequency_Orders"} <= set(df.columns)
        value = average_order_value(F.col("Monetary_Spend"), F.col("Frequency_Orders"))
        out = out.withColumn("Avg_Order_Value", value if have else F.lit(100.0))
    if "Churn_Risk_Index" not in df.columns:
        neutral = {"Recency_Days": 30, "Frequency_Orders": 5, "Engagement_Score": 50, "Support_Tickets": 1}
        absent = [c for c in neutral if c not in df.columns]
        out = out.withColumns({c: F.lit(neutral[c]) for c in absent}) if absent else out
        out = out.withColumn("Churn_Risk_Index", churn_single() if new_records else churn_rfm())
        out = out.drop(*absent)
    return out


@dataclass
class FeatureModel:
    """A fitted matrix pipeline and the names of its columns."""

    pipeline: PipelineModel

    @property
    def names(self) -> list[str]:
        names = list(catalog.MATRIX_NUMERICS)
        for stage in self.pipeline.stages:
            if hasattr(stage, "labelsArray"):
                for column, labels in zip(catalog.CATEGORICALS, stage.labelsArray):
                    names += [f"{column}_{label}" for label in labels]
        return names

    def transform(self, df: DataFrame, new_records: bool = False) -> DataFrame:
        """``df`` plus ``features``; unseen categories are all zeros."""
        out = self.pipeline.transform(with_engineered(df, new_records))
        return out.drop(*[c for c in out.columns if c.startswith("_f_")])

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> "FeatureModel":
        return FeatureModel(PipelineModel.load(path))


def fit_features(df: DataFrame) -> FeatureModel:
    """ML-1..3. Deviations are those of the population: the built-in scaler divides by
    the sample deviation, so its output is multiplied by sqrt(n / (n - 1)). A constant
    column becomes zero. Every category in the table keeps a column."""
    ready = with_engineered(df)
    n = ready.count()
    logged = ", ".join(
        (f"log1p(`{c}`)" if c in catalog.LOG_COLUMNS else f"CAST(`{c}` AS DOUBLE)") + f" AS _f_{i}"
        for i, c in enumerate(catalog.MATRIX_NUMERICS)
    )
    raw = [f"_f_{i}" for i in range(len(catalog.MATRIX_NUMERICS))]
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    codes = [f"_f_code_{c}" for c in catalog.CATEGORICALS]
    flags = [f"_f_flag_{c}" for c in catalog.CATEGORICALS]
    stages = [
        SQLTransformer(statement=f"SELECT *, {logged} FROM __THIS__"),
        VectorAssembler(inputCols=raw, outputCol="_f_raw"),
        StandardScaler(inputCol="_f_raw", outputCol="_f_sample", withMean=True, withStd=True),
        ElementwiseProduct(
            inputCol="_f_sample", outputCol="_f_scaled", scalingVec=Vectors.dense([factor] * len(raw))
        ),
        StringIndexer(
            inputCols=catalog.CATEGORICALS, outputCols=codes,
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ),
        OneHotEncoder(inputCols=codes, outputCols=flags, dropLast=True),
        VectorAssembler(inputCols=["_f_scaled", *flags], outputCol="features"),
    ]
    return FeatureModel(Pipeline(stages=stages).fit(ready))
