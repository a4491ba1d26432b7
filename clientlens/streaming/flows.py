"""Ingest, scoring and alerts as streams.

Each transformation is the batch operator itself, so a stream yields what a batch over the
same records yields; ``once`` adds the state that keeps repeats out. Sinks append;
checkpoints go to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.functions import catalog
from clientlens.functions.churn import churn_predicted
from clientlens.operators.kpis import alert_candidates
from clientlens.session import new_path
from clientlens.sources import sinks

INGEST_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("recency_days", T.IntegerType()),
        T.StructField("frequency_orders", T.IntegerType()),
        T.StructField("monetary_spend", T.DoubleType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
    ]
)


def full_records(df: DataFrame) -> DataFrame:
    """ST-1: ingested (recency, orders, spend) with the single-record defaults for the rest."""
    given = {
        "Recency_Days": "recency_days",
        "Frequency_Orders": "frequency_orders",
        "Monetary_Spend": "monetary_spend",
    }
    columns = [
        F.col(given[name]).cast(kind).alias(name) if name in given else F.lit(default).cast(kind).alias(name)
        for name, (kind, _, _, default) in catalog.RECORD_FIELDS.items()
    ]
    return df.select(
        F.col("customer_id").cast("string").alias("Customer_ID"),
        F.coalesce("tenant_id", F.lit("guest")).alias("tenant_id"),
        F.col("created_at").cast("string").alias("created_at"),
        *columns,
    )


def ingest(df: DataFrame) -> DataFrame:
    """Completed records with their predicted churn."""
    return full_records(df).withColumn("Churn_Risk_Index", churn_predicted())


def transactions(df: DataFrame) -> DataFrame:
    """ST-1: the log row of every ingested record, as the batch writer makes it."""
    return sinks.transaction_rows(df, F.col("created_at"), F.col("tenant_id"))


def alerts(df: DataFrame, created_at: Column, tenant: Column | None = None) -> DataFrame:
    """ST-3: alert log rows of a stream of scored customers, with the recency as detail."""
    owner = F.lit(None).cast("string") if tenant is None else tenant
    hits = alert_candidates(df).select(
        F.col("Customer_ID").cast("string").alias("customer_id"), F.col("Recency_Days").alias("recency_days"),
        "alert_type", created_at.cast("string").alias("created_at"), owner.alias("tenant_id"),
    )
    return sinks.alert_rows(
        hits, F.col("alert_type"), ["customer_id", "recency_days"], F.col("created_at"), F.col("tenant_id")
    )


def once(df: DataFrame, keys: list[str], within: str = "7 days") -> DataFrame:
    """Of rows with equal ``keys`` that arrive ``within`` that time the first one only.

    Time is that of arrival, so no row is ever late, however old the record is; the state
    forgets a key when the time has passed.
    """
    timed = df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_arrived")


def transactions_once(df: DataFrame) -> DataFrame:
    """ST-1: log rows of which a record sent again adds none."""
    return once(transactions(df), ["id"])


def alerts_once(df: DataFrame, created_at: Column, tenant: Column | None = None) -> DataFrame:
    """ST-3: one alert for each tenant, customer and kind within the time of ``once``."""
    return once(alerts(df, created_at, tenant), ["tenant_id", "customer_id", "alert_type"])


def run_available(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None):
    """Append everything available to a Parquet table, then stop."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    query = writer.start()
    query.awaitTermination()
    return query


def replay(
    spark: SparkSession, records: DataFrame, transform: Callable[[DataFrame], DataFrame], name: str, sent: int = 1
) -> DataFrame:
    """Write ``records`` as files, stream them through ``transform``, read the sink. With ``sent`` the
    records come so often, each time in a run of its own that goes on from the state of the last."""
    source, sink, state = (new_path(spark, f"{name}-{part}") for part in ("in", "out", "state"))
    for _ in range(sent):
        records.write.mode("append").parquet(source)
        out = transform(spark.readStream.schema(records.schema).parquet(source))
        run_available(out, sink, state)
    return spark.read.schema(out.schema).parquet(sink)
