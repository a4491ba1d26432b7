"""Customer uploads: file gate, schema description, dataset and run lookup."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.functions import catalog
from clientlens.session import path_exists, small_table, stage
from clientlens.sources import sinks

MIN_UPLOAD_ROWS = 5


def read_upload(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV with a header. Types are inferred unless a schema is given. Only ``.csv`` and
    ``.txt`` files of at least five rows are taken; Spark reads large files in splits."""
    if not path.lower().endswith((".csv", ".txt")):
        raise ValueError("only .csv and .txt files can be uploaded")
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if len(df.limit(MIN_UPLOAD_ROWS).take(MIN_UPLOAD_ROWS)) < MIN_UPLOAD_ROWS:
        raise ValueError(f"upload at least {MIN_UPLOAD_ROWS} customer rows")
    return df


def read_checked(spark: SparkSession, path: str, schema: T.StructType, separator: str = ",", header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): a CSV of known columns, with every line in one of the two.

    Lines that do not give a value for each column - too few or too many fields, an open
    quote, text where a number belongs - are rejected with their ``line`` and the ``reason``.
    An empty field is a null, no reason to reject. Blank lines hold no record.
    """
    lost = "_corrupt_record"
    full = T.StructType([*schema.fields, T.StructField(lost, T.StringType())])
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    if header:
        named = lines.first()  # every file of an upload begins with it
        lines = lines.where(F.col("value") != F.lit(named["value"])) if named else lines
    options = {"sep": separator, "escape": "\"", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": lost}
    read = stage(lines.select("value", F.from_csv("value", full.toDDL(), options).alias("r")), "upload")
    line, count = F.col("value"), lambda text, part: F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))
    open_quote = count(line, '"') % 2 == 1  # the parser would take the rest of the line for the field
    fields = count(F.regexp_replace(line, '"[^"]*"', ""), separator) + 1
    reason = (
        F.when(open_quote, "open quote").when(fields < len(schema), "too few fields")
        .when(fields > len(schema), "too many fields").otherwise("unreadable value")
    )
    broken = open_quote | F.col(f"r.{lost}").isNotNull()
    return read.where(~broken).select("r.*").drop(lost), read.where(broken).select(line.alias("line"), reason.alias("reason"))


def upload_schema(spark: SparkSession) -> DataFrame:
    """Required and optional columns with their ranges and defaults."""
    names = sorted(catalog.CORE_COLUMNS) + ["Customer_ID"] + list(catalog.OPTIONAL_DEFAULTS)
    ranges = [catalog.VALUE_RANGES.get(n, (None, None, False)) for n in names]
    return small_table(
        spark,
        {
            "column": names,
            "required": [n in catalog.CORE_COLUMNS for n in names],
            "low": [r[0] for r in ranges],
            "high": [r[1] for r in ranges],
            "default": [
                str(catalog.OPTIONAL_DEFAULTS[n]) if n in catalog.OPTIONAL_DEFAULTS else None
                for n in names
            ],
        },
    )


def resolve_dataset(spark: SparkSession, tenant_id: str | None, shared: str,
                    tenants: str | None = None, packaged: str | None = None, replaced: str | None = None) -> DataFrame:
    """The tenant's rows if there are any, else the shared table, else the packaged one.

    Tenant tables are partitioned by ``tenant_id``; the filter prunes to one partition. Rows that
    ``sinks.replace_tenant`` wrote below ``replaced`` come first.
    """
    if tenant_id and replaced:
        own = sinks.tenant_rows(spark, replaced, tenant_id)
        if own is not None and own.take(1):
            return own
    if tenant_id and tenants and path_exists(spark, tenants):
        own = spark.read.parquet(tenants).where(F.col("tenant_id") == tenant_id).drop("tenant_id")
        if own.take(1):
            return own
    for path in (shared, packaged):
        if path and path_exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError("no dataset: upload one or run the training job")


def resolve_run(spark: SparkSession, folders: list[str], name: str) -> DataFrame | None:
    """The first run table of that name; folders without one, or with an empty one, are
    skipped. Any other failure to read is raised."""
    for folder in folders:
        path = f"{folder}/{name}"
        if not path_exists(spark, path):
            continue
        try:
            return spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
    return None


def dataset_status(run: DataFrame) -> DataFrame:
    """Source, display name and size of the active dataset, one row per run."""
    source = F.coalesce("data_source", F.lit(catalog.SOURCE_DEFAULT))
    custom = source.contains(catalog.UPLOAD_MARK)
    trained = [F.col("trained_at_utc").alias("trained_at")] if "trained_at_utc" in run.columns else []
    return run.select(
        source.alias("data_source"),
        F.when(custom, F.replace(source, F.lit(catalog.UPLOAD_MARK + ":"), F.lit(catalog.UPLOAD_NAME)))
        .otherwise(catalog.DEMO_NAME)
        .alias("display_name"),
        custom.alias("is_custom"),
        F.coalesce("total_samples", F.lit(0)).cast("long").alias("total_samples"),
        *trained,
    )


def model_info(run: DataFrame) -> DataFrame:
    """Model names and sizes of a run, with the defaults of an untrained system."""
    have = set(run.columns)
    pick = lambda name, default=None: (
        F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    ).alias(name)
    return run.select(
        pick("project_positioning"),
        pick("production_model", catalog.MODEL_KMEANS),
        pick("anomaly_model", "DBSCAN"),
        pick("total_samples"),
        pick("optimal_k"),
        pick("pca_total_variance"),
        pick("stability_mean"),
        pick("model_path"),
    )
