"""Run documents: all that is known of training runs as nested JSON, and the run tables in it.

A document describes one run: scalars, and lists of settings, benchmark rows, personas, drivers,
campaigns and noise customers, each a table of its own once imported. Documents are parsed
where they lie; every table is a projection of the parsed ones, so tables that are not asked for
cost nothing. What cannot be read as a run document is kept apart with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.session import stage

#: Names and types of the fields of a run document.
SCORES = "silhouette_score double, davies_bouldin double, calinski_harabasz double"
DOCUMENT = f"""
run_id string, project_positioning string, trained_at_utc string, data_source string, validation_warnings array<string>,
total_samples long, optimal_k int, production_model string, realtime_classifier string, anomaly_model string,
classifier_metrics struct<accuracy double, weighted_f1_score double, report map<string, string>>,
classifier_feature_importances array<struct<feature string, importance double>>,
model_artifacts map<string, string>,
k_search_grid array<struct<k int, inertia double, {SCORES}, is_minibatch boolean>>,
dbscan_search_grid array<struct<eps double, min_samples int, n_clusters int, n_noise long, noise_ratio double, {SCORES}>>,
kmeans_centroids array<array<double>>,
pca_metadata struct<variance_explained_per_component array<double>, total_variance_explained double>,
benchmark_comparison array<struct<Algorithm string, Clusters int, `Outliers/Noise` long, Silhouette_Score double,
  Davies_Bouldin_Index double, Calinski_Harabasz_Index double>>,
persona_summary struct<total_customers long, total_revenue double, cluster_labels_map map<string, string>,
  clusters array<struct<cluster_id int, persona_key string, persona_title string, tagline string, description string,
    strategy string, color string, icon string, metrics map<string, double>>>>,
segment_explanations array<struct<cluster_id int, sample_size long, top_drivers array<struct<feature string, direction string,
  strength double, cluster_average double, global_average double>>, plain_english string>>,
campaign_recommendations array<struct<cluster_id int, persona_title string, priority_score double,
  expected_revenue_at_risk double, recommended_campaign string, success_metric string, estimated_audience long>>,
anomaly_summary struct<count long, percentage double, interpretation string, customers array<struct<customer_id string,
  severity double, monetary_spend double, return_rate double, discount_ratio double, churn_risk_index double>>>,
stability_report struct<method string, runs int, mean_adjusted_rand_index double, min_adjusted_rand_index double,
  max_adjusted_rand_index double, interpretation string>
"""
_CLASS_SCORES = "precision double, recall double, `f1-score` double, support double"
_BENCHMARK = {
    "Algorithm": "algorithm", "Clusters": "clusters", "Outliers/Noise": "noise", "Silhouette_Score": "silhouette_score",
    "Davies_Bouldin_Index": "davies_bouldin", "Calinski_Harabasz_Index": "calinski_harabasz",
}
_SCALARS = ("project_positioning", "trained_at_utc", "data_source", "total_samples", "optimal_k", "production_model",
            "realtime_classifier", "anomaly_model")

_LOST = "_corrupt_record"


def read_documents(spark: SparkSession, path: str, one_a_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): every document of a folder, a file or a line each, is in one of the two.

    A document without a ``run_id`` is named after its file. Rejected are texts that are no JSON
    object (broken off, or something else) and those in which a field holds what it cannot hold;
    they keep ``file``, ``document`` and ``reason``. Fields that are missing or null are null,
    fields of other names are ignored, empty files and blank lines hold no document.
    """
    text = spark.read.text(path, wholetext=not one_a_line).where(F.col("value").rlike(r"\S"))
    schema = f"{DOCUMENT}, {_LOST} string"
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LOST})
    file = F.regexp_extract("_metadata.file_path", r"([^/]*)$", 1)
    # by itself a number would be read as a document of nulls, and what follows a document would be ignored
    entries = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    entry = lambda i: F.try_variant_get(entries, f"$[{i}]", "variant")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(entry(0)), F.lit("OBJECT<")) & entry(1).isNull(), F.lit(False))
    read = stage(text.select(file.alias("file"), "value", is_object.alias("is_object"), parsed.alias("d")), "documents")
    good = F.col("is_object") & F.col("d").isNotNull() & F.col(f"d.{_LOST}").isNull()
    name = F.coalesce("d.run_id", F.regexp_replace("file", r"\.[^.]*$", ""))
    documents = read.where(good).select("d.*", name.alias("_name")).drop(_LOST).withColumn("run_id", F.col("_name")).drop("_name")
    reason = F.when(F.col("is_object"), "unreadable value").otherwise("not a run document")
    return documents, read.where(~good).select("file", F.col("value").alias("document"), reason.alias("reason"))


def _listed(documents: DataFrame, field: str) -> DataFrame:
    """(run_id, position, fields of the entry): one row for each entry of a list of structures."""
    return documents.select("run_id", F.posexplode(field).alias("position", "_e")).where("_e is not null").select("run_id", "position", "_e.*")


def run_row(documents: DataFrame) -> DataFrame:
    """One row a run, the single figures of nested parts beside its own fields."""
    return documents.select(
        "run_id", *_SCALARS, F.col("classifier_metrics.accuracy").alias("classifier_accuracy"),
        F.col("classifier_metrics.weighted_f1_score").alias("classifier_weighted_f1"),
        F.col("pca_metadata.total_variance_explained").alias("pca_total_variance"),
        F.col("stability_report.mean_adjusted_rand_index").alias("stability_mean"),
        F.col("stability_report.min_adjusted_rand_index").alias("stability_min"),
        F.col("stability_report.max_adjusted_rand_index").alias("stability_max"),
        F.col("persona_summary.total_revenue").alias("total_revenue"),
        F.col("anomaly_summary.count").alias("anomaly_count"), F.col("anomaly_summary.percentage").alias("anomaly_percentage"),
        F.element_at("model_artifacts", F.lit("kmeans_model")).alias("model_path"),
    )


def class_report(documents: DataFrame) -> DataFrame:
    """Scores of each class. Entries of the report that are no structure (its accuracy) are left out."""
    entries = documents.select("run_id", F.explode("classifier_metrics.report").alias("class", "_text"))
    scores = entries.where(F.startswith("_text", F.lit("{"))).select("run_id", "class", F.from_json("_text", _CLASS_SCORES).alias("_s"))
    return scores.select("run_id", "class", "_s.precision", "_s.recall", F.col("_s.f1-score").alias("f1_score"), F.col("_s.support").cast("long").alias("support"))


def segment_drivers(documents: DataFrame) -> DataFrame:
    """One row for each cluster of a run, its drivers as a list, as ``drivers.segment_drivers`` gives them."""
    return _listed(documents, "segment_explanations").drop("position")


def personas(documents: DataFrame) -> DataFrame:
    """One row for each cluster of a run; its figures stay a map, whatever their names."""
    return _listed(documents, "persona_summary.clusters").drop("position")


def run_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """The tables of all runs by the names a training job writes them under, each with ``run_id``."""
    benchmark = _listed(documents, "benchmark_comparison").withColumnsRenamed(_BENCHMARK)
    centres = documents.select("run_id", F.posexplode("kmeans_centroids").alias("cluster_id", "centre"))
    components = documents.select("run_id", F.posexplode("pca_metadata.variance_explained_per_component").alias("component", "ratio"))
    return {
        "run": run_row(documents),
        "warnings": documents.select("run_id", F.posexplode("validation_warnings").alias("position", "warning")),
        "classifier_report": class_report(documents),
        "classifier_importances": _listed(documents, "classifier_feature_importances"),
        "k_grid": _listed(documents, "k_search_grid").drop("position"),
        "dbscan_grid": _listed(documents, "dbscan_search_grid").drop("position"),
        "centres": centres,
        "pca": components.withColumn("component", F.col("component") + 1),
        "benchmark": benchmark.drop("position"),
        "personas": personas(documents),
        "segment_drivers": segment_drivers(documents),
        "campaigns": _listed(documents, "campaign_recommendations").drop("position"),
        "anomalies": _listed(documents, "anomaly_summary.customers").drop("position"),
    }


def documents_of(runs: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """(run_id, document): the JSON text of each row of ``runs``, with ``lists``, tables with a
    ``run_id`` by the field of the document they fill. Rows of a list are ordered by their values;
    lists belong to one run each and are as small as a run's tables are. Fields of ``runs`` and
    columns of the lists that a document does not have are left out; a run without rows of a
    list has an empty one.
    """
    schema = T.StructType.fromDDL(DOCUMENT)
    out = runs.select("run_id", *[c for c in runs.columns if c in schema.names and c not in ("run_id", *lists)])
    for field, rows in lists.items():
        entry = schema[field].dataType.elementType
        back = {v: k for k, v in _BENCHMARK.items()} if field == "benchmark_comparison" else {}
        columns = [F.col(c).alias(back.get(c, c)) for c in rows.columns if back.get(c, c) in entry.names]
        if not columns:
            raise ValueError(f"no column of the table is a field of {field}")
        gathered = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(field))
        out = out.join(gathered, "run_id", "left").withColumn(field, F.coalesce(field, F.array().cast(gathered.schema[field].dataType)))
    return out.select("run_id", F.to_json(F.struct(*out.columns)).alias("document"))
