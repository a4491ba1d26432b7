"""Registered queries: every operator over the given tables.

Queries on customers share one customer table per folder, derived from the raw tables and
written once to the shared folder; ``forget`` drops it. ``customer_table`` itself always
derives it anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.functions.expressions import rounded
from clientlens.functions import catalog, churn
from clientlens.operators import (
    answers,
    clustering,
    cohorts,
    conform,
    dbscan,
    drivers,
    features,
    isolation,
    kpis,
    personas,
    projection,
    quality,
    ranking,
    report,
    rfm,
    scenario,
    scoring,
    selection,
    severity,
    silhouette,
    stability,
    supervised,
    ward,
)
from clientlens.session import new_path, small_table, stage
from clientlens.sources import run_documents, sinks, tables, uploads
from clientlens.plans import training
from clientlens.streaming import flows

_shared: dict[tuple[str, str, str], DataFrame] = {}


def forget() -> None:
    """Derive the shared tables and fit the shared models anew on next use."""
    _shared.clear()
    _fits.clear()


def _once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _shared:
        _shared[key] = stage(build(), name)
    return _shared[key]


def customers(spark: SparkSession, folder: str, money_scale: float = 500.0) -> DataFrame:
    return _once(
        spark, folder, f"customers_{money_scale:g}",
        lambda: tables.customer_table(spark, folder, money_scale),
    )


def segmented(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with RFM scores, their cohort as ``Segment``, and a label with noise:
    -1 for customers silent for 300 days or more."""

    def build() -> DataFrame:
        scored = rfm.with_cohort(rfm.rfm_scores(customers(spark, folder)))
        noise = F.when(F.col("Recency_Days") >= 300, F.lit(-1)).otherwise(F.col("Segment"))
        return scored.withColumn("Density_Label", noise.cast("int"))

    return _once(spark, folder, "segmented", build)


def persona_rows(spark: SparkSession, folder: str, label: str = "Segment") -> DataFrame:
    return personas.personas(segmented(spark, folder), label)


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label")
    )


def _raw_extract(spark: SparkSession, folder: str) -> DataFrame:
    """A customer extract as a user would upload it: foreign names, text numbers, gaps."""
    orders = tables.table(spark, folder, "orders")
    history = tables.order_history(orders)
    last = orders.agg(F.max("o_orderdate")).scalar()
    days = F.date_diff(last.cast("date"), F.col("last_order").cast("date"))
    segment = F.col("c_mktsegment")
    return (
        tables.table(spark, folder, "customer")
        .join(history, F.col("c_custkey") == F.col("_cust"), "left")
        .select(
            F.col("c_custkey").alias("Account ID"),
            F.when(segment == "MACHINERY", F.lit("n/a")).otherwise(days.cast("string"))
            .alias("Days Since Last Order"),
            (F.col("n_orders") * 1.5).alias("Order Count"),
            F.col("c_acctbal").cast("string").alias("Total-Spend"),
            F.when(segment != "BUILDING", F.col("c_acctbal") / 50.0).alias("Engagement_Score"),
            (F.col("c_acctbal") / 5000.0).alias("Discount_Ratio"),
            F.when(segment != "HOUSEHOLD", segment).alias("Preferred_Channel"),
        )
    )


# --- sources and conformance --------------------------------------------------------


def customer_table(spark, folder):
    return tables.customer_table(spark, folder)


def conform_clip(spark, folder):
    done = conform.conform(_raw_extract(spark, folder)).table
    return done.select(
        "Customer_ID", "Recency_Days", "Frequency_Orders", "Monetary_Spend", "Category_Diversity",
        "Engagement_Score", "Support_Tickets", "Discount_Ratio", "Return_Rate", "Preferred_Channel",
        "Gender", "Age", "Avg_Order_Value", "Churn_Risk_Index",
    )


def conform_warnings(spark, folder):
    return conform.conform(_raw_extract(spark, folder)).warning_table()


def upload_lines(spark, folder):
    """A customer export some of whose lines are broken; each line is read or rejected."""
    key = F.col("c_custkey")
    line = F.concat_ws(",", key, "c_nationkey", "c_mktsegment")
    broken = (
        F.when(key % 10 == 1, F.concat_ws(",", key, "c_nationkey")).when(key % 10 == 2, F.concat(line, F.lit(",more")))
        .when(key % 10 == 3, F.concat(key.cast("string"), F.lit(',"'), F.col("c_nationkey").cast("string"), F.lit(","), F.col("c_mktsegment")))
        .when(key % 10 == 4, F.concat(key.cast("string"), F.lit(",n/a,"), F.col("c_mktsegment")))
        .when(key % 10 == 5, F.concat(key.cast("string"), F.lit(",,"), F.lit('"'), F.col("c_mktsegment"), F.lit(', Inc"'))).otherwise(line)
    )
    path = new_path(spark, "export")
    tables.table(spark, folder, "customer").select(broken.alias("value")).write.text(path)
    schema = T.StructType.fromDDL("customer_id long, nation int, segment string")
    rows, rejected = uploads.read_checked(spark, path, schema, header=False)
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select("*", none("string").alias("line"), none("string").alias("reason")).unionByName(
        rejected.select(none("long").alias("customer_id"), none("int").alias("nation"), none("string").alias("segment"), "line", "reason"))


def arrival_ids(spark, folder):
    """Generated ids; the row order of a file is not a SQL notion, so only counts are shown."""
    numbered = conform.with_arrival_ids(tables.table(spark, folder, "customer").select("c_custkey"))
    position = F.substring("Customer_ID", 5, 20).cast("long")
    return numbered.agg(
        F.count("*").alias("n"), F.countDistinct("Customer_ID").alias("n_ids"),
        F.min(position).alias("first_id"), F.max(position).alias("last_id"),
    )


def input_validation(spark, folder):
    raw = stage(_raw_extract(spark, folder), "extract").select(
        F.col("Account ID").alias("customer_id"),
        F.col("Days Since Last Order").alias("Recency_Days"),
        F.col("Order Count").cast("int").alias("Frequency_Orders"),
        F.col("Total-Spend").alias("Monetary_Spend"),
        "Engagement_Score", "Discount_Ratio",
    )
    valid, rejected = conform.validate_records(raw)
    return valid.select(
        "customer_id", F.lit("").alias("reasons"), "Recency_Days", "Frequency_Orders",
        "Monetary_Spend", "Category_Diversity", "Engagement_Score", "Discount_Ratio",
    ).unionByName(
        rejected.select("customer_id", F.array_join("reject_reasons", ",").alias("reasons")),
        allowMissingColumns=True,
    )


def csv_round_trip(spark, folder):
    df = customers(spark, folder).select(
        "Customer_ID", "Recency_Days", "Monetary_Spend", "Preferred_Channel", "Region"
    )
    path = new_path(spark, "export") + ".csv"
    sinks.export_csv(df, path)
    return uploads.read_upload(spark, path, df.schema)


def tenant_partition(spark, folder):
    """One tenant of a partitioned table, or the shared table where it has no rows."""
    tenants, shared = new_path(spark, "tenants"), new_path(spark, "shared")
    df = customers(spark, folder).select("Customer_ID", "Monetary_Spend", "Region")
    sinks.write_customers(df, shared)
    for tenant in ("ASIA", "EUROPE"):
        sinks.write_customers(df.where(F.col("Region") == tenant), tenants, tenant)
    found = lambda name: uploads.resolve_dataset(spark, name, shared, tenants=tenants).select(
        F.lit(name).alias("asked_by"), "Customer_ID", "Monetary_Spend", "Region"
    )
    return found("ASIA").unionByName(found("NOBODY"))


def tenant_replaced(spark, folder):
    """A tenant's rows replaced by rows made of them, beside a tenant that has none."""
    replaced, shared = new_path(spark, "replaced"), new_path(spark, "shared")
    df = customers(spark, folder).select("Customer_ID", "Monetary_Spend", "Region")
    sinks.write_customers(df, shared)
    found = lambda name: uploads.resolve_dataset(spark, name, shared, replaced=replaced)
    sinks.replace_tenant(df.where("Region in ('ASIA', 'EUROPE')"), replaced, "ASIA")
    sinks.replace_tenant(found("ASIA").where("Region = 'ASIA'").withColumn("Monetary_Spend", F.col("Monetary_Spend") * 2), replaced, "ASIA")
    return found("ASIA").withColumn("asked_by", F.lit("ASIA")).unionByName(found("NOBODY").withColumn("asked_by", F.lit("NOBODY")))


def _run_folder(spark, folder):
    """Tables of a run over the customers, written as a training job writes them."""
    path = new_path(spark, "run")
    run = segmented(spark, folder).agg(
        F.count("*").alias("total_samples"), F.countDistinct("Segment").cast("int").alias("optimal_k")
    ).select(
        "*", F.lit("uploaded_csv:customers.csv").alias("data_source"), F.lit(catalog.MODEL_KMEANS).alias("production_model"),
    )
    sinks.write_run({"run": run}, path)
    return path


def dataset_status(spark, folder):
    path = _run_folder(spark, folder)
    return uploads.dataset_status(uploads.resolve_run(spark, [f"{path}/none", path], "run"))


def model_info(spark, folder):
    path = _run_folder(spark, folder)
    sinks.set_production_model(spark, path, catalog.MODEL_WARD)
    sinks.set_production_model(spark, path, catalog.MODEL_GMM)
    return uploads.model_info(sinks.current_run(spark, path)).select(
        "production_model", "anomaly_model", "total_samples", "optimal_k"
    )


def _imported(spark, documents):
    """Run documents written to a folder, one a line, and read back."""
    path = new_path(spark, "documents")
    documents.select("document").write.text(path)
    return run_documents.read_documents(spark, path, one_a_line=True)


def _whole_run(spark, folder):
    """The run over all customers as a document: its row, drivers and campaigns."""
    rows = segmented(spark, folder)
    named = lambda df: df.withColumn("run_id", F.lit("all"))
    run = rows.agg(F.count("*").alias("total_samples"), F.countDistinct("Segment").cast("int").alias("optimal_k"))
    return _imported(spark, run_documents.documents_of(named(run), {
        "segment_explanations": named(drivers.segment_drivers(rows, "Segment")),
        "campaign_recommendations": named(personas.campaign_priority(persona_rows(spark, folder))),
    }))[0]


def imported_drivers(spark, folder):
    """Drivers of the segments as a nested run document gives them."""
    return drivers.driver_rows(run_documents.segment_drivers(_whole_run(spark, folder)))


def imported_campaigns(spark, folder):
    """Campaigns as a nested run document gives them."""
    return run_documents.run_tables(_whole_run(spark, folder))["campaigns"].drop("run_id")


def imported_runs(spark, folder):
    """A run document for every nation and market segment, some of them damaged; each is imported or rejected.
    Its campaigns stand for the account balances: audience and sum by order priority."""
    sold = tables.table(spark, folder, "customer").join(
        tables.table(spark, folder, "orders").select("o_custkey", "o_orderpriority"), F.col("o_custkey") == F.col("c_custkey"))
    run = F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("run_id")
    size = F.count("*")
    runs = sold.groupBy(run).agg(size.alias("total_samples"), F.countDistinct("o_orderpriority").cast("int").alias("optimal_k"))
    lists = sold.groupBy(run, F.substring("o_orderpriority", 1, 1).cast("int").alias("cluster_id")).agg(
        F.max("o_orderpriority").alias("persona_title"), size.alias("estimated_audience"))
    made = run_documents.documents_of(runs, {"campaign_recommendations": lists})
    nation = F.substring_index("run_id", "/", 1).cast("int")
    damaged = (
        F.when(nation % 5 == 1, F.expr("left(document, length(document) - 1)"))
        .when(nation % 5 == 2, F.replace("document", F.lit('"optimal_k":'), F.lit('"optimal_k":"many","was":')))
        .when(nation % 5 == 3, F.concat(F.lit("["), "document", F.lit("]"))).otherwise(F.col("document"))
    )
    found, rejected = _imported(spark, made.select(damaged.alias("document")))
    told = run_documents.run_tables(found)
    rows = told["run"].select("run_id", "total_samples", "optimal_k").join(
        told["campaigns"].select("run_id", "cluster_id", "persona_title", "estimated_audience"), "run_id")
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select("*", none("string").alias("reason")).unionByName(rejected.select(
        F.regexp_extract("document", r'"run_id":"([^"]*)"', 1).alias("run_id"), none("long").alias("total_samples"),
        none("int").alias("optimal_k"), none("int").alias("cluster_id"), none("string").alias("persona_title"),
        none("long").alias("estimated_audience"), "reason"))


def _extract_as(spark, folder, names):
    """The order history as an upload with the given names for recency, orders and spend."""
    orders = tables.table(spark, folder, "orders")
    last = orders.agg(F.max("o_orderdate")).scalar()
    return tables.order_history(orders).join(
        tables.table(spark, folder, "customer").select("c_custkey", "c_acctbal"), F.col("_cust") == F.col("c_custkey")
    ).select(
        F.col("c_custkey").alias("customer_id"),
        (F.date_diff(last.cast("date"), F.col("last_order").cast("date")) + 400.5).alias(names[0]),
        F.col("n_orders").alias(names[1]), (F.abs(F.col("c_acctbal").cast("double")) * 1000.0 + 1e6).alias(names[2]),
    )


def _core(df):
    return conform.conform(df).table.select("Customer_ID", "Recency_Days", "Frequency_Orders", "Monetary_Spend")


def conform_fragments(spark, folder):
    """CF-2: names that only contain a known fragment."""
    return _core(_extract_as(spark, folder, ("how long since x", "n_purchased", "net_paid_usd")))


def conform_magnitudes(spark, folder):
    """CF-3: names that say nothing; the means of the columns tell them apart."""
    return _core(_extract_as(spark, folder, ("aa", "bb", "cc")))


def upload_schema(spark, folder):
    """SRC-7 beside the values the customer table really has."""
    wanted = uploads.upload_schema(spark).where("low is not null")
    df = customers(spark, folder)
    ranges = df.agg(*[F.struct(F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")).alias(c)
                      for c in catalog.VALUE_RANGES])
    seen = ranges.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), f"{c}.least", f"{c}.most") for c in catalog.VALUE_RANGES])))
    return wanted.select("column", "required", "low").join(seen, "column").select(
        "column", "required", "low", (F.col("least") >= F.col("low")).alias("within")
    )


# --- churn formulas -----------------------------------------------------------------


def _churn(expression):
    def run(spark, folder):
        return customers(spark, folder).select("Customer_ID", expression().alias("churn"))

    return run


def risk_bands(spark, folder):
    df = customers(spark, folder)
    return df.select("Customer_ID", churn.risk_band(F.col("Churn_Risk_Index")).alias("b")).select(
        "Customer_ID", "b.risk_category", "b.badge_color"
    )


def churn_labels(spark, folder):
    df = customers(spark, folder)
    by_rules = churn.churn_label(df.drop("Churn_Risk_Index"))
    return df.select("Customer_ID", churn.churn_label(df).alias("churned"), by_rules.alias("churned_by_rules"))


def churn_drivers(spark, folder):
    df = customers(spark, folder)
    explained = churn.with_churn_drivers(df, F.col("Churn_Risk_Index"))
    # the outer form: the plain one would add a filter that computes the drivers twice
    return explained.select("Customer_ID", F.posexplode_outer("drivers").alias("_p", "_d")).select(
        "Customer_ID", (F.col("_p") + 1).alias("driver_rank"), "_d.feature", "_d.value", "_d.impact",
        "_d.importance_pct", "_d.direction",
    )


def churn_driver_lists(spark, folder):
    explained = churn.with_churn_drivers(customers(spark, folder), F.col("Churn_Risk_Index"))
    names = lambda c: F.array_join(F.transform(c, lambda d: d["feature"]), ",")
    return explained.select(
        "Customer_ID", "overall_churn_risk", names("top_risk_drivers").alias("risk"),
        names("top_retention_drivers").alias("retention"), "churn_summary",
    )


# --- RFM, personas, campaigns -------------------------------------------------------


def _rfm(mode):
    def run(spark, folder):
        return rfm.rfm_scores(customers(spark, folder), mode).select(
            "Customer_ID", "R_Score", "F_Score", "M_Score", "RFM_Score_Sum", "RFM_Group"
        )

    return run


def rfm_grid(spark, folder):
    return rfm.rfm_grid(segmented(spark, folder))


def rfm_cohorts(spark, folder):
    return rfm.rfm_cohorts(segmented(spark, folder))


def overview_kpis(spark, folder):
    return kpis.overview(segmented(spark, folder), "Density_Label")


def distinct_labels(spark, folder):
    return kpis.distinct_labels(segmented(spark, folder), "Density_Label")


def exact_quantiles(spark, folder):
    df = customers(spark, folder)
    found = ranking.exact_quantiles(df, personas.RULE_QUANTILES)
    flat = [(c, p, v) for c, by_p in found.items() for p, v in by_p.items()]
    return small_table(
        spark, {"column": [r[0] for r in flat], "p": [r[1] for r in flat], "value": [r[2] for r in flat]}
    )


def persona_profile(spark, folder):
    return persona_rows(spark, folder, "Density_Label").select(
        "cluster_id", "customer_count", "customer_percentage", "total_revenue", "revenue_percentage",
        "avg_recency_days", "avg_frequency_orders", "avg_monetary_spend", "avg_order_value",
        "avg_engagement_score", "avg_discount_ratio", "avg_churn_risk",
    )


def persona_rules(spark, folder):
    return persona_rows(spark, folder, "Density_Label").select(
        "cluster_id", "persona_key", "persona_title", "tagline", "description", "strategy", "color", "icon"
    )


def persona_per_customer(spark, folder):
    """Personas of the segments that have one; other customers take the default name."""
    known = persona_rows(spark, folder).where(F.col("cluster_id") < 4)
    return personas.with_persona(segmented(spark, folder), known, "Segment").select(
        "Customer_ID", "persona", "persona_color"
    )


def segment_drivers(spark, folder):
    return drivers.driver_rows(drivers.segment_drivers(segmented(spark, folder), "Segment"))


def campaign_priority(spark, folder):
    return personas.campaign_priority(persona_rows(spark, folder))


def campaign_copy(spark, folder):
    copied = personas.campaign_copy(persona_rows(spark, folder).select("cluster_id", "persona_key"))
    return copied.select(
        "cluster_id", "copy_key", "copy_title", "email_subject", "sms_text", "call_to_action", "discount_offer"
    )


# --- filters and lists --------------------------------------------------------------


def high_risk_topk(spark, folder):
    return kpis.high_risk_customers(segmented(spark, folder), "Segment")


def target_cohort(spark, folder):
    return kpis.target_cohort(customers(spark, folder), "high_value_risk").select(
        "Customer_ID", "Churn_Risk_Index", "Monetary_Spend"
    )


def micro_segment(spark, folder):
    named = personas.with_persona(segmented(spark, folder), persona_rows(spark, folder), "Segment")
    return kpis.micro_segment(named, "VIP Champions", 45.0, 5000.0, 60).select(
        "Customer_ID", "persona", "Monetary_Spend", "Recency_Days", "Churn_Risk_Index"
    )


def currency_view(spark, folder):
    currency = (
        F.when(F.col("Region") == "AMERICA", "USD").when(F.col("Region") == "EUROPE", "EUR")
        .when(F.col("Region") == "ASIA", "INR").when(F.col("Region") == "MIDDLE EAST", "AED").otherwise("XOF")
    )
    df = customers(spark, folder).select("Customer_ID", "Monetary_Spend", "Avg_Order_Value", currency.alias("currency"))
    return kpis.convert_money(df, ["Monetary_Spend", "Avg_Order_Value"], "currency")


def _flagged(spark, folder, money_scale=500.0):
    """Customers with an anomaly flag: the top three percent by severity."""

    def build():
        ranked = severity.with_severity(customers(spark, folder, money_scale))
        ranked = stage(ranked, "severity")
        edge = ranking.exact_quantiles(ranked, {"Anomaly_Severity": [0.97]})["Anomaly_Severity"][0.97]
        return ranked.withColumn("Is_Anomaly", F.col("Anomaly_Severity") >= edge)

    return _once(spark, folder, f"flagged_{money_scale:g}", build)


def alert_candidates(spark, folder):
    return kpis.alert_candidates(_flagged(spark, folder)).select(
        "Customer_ID", "Churn_Risk_Index", "Is_Anomaly", "alert_type"
    )


def anomaly_severity(spark, folder):
    return severity.top_anomalies(segmented(spark, folder), "Density_Label")


def anomaly_counts(spark, folder):
    return severity.anomaly_counts(segmented(spark, folder), "Density_Label")


def anomaly_types(spark, folder):
    typed = _flagged(spark, folder, 200.0).withColumn("Anomaly_Type", churn.anomaly_type(F.col("Is_Anomaly")))
    return typed.select("Customer_ID", "Is_Anomaly", "Anomaly_Type")


def anomaly_type_counts(spark, folder):
    return anomaly_types(spark, folder).where("Is_Anomaly").groupBy("Anomaly_Type").agg(F.count("*").alias("n"))


# --- scenarios, cohorts, answers, report --------------------------------------------

SCENARIOS = [
    scenario.Scenario(),
    scenario.Scenario("touch", email_touchpoints=6, target_cohort="at_risk"),
    scenario.Scenario("value", 30.0, 1.0, 2.0, 1, "high_value_risk"),
    scenario.Scenario("lost", 50.0, 5.0, 0.0, 0, "lost"),
    scenario.Scenario("free", 0.0, 0.0, 0.0, 0, "all"),
]


def scenario_compare(spark, folder):
    return scenario.compare_scenarios(customers(spark, folder), SCENARIOS)


def retention_curve(spark, folder):
    curves = cohorts.retention_curves(persona_rows(spark, folder))
    return curves.select(
        "cluster_id", "persona_key", "customer_count", "m12_churn_rate",
        F.posexplode("retention_curve").alias("month", "retention_pct"),
    )


def cohort_retention_observed(spark, folder):
    return cohorts.observed_retention(tables.table(spark, folder, "orders"))


def _facts(spark, folder):
    return answers.cluster_facts(segmented(spark, folder), persona_rows(spark, folder), "Segment")


def answer_table(spark, folder):
    facts = stage(_facts(spark, folder), "facts")
    parts = [
        answers.churn_answer(facts),
        answers.revenue_answer(facts),
        answers.density_answer(segmented(spark, folder), "Density_Label"),
        answers.general_answer(facts, F.lit(6)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _benchmark_rows(spark, folder):
    """Two labelings of the vectors as a benchmark table, rounded to what is reported."""
    vectors = _with_nearest(spark, folder)
    scored = quality.evaluate(vectors, "vec_id", "x", ["label", "nearest"], bound=0.0)
    return scored.select(
        F.col("run").alias("algorithm"), rounded("silhouette", 4).alias("silhouette_score"),
        rounded("davies_bouldin", 4).alias("davies_bouldin"),
    )


def answer_benchmark(spark, folder):
    return answers.benchmark_answer(_benchmark_rows(spark, folder), 10)


def question_routing(spark, folder):
    """Every turn of a conversation read as a question, routed and answered."""
    asked = tables.table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    replies = answer_table(spark, folder).select("category", "answer")
    return answers.answer_questions(asked, "question", replies).select(
        "conv_id", "turn", "question", "category", "answer"
    )


def report_lines(spark, folder):
    rows = stage(persona_rows(spark, folder), "personas")
    latest = customers(spark, folder).agg(F.max("First_Order_Month")).scalar()
    facts = {
        "data_source": F.lit("orders"), "trained_at": latest, "production_model": F.lit(catalog.MODEL_KMEANS),
        "anomaly_model": F.lit("DBSCAN"), "optimal_k": F.lit("6"), "best_benchmark": F.lit(None).cast("string"),
        "stability": F.lit(None).cast("string"),
    }
    return report.executive_report(rows, personas.campaign_priority(rows), anomaly_counts(spark, folder), facts)


# --- cluster quality ----------------------------------------------------------------


def _with_nearest(spark, folder):
    vectors = _vectors(spark, folder)
    centres = quality.centroids(vectors, "x", ["label"]).select("label", "centre")
    return quality.nearest_centre(vectors, "x", centres)


def nearest_centroid(spark, folder):
    return _with_nearest(spark, folder).select(
        "vec_id", "nearest", rounded("nearest_distance", 6).alias("distance")
    )


def nearest_within(spark, folder):
    """Rows further than 2.5 eps from every centroid become noise."""
    vectors = _vectors(spark, folder)
    return dbscan.assign_nearest(vectors, "x", vectors, "x", "label", 0.36).select("vec_id", "DBSCAN_Cluster")


def _geometry(spark, folder):
    return quality.geometry_scores(quality.cluster_geometry(_vectors(spark, folder), "x", ["label"]))


def davies_bouldin(spark, folder):
    return _geometry(spark, folder).select(rounded("davies_bouldin", 6).alias("davies_bouldin"))


def calinski_harabasz(spark, folder):
    return _geometry(spark, folder).select(
        "n_clusters", rounded("calinski_harabasz", 6).alias("calinski_harabasz")
    )


def silhouette_euclidean(spark, folder):
    rows = silhouette.euclidean_rows(_vectors(spark, folder), "vec_id", "x", ["label"])
    return rows.agg(rounded(F.avg("silhouette"), 6).alias("silhouette_euclidean"))


def silhouette_squared_euclidean(spark, folder):
    rows = quality.silhouette_rows(_vectors(spark, folder), "vec_id", "x", ["label"])
    return rows.agg(rounded(F.avg("silhouette"), 6).alias("silhouette_squared_euclidean"))


def silhouette_samples(spark, folder):
    rows = silhouette.euclidean_rows(_vectors(spark, folder), "vec_id", "x", ["label"])
    profile = quality.silhouette_profile(rows, "vec_id", points=10)
    return profile.select("label", "place", rounded("silhouette", 6).alias("silhouette"))


def clustering_benchmark(spark, folder):
    """Three labelings of the vectors side by side: given, nearest centre, and one whose
    classes 8 and 9 are noise."""
    vectors = _with_nearest(spark, folder).withColumn(
        "partly", F.when(F.col("label") >= 8, F.lit(-1)).otherwise(F.col("label"))
    )
    return selection.benchmark(
        vectors, "vec_id", {"given": "label", "nearest": "nearest", "partly noise": "partly"}, "x", bound=0.0
    )


def class_report(spark, folder):
    """Nearest centres read as a classifier of the given classes."""
    found = supervised.classification_report(_with_nearest(spark, folder), "label", "nearest")
    return found.select(
        "class", "support", "accuracy",
        *[rounded(c, 6).alias(c) for c in ("precision", "recall", "f1_score")], "weighted_f1_score",
    )


def adjusted_rand(spark, folder):
    found = quality.adjusted_rand(_with_nearest(spark, folder), "label", "nearest")
    return found.select(rounded("adjusted_rand_index", 9).alias("adjusted_rand_index"))


def _matrix(spark, folder):
    df = customers(spark, folder)
    model = features.fit_features(df)
    return model, model.transform(df).select("Customer_ID", "features")


def standard_scaled(spark, folder):
    df = customers(spark, folder)
    scaled = features.fit_features(df).transform(df)
    x = quality.as_array(scaled, "features")
    return scaled.select(
        "Customer_ID",
        *[rounded(F.get(x, F.lit(i)), 6).alias(f"x{i}") for i in range(len(catalog.MATRIX_NUMERICS))],
        F.array_join(
            F.transform(F.slice(x, len(catalog.MATRIX_NUMERICS) + 1, 64), lambda v: v.cast("int").cast("string")), ""
        ).alias("flags"),
    )


DBSCAN_EPS, DBSCAN_MIN_SAMPLES = 1.2, 5


def dbscan_labels(spark, folder):
    _, matrix = _matrix(spark, folder)
    found = dbscan.dbscan(matrix, "Customer_ID", "features", [dbscan.Setting(DBSCAN_EPS, DBSCAN_MIN_SAMPLES)])
    return found.select("Customer_ID", "label")


# --- logs and streams ---------------------------------------------------------------


def _records(spark, folder):
    return customers(spark, folder).select(
        F.col("Customer_ID").alias("customer_id"), F.col("Recency_Days").alias("recency_days"),
        F.col("Frequency_Orders").alias("frequency_orders"), F.col("Monetary_Spend").alias("monetary_spend"),
        F.col("First_Order_Month").alias("created_at"),
        F.when(F.col("Region") != "AFRICA", F.col("Region")).alias("tenant_id"),
    )


def transaction_log(spark, folder):
    return sinks.transaction_rows(_records(spark, folder), F.col("created_at"), F.col("tenant_id"))


def audit_log(spark, folder):
    return sinks.audit_rows(
        _records(spark, folder), F.lit("transaction_ingested"), ["customer_id", "frequency_orders"],
        F.col("created_at"), F.col("tenant_id"),
    )


def _alerts(spark, folder):
    hits = kpis.alert_candidates(_flagged(spark, folder)).select(
        F.col("Customer_ID").alias("customer_id"), F.col("Recency_Days").alias("recency_days"),
        F.col("First_Order_Month").alias("created_at"), "alert_type",
        F.when(F.col("Region") != "AFRICA", F.col("Region")).alias("tenant_id"),
    )
    return sinks.alert_rows(
        hits, F.col("alert_type"), ["customer_id", "recency_days"], F.col("created_at"), F.col("tenant_id")
    )


def alert_log(spark, folder):
    return _alerts(spark, folder)


def recent_alerts(spark, folder):
    return sinks.recent_alerts(_alerts(spark, folder), "ASIA", 15)


def ingest_stream(spark, folder):
    return flows.replay(spark, _records(spark, folder), flows.ingest, "ingest")


def ingest_log_stream(spark, folder):
    return flows.replay(spark, _records(spark, folder), flows.transactions, "ingest-log")


def ingest_once_stream(spark, folder):
    """Every record is sent twice; the log holds it once."""
    return flows.replay(spark, _records(spark, folder), flows.transactions_once, "ingest-once", sent=2)


def _alert_replay(spark, folder, transform, sent):
    rows = customers(spark, folder).select(
        "Customer_ID", "Recency_Days", "Churn_Risk_Index", "Support_Tickets", "First_Order_Month", "Region")
    flagged = lambda df: df.withColumn("Is_Anomaly", F.col("Support_Tickets") >= 3)
    told = lambda df: transform(flagged(df), F.col("First_Order_Month"), F.col("Region"))
    return flows.replay(spark, rows, told, "alerts", sent)


def alert_stream(spark, folder):
    return _alert_replay(spark, folder, flows.alerts, 1)


def alert_once_stream(spark, folder):
    """Every customer is scored twice; an alert is given once."""
    return _alert_replay(spark, folder, flows.alerts_once, 2)


# --- learned models -----------------------------------------------------------------

_fits: dict[tuple[str, str, str], object] = {}


def _fitted(spark, folder, name, fit):
    """A model that several queries use is fitted once for each folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _fits:
        _fits[key] = fit()
    return _fits[key]


def _fixed(spark, folder):
    def build():
        df = customers(spark, folder)
        model = features.fit_features(df)
        return model, clustering.fixed_matrix(model.transform(df), "Customer_ID")

    return _fitted(spark, folder, "matrix", build)


def _grid(spark, folder):
    def build():
        grid, fits = clustering.kmeans_grid(_fixed(spark, folder)[1], "Customer_ID")
        grid = stage(grid, "grid")
        return grid, fits, clustering.best_k(grid)

    return _fitted(spark, folder, "grid", build)


def _boosted(spark, folder):
    def build():
        model, matrix = _fixed(spark, folder)
        df = customers(spark, folder).join(matrix, "Customer_ID")
        return supervised.fit_ltv_boosting(df, model.names, supervised.ltv_target(df))

    return _fitted(spark, folder, "boosting", build)


def _flagged_by_forest(spark, folder):
    def build():
        forest, flagged = isolation.fit_predict(customers(spark, folder), "Customer_ID")
        return forest, stage(flagged, "forest")

    return _fitted(spark, folder, "forest", build)


#: Fits that several queries share, for timing them by name.
SHARED_FITS = {"matrix": _fixed, "kmeans_grid": _grid, "boosting": _boosted, "forest": _flagged_by_forest}


def kmeans_grid(spark, folder):
    return _grid(spark, folder)[0]


def gmm_bic(spark, folder):
    return clustering.mixture_grid(_fixed(spark, folder)[1], "Customer_ID")


def gmm_memberships(spark, folder):
    matrix, k = _fixed(spark, folder)[1], _grid(spark, folder)[2]
    fit = _fitted(spark, folder, "mixture", lambda: clustering.fit_mixture(matrix, k, id_col="Customer_ID"))
    soft = fit.transform(matrix, probability="p")
    return soft.select("Customer_ID", "GMM_Cluster", F.col("p").alias("memberships"))


def ward_labels(spark, folder):
    return ward.ward_labels(_fixed(spark, folder)[1], "Customer_ID", _grid(spark, folder)[2])


def _density_grid(spark, folder):
    return _fitted(spark, folder, "density", lambda: stage(
        dbscan.tune(_fixed(spark, folder)[1], "Customer_ID", "features"), "density"))


def dbscan_tune(spark, folder):
    return _density_grid(spark, folder)


def answer_density_tuned(spark, folder):
    """AGG-15 with the best setting of the tuning grid."""
    return answers.density_answer(segmented(spark, folder), "Density_Label", _density_grid(spark, folder))


def kmeans_stability(spark, folder):
    runs = stability.stability_runs(_fixed(spark, folder)[1], "Customer_ID", _grid(spark, folder)[2])
    return stability.stability_summary(runs)


def automl_board(spark, folder):
    return selection.leaderboard(_fixed(spark, folder)[1], "Customer_ID", _grid(spark, folder)[2])


def pca3(spark, folder):
    matrix = _fixed(spark, folder)[1]
    return projection.fit_projection(matrix).transform(matrix, digits=4).drop("features")


def pca_scatter(spark, folder):
    model, matrix = _fixed(spark, folder)
    placed = projection.fit_projection(matrix).transform(matrix).drop("features")
    return projection.scatter(segmented(spark, folder).join(placed, "Customer_ID"), "Segment", 1_500)


def isolation_forest(spark, folder):
    return _flagged_by_forest(spark, folder)[1].select("Customer_ID", "Is_Anomaly", "Anomaly_Score", "Anomaly_Type")


def isolation_summary(spark, folder):
    return isolation.forest_summary(_flagged_by_forest(spark, folder)[1])


def segment_classifier(spark, folder):
    model, matrix = _fixed(spark, folder)
    labelled = matrix.join(segmented(spark, folder).select("Customer_ID", "Segment"), "Customer_ID")
    train, test = supervised.split(labelled, "Customer_ID")
    fitted = supervised.fit_classifier(train, model.names, "Segment")
    return supervised.classification_report(fitted.transform(test), "Segment")


def ltv_gbt(spark, folder):
    return _boosted(spark, folder).report(spark)


def ltv_ridge(spark, folder):
    df = customers(spark, folder)
    return supervised.fit_ltv_ridge(df, supervised.ltv_12m_target(df)).report(spark)


def ltv_benchmark(spark, folder):
    model, matrix = _fixed(spark, folder)
    df = customers(spark, folder).join(matrix, "Customer_ID")
    return supervised.ltv_benchmark(df, model.names)


def churn_logistic(spark, folder):
    return supervised.fit_churn(customers(spark, folder)).odds(spark)


def churn_probability(spark, folder):
    df = customers(spark, folder)
    return supervised.fit_churn(df).transform(df).select(
        "Customer_ID", "churn_probability", "retention_probability", "churn_risk_pct", "risk_category"
    )


def _scoring_models(spark, folder):
    model, matrix = _fixed(spark, folder)
    grid, _, k = _grid(spark, folder)
    kmeans = _fitted(spark, folder, "kmeans", lambda: clustering.fit_kmeans(matrix, k, id_col="Customer_ID"))
    labelled = stage(kmeans.transform(matrix), "labelled")
    df = customers(spark, folder).join(labelled, "Customer_ID")
    return scoring.ScoringModels(
        model,
        stage(personas.personas(df.drop("features"), "KMeans_Cluster"), "personas"),
        _fitted(spark, folder, "classifier", lambda: supervised.fit_classifier(labelled, model.names, "KMeans_Cluster")),
        kmeans,
        None,
        _boosted(spark, folder),
        projection.fit_projection(matrix),
        _flagged_by_forest(spark, folder)[0],
    )


def score_table(spark, folder):
    scored = scoring.score_records(customers(spark, folder), _scoring_models(spark, folder))
    return scored.select(
        "Customer_ID", "predicted_cluster", "confidence_score", "predicted_ltv_12m", "persona_title",
        "churn_risk_index", "is_anomaly", "anomaly_score", "anomaly_type", "PCA_1", "PCA_2", "PCA_3",
        "churn_summary",
    )


def scored_stream(spark, folder):
    models = _scoring_models(spark, folder)
    reply = lambda df: scoring.ingest_reply(scoring.score_records(flows.full_records(df), models))
    return flows.replay(spark, _records(spark, folder), reply, "scored")


def training_run(spark, folder):
    """The whole job on the customer table; returns the description of the run."""
    run = training.train(customers(spark, folder), data_source="uploaded_csv:customers.csv")
    return run.tables["run"].drop("trained_at_utc", "model_path")


EXACT: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "customer_table": customer_table,
    "conform_clip": conform_clip,
    "input_validation": input_validation,
    "csv_round_trip": csv_round_trip,
    "tenant_partition": tenant_partition,
    "tenant_replaced": tenant_replaced,
    "dataset_status": dataset_status,
    "model_info": model_info,
    "conform_warnings": conform_warnings,
    "upload_lines": upload_lines,
    "imported_drivers": imported_drivers,
    "imported_campaigns": imported_campaigns,
    "imported_runs": imported_runs,
    "arrival_ids": arrival_ids,
    "churn_rfm": _churn(churn.churn_rfm),
    "churn_gen": _churn(churn.churn_generated),
    "churn_single": _churn(churn.churn_single),
    "churn_pred": _churn(churn.churn_predicted),
    "churn_labels": churn_labels,
    "churn_drivers": churn_drivers,
    "churn_driver_lists": churn_driver_lists,
    "risk_bands": risk_bands,
    "rfm_train": _rfm("training"),
    "rfm_analytics": _rfm("analytics"),
    "rfm_grid": rfm_grid,
    "rfm_cohorts": rfm_cohorts,
    "overview_kpis": overview_kpis,
    "distinct_labels": distinct_labels,
    "exact_quantiles": exact_quantiles,
    "persona_profile": persona_profile,
    "persona_rules": persona_rules,
    "persona_per_customer": persona_per_customer,
    "segment_drivers": segment_drivers,
    "campaign_priority": campaign_priority,
    "campaign_copy": campaign_copy,
    "high_risk_topk": high_risk_topk,
    "target_cohort": target_cohort,
    "micro_segment": micro_segment,
    "currency_view": currency_view,
    "alert_candidates": alert_candidates,
    "anomaly_severity": anomaly_severity,
    "anomaly_counts": anomaly_counts,
    "anomaly_types": anomaly_types,
    "anomaly_type_counts": anomaly_type_counts,
    "scenario_compare": scenario_compare,
    "retention_curve": retention_curve,
    "cohort_retention_observed": cohort_retention_observed,
    "answer_table": answer_table,
    "answer_benchmark": answer_benchmark,
    "question_routing": question_routing,
    "report_lines": report_lines,
    "nearest_centroid": nearest_centroid,
    "nearest_within": nearest_within,
    "davies_bouldin": davies_bouldin,
    "calinski_harabasz": calinski_harabasz,
    "silhouette_euclidean": silhouette_euclidean,
    "silhouette_squared_euclidean": silhouette_squared_euclidean,
    "silhouette_samples": silhouette_samples,
    "clustering_benchmark": clustering_benchmark,
    "class_report": class_report,
    "adjusted_rand": adjusted_rand,
    "standard_scaled": standard_scaled,
    "dbscan_labels": dbscan_labels,
    "transaction_log": transaction_log,
    "audit_log": audit_log,
    "alert_log": alert_log,
    "recent_alerts": recent_alerts,
    "ingest_stream": ingest_stream,
    "ingest_log_stream": ingest_log_stream,
    "conform_fragments": conform_fragments,
    "conform_magnitudes": conform_magnitudes,
    "upload_schema": upload_schema,
    "alert_stream": alert_stream,
    "ingest_once_stream": ingest_once_stream,
    "alert_once_stream": alert_once_stream,
}

# results that depend on learned models or on text without a SQL counterpart
ROWS_ONLY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kmeans_grid": kmeans_grid,
    "gmm_bic": gmm_bic,
    "gmm_memberships": gmm_memberships,
    "ward_labels": ward_labels,
    "dbscan_tune": dbscan_tune,
    "answer_density_tuned": answer_density_tuned,
    "kmeans_stability": kmeans_stability,
    "automl_board": automl_board,
    "pca3": pca3,
    "pca_scatter": pca_scatter,
    "isolation_forest": isolation_forest,
    "isolation_summary": isolation_summary,
    "segment_classifier": segment_classifier,
    "ltv_gbt": ltv_gbt,
    "ltv_ridge": ltv_ridge,
    "ltv_benchmark": ltv_benchmark,
    "churn_logistic": churn_logistic,
    "churn_probability": churn_probability,
    "score_table": score_table,
    "scored_stream": scored_stream,
    "training_run": training_run,
}

ALL = {**EXACT, **ROWS_ONLY}
