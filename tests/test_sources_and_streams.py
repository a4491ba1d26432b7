import pytest
from pyspark.sql import functions as F

from clientlens.functions import catalog
from clientlens.operators import kpis, scoring
from clientlens.plans import queries, training
from clientlens.session import new_path, stage
from clientlens.sources import sinks, synthetic, uploads
from clientlens.streaming import flows


def test_synthetic_ranges_and_shares(spark):
    df = stage(synthetic.synthetic_customers(spark, 6000))
    assert df.count() == 6000 and df.select("Customer_ID").distinct().count() == 6000
    assert df.where("Customer_ID = 'CUST-10001'").count() == 1
    counts = {r["Archetype"]: r["n"] for r in df.groupBy("Archetype").agg(F.count("*").alias("n")).collect()}
    for name, share, ranges, channels, _ in catalog.ARCHETYPES:
        assert counts[name] / 6000 == pytest.approx(share, abs=0.03)
        part = df.where(F.col("Archetype") == name)
        for (column, whole), (low, high) in zip(catalog.ARCHETYPE_COLUMNS, ranges):
            bounds = part.agg(F.min(column), F.max(column)).first()
            assert bounds[0] >= low and (bounds[1] < high or not whole and bounds[1] <= high)
        assert {r[0] for r in part.select("Preferred_Channel").distinct().collect()} <= {c for c, _ in channels}
    assert df.where("Churn_Risk_Index < 0 or Churn_Risk_Index > 1").count() == 0
    assert df.repartition(3).exceptAll(synthetic.synthetic_customers(spark, 6000)).count() == 0


def test_tenants_are_kept_apart(spark, customers):
    shared, tenants = new_path(spark, "shared"), new_path(spark, "tenants")
    sinks.write_customers(customers, shared)
    sinks.write_customers(customers.limit(10), tenants, "a")
    sinks.write_customers(customers.limit(15), tenants, "b")
    sinks.write_customers(customers.limit(12), tenants, "a")
    size = lambda tenant: uploads.resolve_dataset(spark, tenant, shared, tenants).count()
    assert (size("a"), size("b"), size("c")) == (12, 15, customers.count())
    plan = spark.read.parquet(tenants).where("tenant_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan
    with pytest.raises(FileNotFoundError):
        uploads.resolve_dataset(spark, None, new_path(spark, "none"))


def test_run_tables_fall_back(spark):
    first, second = new_path(spark, "run"), new_path(spark, "run")
    sinks.write_run({"run": spark.range(3)}, second)
    assert uploads.resolve_run(spark, [first, second], "run").count() == 3
    assert uploads.resolve_run(spark, [first], "run") is None


def test_logs_append_and_list(spark, customers):
    path = new_path(spark, "alerts")
    hits = customers.limit(5).select(F.lit(None).cast("string").alias("customer_id"), "Recency_Days", "First_Order_Month")
    rows = sinks.alert_rows(hits, F.lit("HIGH_CHURN_RISK"), ["Recency_Days"], F.col("First_Order_Month"))
    sinks.append_log(rows, path)
    sinks.append_log(rows.withColumn("tenant_id", F.lit("t")), path)
    log = spark.read.parquet(path)
    assert log.count() == 10
    latest = sinks.recent_alerts(log, "t", 3).collect()
    assert len(latest) == 3 and latest[0]["created_at"] == max(r["created_at"] for r in rows.collect())
    assert {r["customer_id"] for r in latest} == {"N/A"}


def test_ingest_stream_equals_batch(spark, folder):
    records = queries._records(spark, folder)
    assert flows.replay(spark, records, flows.ingest, "t").exceptAll(flows.ingest(records)).count() == 0


def test_alert_stream_equals_batch(spark, customers):
    flagged = customers.withColumn("Is_Anomaly", F.col("Return_Rate") > 0.45)
    alert = lambda df: flows.alerts(df, F.col("First_Order_Month"))
    streamed = flows.replay(spark, flagged, alert, "t")
    batch = alert(flagged)
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0


def test_different_log_rows_have_different_ids(spark):
    rows = [("c", 1, 2, 3.0, "t", None), ("c", 1, 2, 3.5, "t", None), ("c", 1, 3, 3.0, "t", None), ("c", 1, 2, 3.0, "t", None)]
    df = spark.createDataFrame(
        rows, "customer_id string, recency_days int, frequency_orders int, monetary_spend double, created_at string, tenant_id string")
    ids = [r["id"] for r in sinks.transaction_rows(df, F.col("created_at"), F.col("tenant_id")).collect()]
    assert len(set(ids)) == 3 and ids[0] == ids[3] and all(len(i) == 35 for i in ids)


def test_unreadable_runs_are_raised(spark):
    path = new_path(spark, "broken")
    spark.sql("select 'x' as v").write.text(f"{path}/run")
    with pytest.raises(Exception):
        uploads.resolve_run(spark, [path], "run").count()


def test_stream_resumes_where_it_stopped(spark, customers):
    source, sink, state = (new_path(spark, n) for n in ("in", "out", "state"))
    records = customers.select(
        "Customer_ID", "Recency_Days", "Churn_Risk_Index", F.lit(True).alias("Is_Anomaly"), "First_Order_Month")
    for expected in (1, 2):
        records.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(records.schema).parquet(source)
        flows.run_available(flows.alerts(stream, F.col("First_Order_Month")), sink, state)
        assert spark.read.parquet(sink).count() == expected * records.count()


def test_scored_stream_equals_batch(spark, folder):
    from clientlens.operators import scoring

    models = queries._scoring_models(spark, folder)
    reply = lambda df: scoring.ingest_reply(scoring.score_records(flows.full_records(df), models))
    records = queries._records(spark, folder)
    streamed = flows.replay(spark, records, reply, "t")
    assert streamed.count() == records.count()
    assert streamed.exceptAll(reply(records)).count() == 0


def test_audience_nobody_meets_is_everyone(customers):
    none = customers.withColumn("Churn_Risk_Index", F.lit(0.1))
    assert kpis.target_cohort(none, "at_risk").count() == customers.count()
    assert kpis.target_cohort(customers, "unknown").count() == customers.count()


def test_training_run(spark, nine):
    options = training.Options((2, 3), 1, 1, 20, 5, 3, 1, 1)
    run = training.train_demo(spark, 120, options=options)
    row = run.tables["run"].first()
    assert row["total_samples"] == 120 == run.customers.count()
    assert row["data_source"] == "synthetic_demo_120"
    again = training.load_run(spark, run.folder)
    new = run.customers.select(*[c for c in catalog.RECORD_FIELDS if c in run.customers.columns], "Customer_ID")
    scored = scoring.score_records(new, run.models)
    assert scored.exceptAll(scoring.score_records(new, again.models)).count() == 0
    plain = lambda models: scoring.ScoringModels(models.features, models.personas, kmeans=models.kmeans)
    both = [scoring.score_records(new, plain(m)).select("Customer_ID", "predicted_cluster") for m in (run.models, again.models)]
    assert both[0].exceptAll(both[1]).count() == 0
    assert both[0].exceptAll(run.customers.select("Customer_ID", "KMeans_Cluster")).count() <= 12
    assert {"KMeans_Cluster", "DBSCAN_Cluster", "HAC_Cluster", "GMM_Cluster", "PCA_3", "Is_Anomaly",
            "RFM_Group"} <= set(run.customers.columns)
    assert run.tables["benchmark"].count() == 4
    status = [r["status"] for r in spark.read.parquet(f"{run.folder}/status").orderBy("recorded_at").collect()]
    assert status[0] == "queued" and status[-1] == "completed"
    shown = uploads.dataset_status(run.tables["run"]).first()
    assert (shown["is_custom"], shown["total_samples"]) == (False, 120)
    folder = f"{run.folder}/tables"
    assert uploads.model_info(sinks.current_run(spark, folder)).first()["production_model"] == catalog.MODEL_KMEANS
    for model in (catalog.MODEL_WARD, catalog.MODEL_GMM):
        sinks.set_production_model(spark, folder, model)
        assert uploads.model_info(sinks.current_run(spark, folder)).first()["production_model"] == model
    with pytest.raises(ValueError):
        training.train(nine.drop("Monetary_Spend"), folder=new_path(spark, "bad"))


def test_no_line_of_an_upload_is_lost(spark):
    """Short, long, badly quoted and unreadable lines; quoted separators, blanks and empty fields are fine."""
    from pyspark.sql import types as T

    good = ["1,2.5,ann", '2,,"b, c"', "3,1e3,", '4,7,"say ""so"""']
    bad = {"5,1": "too few fields", "6,1,x,y": "too many fields", '7,1,"open': "open quote", "eight,1,x": "unreadable value",
           "9": "too few fields", '"a,b",1,x,y': "too many fields"}
    path = new_path(spark, "lines")
    spark.createDataFrame([(x,) for x in [*good, "", *bad]], "value string").coalesce(1).write.text(path)
    schema = T.StructType.fromDDL("id long, spend double, name string")
    rows, rejected = uploads.read_checked(spark, path, schema, header=False)
    assert {r["line"]: r["reason"] for r in rejected.collect()} == bad
    assert sorted(map(tuple, rows.collect())) == [(1, 2.5, "ann"), (2, None, "b, c"), (3, 1000.0, None), (4, 7.0, 'say "so"')]
    assert rows.columns == ["id", "spend", "name"]


def test_a_record_sent_again_adds_nothing_and_old_records_are_not_late(spark):
    record = lambda i, month: (str(i), 10 * i, 3, 50.0, month, None)
    first = spark.createDataFrame([record(i, "2024-05") for i in range(6)], flows.INGEST_SCHEMA)
    source, sink, state = (new_path(spark, f"again-{part}") for part in ("in", "out", "state"))

    def run(records):
        records.write.mode("append").parquet(source)
        flows.run_available(flows.transactions_once(spark.readStream.schema(flows.INGEST_SCHEMA).parquet(source)), sink, state)
        return {r["customer_id"]: r["created_at"] for r in spark.read.parquet(sink).collect()}, spark.read.parquet(sink).count()

    assert run(first.unionByName(first))[1] == 6
    assert run(first)[1] == 6
    old = spark.createDataFrame([record(7, "1990-01"), record(2, "2024-05")], flows.INGEST_SCHEMA)
    found, count = run(old)
    assert count == 7 and found["7"] == "1990-01"


def test_run_documents_give_the_tables_they_were_made_of(spark):
    """Round trip of nested tables, names of files, missing parts, and what cannot be read."""
    import json

    from clientlens.sources import run_documents

    whole = {
        "data_source": "uploaded_csv:a.csv", "total_samples": 9, "optimal_k": 2, "validation_warnings": ["one", "two"], "other": {"x": [1]},
        "classifier_metrics": {"accuracy": 0.5, "weighted_f1_score": 0.25, "report": {
            "0": {"precision": 1.0, "recall": 0.5, "f1-score": 0.6667, "support": 2.0}, "accuracy": 0.5}},
        "k_search_grid": [{"k": 2, "inertia": 9.76, "silhouette_score": 0.5384, "is_minibatch": False}, {"k": 3, "inertia": 5}],
        "kmeans_centroids": [[0.5, -1.0], [2, 3]],
        "pca_metadata": {"variance_explained_per_component": [0.75, 0.25], "total_variance_explained": 1.0},
        "benchmark_comparison": [{"Algorithm": "K-Means", "Clusters": 2, "Outliers/Noise": 0, "Silhouette_Score": 0.5}],
        "persona_summary": {"total_revenue": 45.0, "clusters": [{"cluster_id": 1, "persona_key": "A", "metrics": {"customer_count": 6, "share": 66.67}}]},
        "segment_explanations": [{"cluster_id": 0, "sample_size": 6, "plain_english": "x", "top_drivers": [
            {"feature": "f", "direction": "above average", "strength": 0.5}, {"feature": "g", "strength": 0.25}]}],
        "stability_report": {"mean_adjusted_rand_index": 0.5149},
    }
    path = new_path(spark, "run-documents")
    texts = {"full": json.dumps(whole, indent=2), "bare": "{}", "blank": " \n", "cut": json.dumps(whole)[:-5], "number": "7",
             "list": "[{}]", "twice": "{} {}", "wrong": '{"optimal_k": "many"}'}
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, text in texts.items():
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.json"))
        out.write(bytearray(text.encode()))
        out.close()
    documents, rejected = run_documents.read_documents(spark, path)
    assert {r["file"]: r["reason"] for r in rejected.collect()} == {
        "cut.json": "not a run document", "number.json": "not a run document", "list.json": "not a run document",
        "twice.json": "not a run document", "wrong.json": "unreadable value"}
    got = {name: sorted((r.asDict(True) for r in df.collect()), key=str) for name, df in run_documents.run_tables(documents).items()}
    bare, full = sorted(got["run"], key=lambda r: r["run_id"])
    assert (full["run_id"], full["total_samples"], full["stability_mean"], full["classifier_accuracy"]) == ("full", 9, 0.5149, 0.5)
    assert bare["run_id"] == "bare" and set(bare.values()) == {"bare", None}
    assert {(r["position"], r["warning"]) for r in got["warnings"]} == {(0, "one"), (1, "two")}
    assert got["classifier_report"] == [{"run_id": "full", "class": "0", "precision": 1.0, "recall": 0.5, "f1_score": 0.6667, "support": 2}]
    assert [(r["k"], r["inertia"], r["silhouette_score"]) for r in got["k_grid"]] == [(2, 9.76, 0.5384), (3, 5.0, None)]
    assert got["centres"] == [{"run_id": "full", "cluster_id": 0, "centre": [0.5, -1.0]}, {"run_id": "full", "cluster_id": 1, "centre": [2.0, 3.0]}]
    assert [(r["component"], r["ratio"]) for r in got["pca"]] == [(1, 0.75), (2, 0.25)]
    assert [(r["algorithm"], r["noise"], r["silhouette_score"], r["davies_bouldin"]) for r in got["benchmark"]] == [("K-Means", 0, 0.5, None)]
    assert got["personas"][0]["metrics"] == {"customer_count": 6.0, "share": 66.67}
    assert [d["feature"] for d in got["segment_drivers"][0]["top_drivers"]] == ["f", "g"]
    assert got["anomalies"] == got["campaigns"] == []

    tables = run_documents.run_tables(documents)
    made = run_documents.documents_of(tables["run"].withColumn("mine", F.lit(1)), {
        "benchmark_comparison": tables["benchmark"], "k_search_grid": tables["k_grid"], "segment_explanations": tables["segment_drivers"]})
    lines = new_path(spark, "run-lines")
    made.select("document").write.text(lines)
    again, none = run_documents.read_documents(spark, lines, one_a_line=True)
    assert none.count() == 0 and again.count() == 2
    for name in ("benchmark", "k_grid", "segment_drivers"):
        assert sorted(map(str, run_documents.run_tables(again)[name].collect())) == sorted(map(str, tables[name].collect()))
    empty, lost = run_documents.read_documents(spark, lines + "/_SUCCESS*", one_a_line=True)
    assert empty.count() == lost.count() == 0


def test_tables_are_replaced_as_a_whole(spark):
    """A write that fails half-way changes nothing; choices count in order; writers do not undo each other."""
    from clientlens.sources import versions

    folder = new_path(spark, "versions")
    rows = lambda name: sorted(r["id"] for r in versions.newest(spark, folder).read(spark, name).collect())
    assert versions.newest(spark, folder) is None and versions.discard_old(spark, folder) == 0
    versions.commit(spark, folder, {"a": spark.range(3), "b": spark.range(2)})
    breaking = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        versions.commit(spark, folder, {"a": spark.range(9), "b": breaking})
    assert rows("a") == [0, 1, 2] and rows("b") == [0, 1]
    versions.commit(spark, folder, {"a": versions.newest(spark, folder).read(spark, "a").where("id > 0")}, {"x": "1"})
    assert rows("a") == [1, 2] and rows("b") == [0, 1]
    # a number that is taken is not taken twice
    assert not versions._publish(spark, folder, 2, "{}")
    assert versions.newest(spark, folder).number == 2 and versions.newest(spark, folder).values == {"x": "1"}
    assert versions.discard_old(spark, folder) == 4  # two of the failed write, the first a, the first manifest
    assert rows("a") == [1, 2] and rows("b") == [0, 1]

    tenants = new_path(spark, "tenants")
    assert sinks.tenant_rows(spark, tenants, "t/1") is None
    sinks.replace_tenant(spark.range(5), tenants, "t/1")
    with pytest.raises(Exception, match="broken"):
        sinks.replace_tenant(breaking, tenants, "t/1")
    sinks.replace_tenant(spark.range(1), tenants, "t")
    assert sinks.tenant_rows(spark, tenants, "t/1").count() == 5 and sinks.tenant_rows(spark, tenants, "t").count() == 1
