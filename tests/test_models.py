"""Learned models against closed forms and by their structure."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientlens.functions import catalog, churn
from clientlens.functions.expressions import exact_sum
from clientlens.operators import (
    clustering,
    features,
    isolation,
    kpis,
    projection,
    quality,
    scoring,
    selection,
    silhouette,
    stability,
    supervised,
    ward,
)
from clientlens.session import new_path, stage
from clientlens.sources.synthetic import synthetic_customers

ID = "Customer_ID"


@pytest.fixture(scope="module")
def table(spark):
    return stage(synthetic_customers(spark, 400))


@pytest.fixture(scope="module")
def model(table):
    return features.fit_features(table)


@pytest.fixture(scope="module")
def matrix(table, model):
    return clustering.fixed_matrix(model.transform(table), ID)


def dense(matrix):
    rows = matrix.orderBy(ID).collect()
    return np.array([r["features"].toArray() for r in rows])


def raw(table):
    pdf = table.orderBy(ID).toPandas()
    x = pdf[catalog.MODEL_FEATURES].to_numpy(dtype=float)
    return pdf, (x - x.mean(axis=0)) / x.std(axis=0)


def test_matrix_is_standardised(table, model, matrix):
    x = dense(matrix)
    assert x.shape == (400, len(model.names))
    assert np.allclose(x[:, :9].mean(axis=0), 0, atol=1e-9) and np.allclose(x[:, :9].std(axis=0), 1, atol=1e-9)
    assert set(np.unique(x[:, 9:])) <= {0.0, 1.0}


def test_matrix_of_new_records(spark, table, model):
    path = new_path(spark, "features")
    model.save(path)
    again = features.FeatureModel.load(path)
    assert again.names == model.names
    new = table.limit(1).drop("Churn_Risk_Index", "Avg_Order_Value").withColumn("Gender", F.lit("other"))
    x = again.transform(new, new_records=True).first()["features"].toArray()
    assert len(x) == len(model.names) and x[-3:].sum() == 0


def test_kmeans_cost_is_the_inertia_of_its_labels(matrix):
    fit = clustering.fit_kmeans(matrix, 4, starts=2)
    labels = np.array([r["KMeans_Cluster"] for r in fit.transform(matrix).orderBy(ID).collect()])
    x = dense(matrix)
    inertia = sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in range(4))
    assert fit.cost == pytest.approx(inertia, rel=1e-3)
    sizes = np.bincount(labels)
    assert (np.diff(sizes) <= 0).all()


def test_mixture_criteria(matrix):
    fit = clustering.fit_mixture(matrix, 2)
    d = dense(matrix).shape[1]
    assert fit.parameters == 2 * d + 2 * d * (d + 1) // 2 + 1
    assert fit.bic - fit.aic == pytest.approx(fit.parameters * (math.log(400) - 2))
    soft = fit.transform(matrix, probability="p").first()
    assert sum(soft["p"]) == pytest.approx(1.0) and soft["GMM_Cluster"] == int(np.argmax(soft["p"]))


def plain_mixture(x, centres, rounds):
    """Expectation-maximisation in numpy from hard labels; log-likelihood after each round."""
    label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    shares, trail = np.eye(len(centres))[label], []
    for _ in range(rounds + 1):
        mass = shares.sum(axis=0)
        means = shares.T @ x / mass[:, None]
        covs = [(x - m).T @ ((x - m) * shares[:, [c]]) / mass[c] + clustering.REGULAR * np.eye(x.shape[1]) for c, m in enumerate(means)]
        logs = np.stack([
            np.log(mass[c] / len(x)) - 0.5 * (np.linalg.slogdet(2 * np.pi * covs[c])[1]
            + ((x - means[c]) @ np.linalg.inv(covs[c]) * (x - means[c])).sum(axis=1)) for c in range(len(mass))], axis=1)
        total = np.logaddexp.reduce(logs, axis=1)
        trail.append(total.sum())
        shares = np.exp(logs - total[:, None])
    return trail, shares


def test_mixtures_of_all_sizes_equal_numpy_and_the_library(spark):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + m for m in ([0, 0, 0], [7, 1, 0], [0, 8, 5])])
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, x array<double>").repartition(3)
    starts = {k: x[rng.permutation(len(x))[:k]] for k in (2, 3, 5)}
    found = clustering.fit_mixtures(points.select("x"), starts, rounds=6, settled=-1.0)
    for k, fit in found.items():
        trail, shares = plain_mixture(x, starts[k], 6)
        assert trail == sorted(trail) and fit.log_likelihood == pytest.approx(trail[-1], rel=1e-9)
        assert np.allclose(np.sort(fit.weights), np.sort(shares.mean(axis=0)), atol=0.05)
    done = clustering.fit_mixtures(points.select("x"), {3: starts[3]})[3]
    vectors = points.select("id", array_to_vector("x").alias("features"))
    library = GaussianMixture(k=3, seed=1, maxIter=100, tol=1e-4).fit(vectors)
    assert done.log_likelihood == pytest.approx(library.summary.logLikelihood, rel=1e-4)
    soft = done.transform(vectors, probability="p").collect()
    _, means, _ = done.factors()
    assert means.shape == (3, 3) and all(abs(sum(r["p"]) - 1) < 1e-9 for r in soft)


def test_starts_do_not_fall_on_copies(spark):
    """20,000 copies of a point and a few others: every k is reached, at the best cost."""
    others = [[5.0, 0.0], [0.0, 7.0], [9.0, 9.0], [-6.0, 2.0]]
    rows = [(i, [1.0, 1.0]) for i in range(20_000)] + [(20_000 + i, others[i % 4]) for i in range(12)]
    table = spark.createDataFrame(rows, "id long, features array<double>").repartition(4)
    for k in (2, 3, 5):
        fit = clustering.fit_kmeans(table, k, starts=3, id_col="id")
        assert fit.k == k and fit.transform(table).select("KMeans_Cluster").distinct().count() == k
    assert fit.cost == pytest.approx(0.0, abs=1e-6) and fit.order[0] >= 0
    again = clustering.fit_kmeans(table.repartition(7), 5, starts=3, id_col="id")
    assert np.allclose(again.centres, fit.centres)


def test_fits_on_parts_of_the_rows_equal_fits_on_those_rows(spark, matrix):
    points = clustering.sized_points(matrix, ID)
    whole = clustering.fit_many(points, [clustering.Start(3, 5, (11, 0, 70)), clustering.Start(3, 6)])
    rows = points.collect()
    keys, x = np.array([r["key"] for r in rows]), np.array([r["x"] for r in rows])
    part = clustering._taking_part(keys, clustering.Start(3, 5, (11, 0, 70)))
    assert 0.55 * len(x) < part.sum() < 0.85 * len(x) and whole[0].sizes.sum() == part.sum()
    label, apart = clustering._nearest(x[part], whole[0].centres)
    assert whole[0].cost == pytest.approx(apart.sum()) and whole[1].sizes.sum() == len(x)


def test_projection_equals_singular_vectors(matrix):
    fit = projection.fit_projection(matrix)
    x = dense(matrix)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(fit.ratios, (s**2 / (s**2).sum())[:3], atol=1e-8)
    got = np.array([[r["PCA_1"], r["PCA_2"], r["PCA_3"]] for r in fit.transform(matrix).orderBy(ID).collect()])
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:3].T), atol=1e-6)


def test_ridge_equals_closed_form(table):
    pdf, x = raw(table)
    y = (pdf["Monetary_Spend"] * 1.35 + pdf["Frequency_Orders"] * 45 - pdf["Recency_Days"] * 2.5).to_numpy()
    fit = supervised.fit_ltv_ridge(table, supervised.ltv_12m_target(table), alpha=3.0)
    beta = np.linalg.solve(x.T @ x + 3.0 * np.eye(8), x.T @ (y - y.mean()))
    assert np.allclose(list(fit.model.coefficients), beta, rtol=1e-8)
    assert fit.model.intercept == pytest.approx(y.mean())
    assert fit.report(table.sparkSession).count() == 8


def test_logistic_satisfies_the_penalised_score_equations(table):
    pdf, x = raw(table)
    y = (pdf["Churn_Risk_Index"] > 0.35).to_numpy(dtype=float)
    fit = supervised.fit_churn(table)
    beta = np.array(list(fit.model.coefficients))
    p = 1 / (1 + np.exp(-(x @ beta + fit.model.intercept)))
    assert np.allclose(x.T @ (p - y) + beta, 0, atol=1e-3)
    assert (p - y).sum() == pytest.approx(0, abs=1e-3)
    assert fit.auc >= 0.5 and fit.odds(table.sparkSession).count() == 8
    assert fit.top_odds(table.sparkSession).count() == 5
    scored = fit.transform(table.select(ID, "Recency_Days", "Engagement_Score")).first()
    assert scored["churn_probability"] + scored["retention_probability"] == pytest.approx(1.0)


def test_churn_needs_two_classes(table):
    with pytest.raises(ValueError):
        supervised.fit_churn(table.withColumn("Churn_Risk_Index", F.lit(0.9)))


def test_classifier_and_boosting(spark, table, model, matrix):
    labelled = clustering.fit_kmeans(matrix, 3, starts=1).transform(matrix)
    train, test = supervised.split(labelled, ID)
    fit = supervised.fit_classifier(train, model.names, "KMeans_Cluster", 40)
    report = supervised.classification_report(fit.transform(test), "KMeans_Cluster").collect()
    assert report[0]["accuracy"] >= 0.9
    assert sum(r["support"] for r in report) == test.count()
    importances = fit.importances(spark).collect()
    assert sum(r["importance"] for r in importances) == pytest.approx(1.0, abs=0.01)
    assert importances[0]["importance"] == max(r["importance"] for r in importances)
    df = table.join(matrix, ID)
    ltv = supervised.fit_ltv_boosting(df, model.names, supervised.ltv_target(df), rounds=20, depth=4)
    assert ltv.r2 > 0.3
    assert ltv.transform(matrix).where("predicted_ltv < 0").count() == 0


def test_isolation_forest(spark, table):
    forest, flagged = isolation.fit_predict(table, ID, trees=60)
    assert flagged.where("Is_Anomaly").count() == pytest.approx(12, abs=1)
    low, high = flagged.agg(F.min("Anomaly_Score"), F.max("Anomaly_Score")).first()
    assert (low, high) == (0.0, 1.0)
    assert flagged.where("not Is_Anomaly and Anomaly_Type != 'Normal Pattern'").count() == 0
    worst = flagged.where("Is_Anomaly").agg(F.min("Anomaly_Score")).first()[0]
    assert worst >= flagged.where("not Is_Anomaly").agg(F.max("Anomaly_Score")).first()[0]
    path = new_path(spark, "forest")
    forest.save(spark, path)
    again = isolation.IsolationForest.load(spark, path)
    odd = spark.createDataFrame([(365, 1, 99999.0)], "Recency_Days int, Frequency_Orders int, Monetary_Spend double")
    row = again.predict(odd).first()
    assert 0.0 <= row["Anomaly_Score"] <= 1.0 and row["Anomaly_Type"] in (
        "VIP Whale Outlier", "Normal Pattern")
    summary = isolation.forest_summary(flagged).collect()
    assert sum(r["type_count"] for r in summary) == summary[0]["count"]


def test_isolation_paths_equal_a_plain_walk(spark, table):
    forest = isolation.fit_forest(table, ID, trees=5)
    rows = table.select(*catalog.MODEL_FEATURES).limit(20)
    got = [r["_score"] for r in forest.score(rows).collect()]
    nodes = {(r.tree, r.node): r for r in forest.nodes.itertuples()}
    for values, score in zip((list(map(float, r)) for r in rows.collect()), got):
        depths = []
        for tree in range(5):
            at = nodes[(tree, 0)]
            while at.feature >= 0:
                at = nodes[(tree, at.low if values[at.feature] <= at.threshold else at.high)]
            depths.append(at.depth + float(isolation._mean_path(at.size)))
        assert score == pytest.approx(-(2 ** (-np.mean(depths) / float(isolation._mean_path(forest.sample)))))


def test_constant_table_has_no_anomaly(spark):
    df = spark.range(20).select(
        F.col("id").alias(ID), *[F.lit(1.0).alias(c) for c in catalog.MODEL_FEATURES]
    )
    _, flagged = isolation.fit_predict(df, ID, trees=5)
    assert {(r["Is_Anomaly"], r["Anomaly_Score"]) for r in flagged.collect()} == {(False, 0.0)}


def brute_silhouette(x, labels, power=1):
    """By Euclidean distance or its square, pair by pair."""
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1)) ** power
        mine = labels == labels[i]
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[mine].sum() / (mine.sum() - 1)
        b = min(d[labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_quality_scores_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4))
    labels = rng.integers(0, 3, 80)
    labels[0] = 7  # a cluster of one
    labels[1] = -1
    df = spark.createDataFrame(
        [(i, [float(v) for v in p], int(c)) for i, (p, c) in enumerate(zip(x, labels))], "id long, x array<double>, c int"
    )
    keep = labels != -1
    wanted = brute_silhouette(x[keep], labels[keep])
    row = quality.evaluate(df, "id", "x", ["c"], bound=0.0).first()
    assert row["silhouette"] == pytest.approx(wanted.mean())
    squared = quality.silhouette_rows(df, "id", "x", ["c"]).agg({"silhouette": "avg"}).first()[0]
    assert squared == pytest.approx(brute_silhouette(x[keep], labels[keep], 2).mean())
    assert (row["n_clusters"], row["n_noise"]) == (4, 1)
    one = quality.evaluate(df.withColumn("c", F.lit(0)), "id", "x", ["c"]).first()
    assert (one["silhouette"], one["davies_bouldin"], one["calinski_harabasz"]) == (-1.0, 999.0, 0.0)


@pytest.mark.parametrize("bound", [0.0, 0.01, 0.2])
def test_euclidean_silhouettes_keep_their_bound(spark, bound):
    """Copies of a point, noise, a cluster of one and a labeling that cuts across space."""
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(900, 4)) + rng.integers(0, 3, (900, 1)) * 3, 3)
    x[:150] = x[0]
    blobs, mixed = (x.sum(axis=1) > 10).astype(int) + (x.sum(axis=1) > 20), rng.integers(-1, 4, 900)
    mixed[7] = 9
    df = spark.createDataFrame(
        [(f"r{i}", [float(v) for v in p], int(a), int(b), 1) for i, (p, a, b) in enumerate(zip(x, blobs, mixed))],
        "id string, x array<double>, a int, b int, cell int").repartition(3)
    found = silhouette.euclidean_rows(df, "id", "x", ["a", "b"], bound, cell_rows=16).toPandas()
    for run, labels in (("a", blobs), ("b", mixed)):
        keep = np.flatnonzero(labels != -1)
        own = found[found.run == run].set_index("id").loc[[f"r{i}" for i in keep]]
        assert (own.label.to_numpy() == labels[keep]).all() and len(found[found.run == run]) == len(keep)
        wanted = brute_silhouette(x[keep], labels[keep])
        assert np.abs(own.silhouette.to_numpy() - wanted).max() <= max(bound, 1e-9)
    assert silhouette.euclidean_rows(df.where("false"), "id", "x", ["a"]).count() == 0
    assert silhouette.euclidean_rows(df.where("a = 1"), "id", "x", ["a"]).where("silhouette <> 0").count() == 0


def test_far_clusters_are_never_opened():
    """With well separated clusters, most cells stay closed for a small bound."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3)) * 0.05 + np.repeat(rng.normal(size=(40, 3)) * 20, 100, axis=0)
    tree = silhouette.fit_tree(x, 64)
    cell, label = tree.cells_of(x), np.repeat(np.arange(40), 100)
    pairs, place = np.unique(np.stack([label, cell]), axis=1, return_inverse=True)
    mean = np.array([x[place == i].mean(axis=0) for i in range(pairs.shape[1])])
    spread = np.array([((x[place == i] - mean[i]) ** 2).sum(axis=1).mean() for i in range(len(mean))])
    told = silhouette.Summary(pairs[0], pairs[1], np.bincount(place), mean, spread)
    *_, row, _, opened = silhouette._needed(told, label, x, 0.01)
    assert len(opened) < 0.05 * len(x) * len(mean)


def test_silhouette_of_more_rows_than_any_sample(spark):
    """10,001 rows, and many clusters in several passes, against the closed form in numpy."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10_001, 2)) + rng.integers(0, 3, 10_001)[:, None] * 4
    labels = np.unique(rng.integers(0, 1_500, 10_001), return_inverse=True)[1]
    df = spark.createDataFrame(
        pd.DataFrame({"id": np.arange(len(x)), "x": x.tolist(), "c": labels}), "id long, x array<double>, c int")
    n = np.bincount(labels)[:, None]
    means = np.column_stack([np.bincount(labels, x[:, j]) for j in range(2)]) / n
    norms = np.bincount(labels, (x**2).sum(axis=1)) / n[:, 0]
    apart = (x**2).sum(axis=1)[:, None] - 2 * x @ means.T + norms
    at = np.arange(len(x))
    size = n[labels, 0]
    own = apart[at, labels] * size / np.maximum(size - 1, 1)
    apart[at, labels] = np.inf
    wanted = np.where(size > 1, (apart.min(axis=1) - own) / np.maximum(apart.min(axis=1), own), 0.0)
    rows = quality.silhouette_rows(df, "id", "x", ["c"]).toPandas().sort_values("id")
    assert np.allclose(rows["silhouette"], wanted, atol=1e-6)
    profile = quality.silhouette_profile(quality.silhouette_rows(df, "id", "x", ["c"]), "id", 2)
    assert profile.where("label = 3").count() == len(range(0, int(n[3, 0]), max(1, int(n[3, 0]) // 2)))


def test_search_finds_separate_groups(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])
    x = np.repeat(centres, 50, axis=0) + rng.normal(scale=0.3, size=(200, 2))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, features array<double>")
    grid, fits = clustering.kmeans_grid(df, "id")
    assert clustering.best_k(grid) == 4
    means = np.array([x[50 * g : 50 * g + 50].mean(axis=0) for g in range(4)])
    assert np.allclose(sorted(map(tuple, fits[4])), sorted(map(tuple, means)), atol=1e-3)
    cost = sum(((x[50 * g : 50 * g + 50] - means[g]) ** 2).sum() for g in range(4))
    assert grid.where("k = 4").first()["inertia"] == pytest.approx(cost, abs=0.01)
    few = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(12)], "id long, features array<double>")
    assert sorted(r["k"] for r in clustering.kmeans_grid(few, "id")[0].collect()) == [2]
    with pytest.raises(ValueError):
        clustering.kmeans_grid(few.where("id % 3 = 0"), "id")


def test_a_model_that_cannot_be_fitted_has_a_row(spark, matrix, monkeypatch):
    def refuse(*args, **kwargs):
        raise ValueError("no such model")

    monkeypatch.setattr(selection, "fit_mixture", refuse)
    board = {r["model_name"]: r for r in selection.leaderboard(matrix, ID, 2, starts=1).collect()}
    assert len(board) == 4 and board[catalog.MODEL_GMM]["error"] == "no such model"
    assert board[catalog.MODEL_GMM]["composite_score"] is None

    def fail(*args, **kwargs):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(selection, "fit_mixture", fail)
    with pytest.raises(RuntimeError):
        selection.leaderboard(matrix, ID, 2, starts=1)


def test_sums_beyond_a_long(spark):
    rows = spark.createDataFrame([(1e13,), (2.5e13,), (None,)], "v double")
    assert rows.agg(exact_sum(F.col("v"))).first()[0] == 3.5e13


def test_unknown_inputs_leave_churn_unknown(spark):
    full = (400, 2, 50.0, 3, 0.1)
    rows = [tuple(None if i == gap else v for i, v in enumerate(full)) for gap in (-1, 0, 1, 2, 3, 4)]
    df = spark.createDataFrame(
        rows, "Recency_Days int, Frequency_Orders int, Engagement_Score double, Support_Tickets int, Return_Rate double")
    found = df.select(churn.churn_rfm().alias("a"), churn.churn_predicted().alias("b")).collect()
    assert [r["a"] is None for r in found] == [False, True, True, True, True, False]
    assert [r["b"] is None for r in found] == [False, True, False, True, True, True]


def test_limits_out_of_range_are_refused(customers):
    for limit in (0, 101):
        with pytest.raises(ValueError):
            kpis.high_risk_customers(customers, "Support_Tickets", limit)


def test_adjusted_rand(spark):
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (1, 2), (2, 2), (2, 2)]
    df = spark.createDataFrame(pairs, "a int, b int")
    n = np.zeros((3, 3))
    for a, b in pairs:
        n[a, b] += 1
    two = lambda v: (v * (v - 1) / 2).sum()
    expected = two(n.sum(1)) * two(n.sum(0)) / (8 * 7 / 2)
    wanted = (two(n) - expected) / ((two(n.sum(1)) + two(n.sum(0))) / 2 - expected)
    assert quality.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(wanted)
    assert quality.adjusted_rand(df, "a", "a").first()[0] == 1.0


def test_ward_merges_by_least_variance():
    assert ward.merge_ward([1, 1, 1, 1], [[0.0], [0.1], [5.0], [5.1]], 2) == [0, 0, 1, 1]
    # 10 * 1 / 11 * 4 = 3.6 against 1 * 1 / 2 * 6.25 = 3.1: the light pair merges
    assert ward.merge_ward([10, 1, 1], [[0.0], [2.0], [4.5]], 2) == [0, 1, 1]
    labels = ward.merge_ward([1, 5, 1, 5], [[0.0], [0.2], [9.0], [9.3]], 2)
    assert labels[0] == labels[1] != labels[2] == labels[3]


def test_ward_is_exact_on_few_rows_and_close_beyond(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(80, 3)) + m for m in ([0, 0, 0], [6, 0, 0], [0, 6, 0])]).round(2)
    table = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, features array<double>").repartition(6)
    exact = ward.merge_ward([1] * len(x), x.tolist(), 3)
    groups = lambda labels: sorted(tuple(np.flatnonzero(np.array(labels) == c)) for c in set(labels))
    found = [r["HAC_Cluster"] for r in ward.ward_labels(table, "id", 3, leaves=400).orderBy("id").collect()]
    assert groups(found) == groups(exact)
    summary = ward.summarised(table.select(F.col("features").alias("x")), leaves=40, fan_in=2)
    assert summary.n.sum() == len(x) and len(summary.n) <= 40 and summary.threshold > 0
    assert np.allclose(summary.sums.sum(axis=0), x.sum(axis=0)) and summary.squares.sum() == pytest.approx((x * x).sum())
    close = [r["HAC_Cluster"] for r in ward.ward_labels(table, "id", 3, leaves=40).orderBy("id").collect()]
    pairs = spark.createDataFrame(list(zip(exact, close)), "a int, b int")
    assert quality.adjusted_rand(pairs, "a", "b").first()[0] > 0.9
    assert ward.ward_labels(table.where("false"), "id", 3).count() == 0


def test_ward_on_micro_clusters(matrix):
    rows = ward.ward_labels(matrix, ID, 3, leaves=60).collect()
    assert len(rows) == 400 and {r["HAC_Cluster"] for r in rows} == {0, 1, 2}


def test_stability_and_leaderboard(matrix):
    runs = stability.stability_runs(matrix, ID, 2, runs=2, starts=1)
    row = stability.stability_summary(runs).first()
    assert row["runs"] == 2
    assert -1 <= row["min_adjusted_rand_index"] <= row["mean_adjusted_rand_index"] <= row["max_adjusted_rand_index"] <= 1
    board = selection.leaderboard(matrix, ID, 3, starts=1).collect()
    assert len(board) == 4 and [r["is_recommended"] for r in board] == [True, False, False, False]
    assert [r["composite_score"] for r in board] == sorted((r["composite_score"] for r in board), reverse=True)


def test_scoring_falls_back(spark, table, model, matrix):
    fit = clustering.fit_kmeans(matrix, 3, starts=1)
    people = spark.createDataFrame(
        [(c, f"KEY{c}", *["t"] * 6, 1, *[1.0] * 10) for c in (1, 2)],
        "cluster_id int, " + ", ".join(f"{c} string" for c in scoring.PERSONA_COLUMNS)
        + ", customer_count long, " + ", ".join(f"{c} double" for c in scoring.METRIC_COLUMNS[1:]),
    )
    by_model = scoring.score_records(table, scoring.ScoringModels(model, people, kmeans=fit))
    by_centre = scoring.score_records(
        table, scoring.ScoringModels(model, people, centres=fit.centre_table(spark)))
    assert by_model.count() == 400
    assert by_model.select(ID, "predicted_cluster").exceptAll(by_centre.select(ID, "predicted_cluster")).count() == 0
    row = by_model.where("predicted_cluster = 0").first()
    assert row["persona_key"] == "KEY1" and row["confidence_score"] == 0.95
    assert row["predicted_ltv_12m"] == pytest.approx(row["Monetary_Spend"] * 1.4, abs=0.01)
    plain = scoring.score_records(table, scoring.ScoringModels(model, people))
    assert plain.where("predicted_cluster != 0").count() == 0


@pytest.mark.parametrize("bound", [0.0, 1e-3])
def test_silhouettes_in_many_dimensions_write_no_requests(spark, bound, monkeypatch):
    """Rows that would ask for most cells meet all rows in tiles: several groups, copies, noise, a cluster of one."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 12)) + 100.0
    x[:40] = x[0]
    first, second = rng.integers(0, 3, 1500), rng.integers(-1, 6, 1500)
    second[9] = 8
    df = spark.createDataFrame(
        pd.DataFrame({"id": np.arange(1500), "x": x.tolist(), "a": first, "b": second}), "id long, x array<double>, a int, b int")
    written = []
    plain = silhouette.stage
    monkeypatch.setattr(silhouette, "stage", lambda df, name: written.append(name) or plain(df, name))
    monkeypatch.setattr(silhouette, "BLOCK_ROWS", 400)
    found = silhouette.euclidean_rows(df, "id", "x", ["a", "b"], bound, cell_rows=16).toPandas()
    assert "asked" not in written
    for run, labels in (("a", first), ("b", second)):
        keep = np.flatnonzero(labels != -1)
        own = found[found.run == run].set_index("id").loc[keep]
        assert len(own) == len(keep) == len(found[found.run == run]) and (own.label.to_numpy() == labels[keep]).all()
        assert np.abs(own.silhouette.to_numpy() - brute_silhouette(x[keep], labels[keep])).max() <= max(bound, 1e-9)


def test_shared_passes_name_the_nearest_centre_of_each_fit():
    rng = np.random.default_rng(4)
    rows, models = rng.normal(size=(300, 5)), [rng.normal(size=(k, 5)) for k in (1, 2, 7)]
    for centres, (label, apart) in zip(models, clustering._nearest_of_each(rows, models)):
        squares = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (label == squares.argmin(axis=1)).all() and np.allclose(apart, squares.min(axis=1))


def test_rows_are_dealt_to_more_tasks_than_one(spark):
    rows = spark.range(12_000).withColumnRenamed("id", ID)
    assert clustering.sized(rows, ID).rdd.getNumPartitions() == 3
    assert clustering.sized(rows, ID, supervised.BOOSTED_ROWS).rdd.getNumPartitions() == 1
    assert clustering.sized(rows.union(rows), ID, supervised.BOOSTED_ROWS).rdd.getNumPartitions() == 2
