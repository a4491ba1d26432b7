"""The recorded nine-row run: values every step must reproduce."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.operators import (
    clustering,
    conform,
    dbscan,
    drivers,
    features,
    personas,
    projection,
    quality,
    ranking,
    rfm,
    severity,
    ward,
)
from clientlens.session import stage
from tests.test_models import brute_silhouette, dense

ID = "Customer_ID"


@pytest.fixture(scope="module")
def scored(nine):
    return stage(rfm.rfm_scores(conform.conform(nine).table, "training"))


@pytest.fixture(scope="module")
def matrix(scored):
    model = features.fit_features(scored)
    assert model.names[-2:] == ["Preferred_Channel_Web", "Gender_Unknown"]
    return clustering.fixed_matrix(model.transform(scored), ID)


@pytest.fixture(scope="module")
def labelled(scored):
    """The recorded clusters: rows 1-3 are cluster 1, the others cluster 0."""
    return scored.withColumn("KMeans_Cluster", F.when(F.col("Recency_Days") <= 3, 1).otherwise(0))


def column(df, name):
    return [r[name] for r in df.orderBy(ID).collect()]


def test_scores_and_churn(scored):
    assert column(scored, ID) == [f"UPL-{10000 + i}" for i in range(1, 10)]
    assert column(scored, "R_Score") == [5, 5, 4, 4, 3, 2, 2, 1, 1]
    assert column(scored, "F_Score") == column(scored, "M_Score") == [1, 1, 2, 2, 3, 4, 4, 5, 5]
    assert column(scored, "RFM_Group")[0] == "511"
    assert np.allclose(column(scored, "Churn_Risk_Index"), [.408, .397, .385, .373, .362, .350, .338, .327, .315], atol=1.1e-3)


def test_k_grid(matrix):
    grid, _ = clustering.kmeans_grid(matrix, ID)
    rows = {r["k"]: r for r in grid.collect()}
    assert sorted(rows) == [2, 3, 4, 5, 6, 7, 8]
    assert clustering.best_k(grid) == 2
    assert rows[2]["inertia"] == pytest.approx(9.76, abs=0.02)
    halves = np.array(column(matrix.withColumn("c", F.col(ID) > "UPL-10003"), "c"))
    assert rows[2]["silhouette_score"] == pytest.approx(brute_silhouette(dense(matrix), halves).mean(), abs=1e-3)
    assert rows[2]["davies_bouldin"] == pytest.approx(0.5058, abs=2e-3)
    assert rows[2]["calinski_harabasz"] == pytest.approx(18.82, abs=0.1)
    assert rows[3]["inertia"] == pytest.approx(3.95, abs=0.05)


def test_labels_and_noise(matrix, labelled):
    fit = clustering.fit_kmeans(matrix, 2, starts=6)
    assert column(fit.transform(matrix), "KMeans_Cluster") == column(labelled, "KMeans_Cluster")
    assert column(ward.ward_labels(matrix, ID, 2), "HAC_Cluster") == column(labelled, "KMeans_Cluster")
    noise = dbscan.dbscan(matrix, ID, "features", [dbscan.Setting(2.0, 10)])
    assert set(column(noise, "label")) == {-1}
    centre = [r["centre"] for r in fit.centre_table(matrix.sparkSession).collect() if r["label"] == 0][0]
    wanted = [.6120, .6120, .6085, 0, 0, 0, 0, 0, -.5818, 1, 1]
    assert np.allclose(centre, wanted, atol=2e-3)


def test_projection(matrix):
    pca = projection.fit_projection(matrix)
    assert np.allclose(pca.ratios, [.9872, .0127, .0001], atol=2e-4)
    placed = pca.transform(matrix)
    values = np.array(column(placed, "PCA_1"))
    assert abs(values.mean()) < 1e-9
    assert abs(values[0]) == pytest.approx(3.768, abs=5e-3)


def test_personas_and_campaigns(labelled):
    people = personas.personas(labelled, "KMeans_Cluster")
    rows = {r["cluster_id"]: r for r in people.collect()}
    assert (rows[0]["persona_key"], rows[1]["persona_key"]) == ("AT_RISK", "NEW_BUYER")
    for cluster, wanted in {0: (6, 66.67, 3900.0, 86.67, 6.5, 6.5, 650.0, .344),
                            1: (3, 33.33, 600.0, 13.33, 2.0, 2.0, 200.0, .397)}.items():
        r = rows[cluster]
        got = (r["customer_count"], r["customer_percentage"], r["total_revenue"], r["revenue_percentage"],
               r["avg_recency_days"], r["avg_frequency_orders"], r["avg_monetary_spend"], r["avg_churn_risk"])
        assert got == pytest.approx(wanted, abs=1.1e-3)
    campaigns = personas.campaign_priority(people).collect()
    assert [c["cluster_id"] for c in campaigns] == [0, 1]
    assert campaigns[0]["priority_score"] == pytest.approx(64.38, abs=0.05)
    assert campaigns[0]["expected_revenue_at_risk"] == pytest.approx(1342.25, abs=3)
    assert campaigns[1]["priority_score"] == pytest.approx(26.56, abs=0.05)


def test_quantiles(labelled):
    q = ranking.exact_quantiles(labelled, personas.RULE_QUANTILES)
    assert q["Monetary_Spend"] == pytest.approx({0.7: 660.0, 0.5: 500.0})
    assert q["Recency_Days"] == pytest.approx({0.4: 4.2, 0.6: 5.8})


def test_drivers(labelled):
    rows = {r["cluster_id"]: r["top_drivers"] for r in drivers.segment_drivers(labelled).collect()}
    assert {d["feature"] for d in rows[0]} == {
        "Churn_Risk_Index", "Recency_Days", "Frequency_Orders", "Monetary_Spend"
    }
    assert [d["strength"] for d in rows[0]] == pytest.approx([.548] * 4, abs=1.5e-3)
    assert rows[1][0]["feature"] == "Churn_Risk_Index"
    assert rows[1][0]["strength"] == pytest.approx(1.097, abs=2e-3)
    assert rows[1][0]["direction"] == "above average"


def test_severity(scored):
    top = severity.top_anomalies(scored.withColumn("DBSCAN_Cluster", F.lit(-1))).collect()
    assert [r["customer_id"] for r in top] == [f"UPL-{10000 + i}" for i in range(9, 0, -1)]
    assert [r["severity"] for r in top] == pytest.approx(
        [.622, .606, .589, .572, .556, .539, .522, .506, .489], abs=1e-3)


def test_quality_of_recorded_labels(matrix, labelled):
    df = matrix.join(labelled.select(ID, "KMeans_Cluster"), ID)
    r = quality.evaluate(df, ID, "features", ["KMeans_Cluster"]).first()
    labels = np.array(column(labelled, "KMeans_Cluster"))
    assert r["silhouette"] == pytest.approx(brute_silhouette(dense(matrix), labels).mean(), abs=1e-6)
    assert r["davies_bouldin"] == pytest.approx(.5058, abs=1e-3)
    assert r["calinski_harabasz"] == pytest.approx(18.82, abs=.05)
