"""Quality of clusterings: Davies-Bouldin, Calinski-Harabasz, silhouettes by Euclidean distance
and by its square, nearest centroid, adjusted Rand index. Several labelings are judged in one go."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.functions.expressions import squared_distance
from clientlens.operators import silhouette
from clientlens.operators.ranking import with_row_number
from clientlens.session import stage

CENTRES_PER_PASS = 1_000  # centres one row is compared with at a time
BOUND = 1e-3  # how far a row's silhouette may be off where labelings are only compared
INVALID = {"silhouette": -1.0, "davies_bouldin": 999.0, "calinski_harabasz": 0.0}


def as_array(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return vector_to_array(F.col(column)) if kind == "vector" else F.col(column).cast("array<double>")


def _long(df: DataFrame, vec_col: str, label_cols: list[str]) -> DataFrame:
    """(run, label, x) for every labeling, noise left out."""
    runs = F.array(*[F.struct(F.lit(c).alias("run"), F.col(c).cast("int").alias("label")) for c in label_cols])
    return (
        df.select(as_array(df, vec_col).alias("x"), F.explode(runs).alias("r"))
        .select("r.run", "r.label", "x")
        .where(F.col("label") != -1)
    )


def centroids(df: DataFrame, vec_col: str, label_cols: list[str]) -> DataFrame:
    """(run, label, n, centre): partial sums per task, one row per cluster shuffled."""
    return (
        _long(df, vec_col, label_cols)
        .groupBy("run", "label")
        .agg(F.count("*").alias("n"), Summarizer.mean(array_to_vector("x")).alias("c"))
        .select("run", "label", "n", vector_to_array("c").alias("centre"))
    )


def cluster_geometry(df: DataFrame, vec_col: str, label_cols: list[str]) -> DataFrame:
    """Per cluster: size, centre, mean distance and sum of squared distances to it."""
    centres = stage(centroids(df, vec_col, label_cols), "centres")
    near = _long(df, vec_col, label_cols).join(centres, ["run", "label"]).withColumn(
        "d2", squared_distance(F.col("x"), F.col("centre"))
    )
    spread = near.groupBy("run", "label").agg(
        F.avg(F.sqrt("d2")).alias("scatter"), F.sum("d2").alias("within")
    )
    return centres.join(spread, ["run", "label"])


def geometry_scores(geometry: DataFrame) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz of each run, from cluster rows alone.

    A run's clusters sit in one array on each of its rows, so no pair of rows is formed.
    """
    geometry = stage(geometry, "geometry")
    d = lambda a, b: F.sqrt(squared_distance(a, b))
    per_run = geometry.groupBy("run").agg(
        F.collect_list(F.struct("label", "n", "centre", "scatter")).alias("all"),
        F.sum("n").alias("total"),
        F.count("*").alias("k"),
        F.sum("within").alias("within_all"),
    )
    rows = geometry.join(per_run, "run")
    ratio = F.transform(
        F.filter("all", lambda o: o["label"] != F.col("label")),
        lambda o: F.coalesce(
            F.try_divide(F.col("scatter") + o["scatter"], d(F.col("centre"), o["centre"])), F.lit(0.0)
        ),
    )
    zero = F.transform("centre", lambda _: F.lit(0.0))
    middle = F.aggregate(
        "all", zero,
        lambda acc, o: F.zip_with(acc, o["centre"], lambda a, c: a + c * o["n"] / F.col("total")),
    )
    scored = rows.select(
        "run", "k", "total", "within_all",
        F.coalesce(F.array_max(ratio), F.lit(0.0)).alias("worst"),
        (F.col("n") * squared_distance(F.col("centre"), middle)).alias("between"),
    )
    return scored.groupBy("run").agg(
        F.first("k").cast("int").alias("n_clusters"),
        F.first("total").alias("n_valid"),
        F.avg("worst").alias("davies_bouldin"),
        F.try_divide(
            F.sum("between") / F.nullif(F.first("k") - 1, F.lit(0)),
            F.first("within_all") / F.nullif(F.first("total") - F.first("k"), F.lit(0)),
        ).alias("calinski_harabasz"),
    )


def silhouette_rows(df: DataFrame, id_col: str, vec_col: str, label_cols: list[str]) -> DataFrame:
    """(run, id, label, silhouette) of every row, by squared Euclidean distance.

    The mean squared distance of a row to a cluster follows from the cluster's size, mean
    and mean squared norm, so no pair of rows is formed. Noise is left out; a cluster of
    one row, and a labeling of one cluster, score 0.
    """
    points = df.select(F.col(id_col), as_array(df, vec_col).alias("x"), *label_cols)
    norm = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y * y)
    clusters = stage(
        _long(df, vec_col, label_cols).groupBy("run", "label").agg(
            F.count("*").alias("n"), Summarizer.mean(array_to_vector("x")).alias("c"), F.avg(norm(F.col("x"))).alias("norm"),
        ).select("run", "label", "n", vector_to_array("c").alias("centre"), "norm"),
        "clusters",
    )
    counts = {r["run"]: r["k"] for r in clusters.groupBy("run").agg(F.count("*").alias("k")).collect()}
    out = None
    for run in label_cols:
        own = clusters.where(F.col("run") == run).drop("run")
        rows = points.select(id_col, "x", F.col(run).cast("int").alias("label")).where("label <> -1")
        rows = rows.withColumn("x2", norm(F.col("x"))).join(own, "label").withColumn("other", F.lit(None).cast("double"))
        apart = lambda c: F.greatest(
            F.col("x2") + c["norm"] - 2.0 * F.aggregate(
                F.zip_with(F.col("x"), c["centre"], lambda a, b: a * b), F.lit(0.0), lambda acc, y: acc + y), F.lit(0.0))
        for block in _passes(own, counts.get(run, 0), CENTRES_PER_PASS):
            chosen = block.agg(F.collect_list(F.struct("label", "centre", "norm")))
            here = F.array_min(F.transform(F.filter("_c", lambda c: c["label"] != F.col("label")), apart))
            rows = rows.withColumn("_c", chosen.scalar()).withColumn("other", F.least("other", here)).drop("_c")
        inner = apart({"norm": F.col("norm"), "centre": F.col("centre")}) * F.col("n") / (F.col("n") - 1)
        top = F.greatest("inner", "other")
        score = F.when((F.col("n") > 1) & F.col("other").isNotNull() & (top > 0), (F.col("other") - F.col("inner")) / top)
        rows = rows.withColumn("inner", F.when(F.col("n") > 1, inner)).select(
            F.lit(run).alias("run"), id_col, "label", F.coalesce(score, F.lit(0.0)).alias("silhouette")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _passes(clusters: DataFrame, count: int, per_pass: int) -> list[DataFrame]:
    """Clusters of one labeling in blocks of at most ``per_pass`` rows."""
    if count <= per_pass:
        return [clusters]
    numbered = stage(with_row_number(clusters, "label", "_n"), "clusters")
    return [
        numbered.where((F.col("_n") > lo) & (F.col("_n") <= lo + per_pass)).drop("_n") for lo in range(0, count, per_pass)
    ]


def silhouette_profile(rows: DataFrame, id_col: str, points: int = 100) -> DataFrame:
    """TOP-11: each cluster's silhouettes in ascending order, every (n // points)-th.

    Rows are numbered over fixed ranges of (run, label, silhouette, id), so a large cluster
    is sorted by many tasks; a cluster's places follow from the number of its first row.
    """
    key = F.format_string(
        "%s|%012d|%.17f|%s", F.col("run"), F.col("label"), F.col("silhouette") + 1.0, F.col(id_col).cast("string")
    )
    held = stage(rows.withColumn("_k", key), "profile")
    numbered = stage(with_row_number(held, "_k", "_n").drop("_k"), "profile")
    cluster = numbered.groupBy("run", "label").agg(F.min("_n").alias("_first"), F.count("*").alias("_size"))
    place = F.col("_n") - F.col("_first")
    step = F.greatest(F.lit(1), F.floor(F.col("_size") / points))
    return (
        numbered.join(cluster, ["run", "label"]).withColumn("_p", place).withColumn("_s", step)
        .where(F.col("_p") % F.col("_s") == 0)
        .select("run", "label", (F.col("_p") / F.col("_s")).cast("int").alias("place"), "silhouette")
    )


def evaluate(
    df: DataFrame, id_col: str, vec_col: str, label_cols: list[str], invalid: dict[str, float] = INVALID, bound: float = BOUND,
) -> DataFrame:
    """ML-13/14/16: one row per labeling, unrounded; a labeling with fewer than two
    clusters, or no more valid rows than clusters, takes the ``invalid`` values. Silhouettes
    are Euclidean, each within ``bound`` of the exact value; a bound of zero is exact."""
    geometry = geometry_scores(cluster_geometry(df, vec_col, label_cols))
    silhouettes = (
        silhouette.euclidean_rows(df, id_col, vec_col, label_cols, bound)
        .groupBy("run").agg(F.avg("silhouette").alias("silhouette"))
    )
    noise = df.agg(*[F.count_if(F.col(c) == -1).alias(c) for c in label_cols]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("run"), F.col(c).alias("n_noise")) for c in label_cols]))
    )
    joined = noise.join(geometry, "run", "left").join(silhouettes, "run", "left")
    valid = (F.col("n_clusters") > 1) & (F.col("n_valid") > F.col("n_clusters"))
    pick = lambda name: F.when(valid, F.col(name)).otherwise(F.lit(invalid[name])).alias(name)
    return joined.select(
        "run", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), "n_noise",
        pick("silhouette"), pick("davies_bouldin"), pick("calinski_harabasz"),
    )


def nearest_centre(
    df: DataFrame, vec_col: str, centres: DataFrame, out: str = "nearest",
    max_distance: float | None = None, per_pass: int = CENTRES_PER_PASS,
) -> DataFrame:
    """JN-4: label of the nearest centre (``label``, ``centre``), lowest label on ties.

    Centres are a model: they travel as one constant array of at most ``per_pass`` rows.
    A larger set is compared in several such passes, each keeping the best so far, so
    rows are never multiplied. Beyond ``max_distance`` the label is -1.
    """
    x = as_array(df, vec_col)
    centres = stage(centres.select("label", "centre"), "centres")
    count = centres.count()
    if count == 0:
        return df.withColumn(out, F.lit(-1)).withColumn(f"{out}_distance", F.lit(None).cast("double"))
    passes = [centres]
    if count > per_pass:
        numbered = stage(with_row_number(centres, "label", "_n"), "centres")
        passes = [
            numbered.where((F.col("_n") > lo) & (F.col("_n") <= lo + per_pass))
            for lo in range(0, count, per_pass)
        ]
    out_df = df.withColumn("_x", x).withColumn(
        "_best", F.lit(None).cast("struct<d:double,label:int>")
    )
    for block in passes:
        chosen = block.agg(F.collect_list(F.struct(F.col("label").cast("int").alias("label"), "centre")))
        out_df = out_df.withColumn("_c", chosen.scalar()).withColumn(
            "_here",
            F.array_min(
                F.transform(
                    "_c",
                    lambda c: F.struct(
                        F.sqrt(squared_distance(F.col("_x"), c["centre"])).alias("d"),
                        c["label"].alias("label"),
                    ),
                )
            ),
        ).withColumn("_best", F.least("_best", "_here")).drop("_c", "_here")
    label = F.col("_best.label")
    if max_distance is not None:
        label = F.when(F.col("_best.d") > max_distance, F.lit(-1)).otherwise(label)
    return (
        out_df.withColumn(out, label).withColumn(f"{out}_distance", F.col("_best.d")).drop("_x", "_best")
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """JN-7 / ML-19: adjusted Rand index (Hubert & Arabie 1985) from the contingency table."""
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2.0
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    cells = stage(cells, "contingency")
    rows = cells.groupBy("a").agg(F.sum("n").alias("n"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n"))
    both = cells.agg(F.sum(pairs("n")).alias("both"), F.sum("n").alias("total"))
    return (
        both.withColumn("ra", rows.agg(F.sum(pairs("n"))).scalar())
        .withColumn("rb", cols.agg(F.sum(pairs("n"))).scalar())
        .withColumn("expected", F.try_divide(F.col("ra") * F.col("rb"), pairs("total")))
        .withColumn("best", (F.col("ra") + F.col("rb")) / 2.0)
        .select(
            F.coalesce(
                F.try_divide(F.col("both") - F.col("expected"), F.col("best") - F.col("expected")),
                F.lit(1.0),
            ).alias("adjusted_rand_index")
        )
    )
