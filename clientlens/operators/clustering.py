"""K-Means and Gaussian mixtures on the clustering matrix, with their searches.

Fits that belong together share their passes over the rows: the starts and sizes of a search,
the halves of a stability run, the mixtures of all numbers of components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.functions.expressions import rounded, squared_distance
from clientlens.operators.quality import as_array, evaluate
from clientlens.session import small_table, stage

GRID_K = range(2, 10)
GRID_COMPONENTS = range(2, 11)
# Seeded starts of a fit in the search and of the final fit
GRID_STARTS = 5
FINAL_STARTS = 10
ROWS_PER_FILE = 5_000
PASSES = 50
SETTLED = 1e-4
SEED_ROUNDS = 4  # of oversampling before the first centres are chosen
WEIGHTED_ROUNDS = 10
# Mixtures: rounds at most, rise of the mean log density that ends a fit, added to the variances
MIXTURE_ROUNDS = 100
MIXTURE_SETTLED = 1e-3
REGULAR = 1e-6


def fixed_matrix(df: DataFrame, id_col: str, vec_col: str = "features") -> DataFrame:
    """(id, features) written once, each file sorted by id, so that seeded fits see the
    same rows in the same order on every run. The number of files follows the rows."""
    return stage(sized(stage(df.select(id_col, F.col(vec_col).alias("features")), "rows"), id_col), "matrix")


def sized(df: DataFrame, id_col: str, rows: int = ROWS_PER_FILE) -> DataFrame:
    """``df`` in as many partitions as its rows ask for, in the order of the id."""
    parts = max(1, math.ceil(df.count() / rows))
    return df.repartition(parts, id_col).sortWithinPartitions(id_col)


@contextmanager
def held(df: DataFrame):
    """Keep ``df`` near the executors while several fits scan it."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


@dataclass
class KMeansFit:
    """Centres whose clusters are numbered by size, then by first centre coordinate.

    ``order`` gives the public number of each row of ``centres``.
    """

    centres: np.ndarray
    order: list[int]
    cost: float

    @property
    def k(self) -> int:
        return len(self.order)

    def transform(self, df: DataFrame, out: str = "KMeans_Cluster", vec_col: str = "features") -> DataFrame:
        """``df`` with the number of the nearest centre, the lowest on ties."""
        told = F.array(*[
            F.struct(F.lit(int(n)).alias("label"), F.array(*[F.lit(float(v)) for v in c]).alias("centre"))
            for n, c in sorted(zip(self.order, self.centres), key=lambda x: x[0])
        ])
        near = F.array_min(F.transform(told, lambda c: F.struct(
            squared_distance(as_array(df, vec_col), c["centre"]).alias("d"), c["label"].alias("label"))))
        return df.withColumn(out, near["label"].cast("int"))

    def centre_table(self, spark) -> DataFrame:
        """(label, raw_label, centre): the model as a table."""
        return small_table(
            spark,
            {"label": self.order, "raw_label": list(range(self.k)),
             "centre": [[float(v) for v in c] for c in self.centres]},
        )

    def save(self, spark, path: str) -> None:
        self.centre_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> KMeansFit:
        rows = spark.read.parquet(path).orderBy("raw_label").collect()  # one row a cluster
        return cls(np.array([r["centre"] for r in rows]), [r["label"] for r in rows], math.nan)


def fit_kmeans(matrix: DataFrame, k: int, starts: int = FINAL_STARTS, seed: int = 42, id_col: str | None = None) -> KMeansFit:
    """ML-5: the cheapest of ``starts`` seeded fits, all of them in the same passes.

    ``id_col`` names what seeds the draws; without it rows go by their content.
    """
    points = stage(sized_points(matrix, id_col or matrix.columns[0]), "points")
    found = fit_many(points, [Start(k, seed + start) for start in range(starts)])
    return numbered_fit(min(found, key=lambda f: f.cost))


def numbered_fit(found: Found) -> KMeansFit:
    used = np.flatnonzero(found.sizes)
    centres, sizes = found.centres[used], found.sizes[used]
    ranked = sorted(range(len(centres)), key=lambda c: (-sizes[c], tuple(centres[c])))
    order = [0] * len(centres)
    for number, raw in enumerate(ranked):
        order[raw] = number
    return KMeansFit(centres, order, found.cost)


@dataclass(frozen=True)
class Start:
    """A K-Means fit to make: clusters, seed, and the rows it learns from - those whose draw of
    ``part[0]``, from 0 to 99, lies in [part[1], part[2])."""

    k: int
    seed: int
    part: tuple[int, int, int] = (0, 0, 100)


@dataclass(frozen=True)
class Found:
    centres: np.ndarray
    sizes: np.ndarray
    cost: float


def sized_points(df: DataFrame, id_col: str, vec_col: str = "features") -> DataFrame:
    """(x, key): vectors and a number of each row that draws are hashed from."""
    return df.select(as_array(df, vec_col).alias("x"), F.xxhash64(id_col).alias("key"))


_ODD1, _ODD2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _draws(keys: np.ndarray, *salt: int) -> np.ndarray:
    """A number in [0, 1) for each row, independent for each salt, the same on every run."""
    values = keys.view(np.uint64).copy()
    for number in salt:
        values ^= np.uint64((number + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        values = (values ^ (values >> np.uint64(30))) * _ODD1
        values = (values ^ (values >> np.uint64(27))) * _ODD2
        values ^= values >> np.uint64(31)
    return (values >> np.uint64(11)).astype(float) / (1 << 53)


def _taking_part(keys: np.ndarray, fit: Start) -> np.ndarray:
    seed, low, high = fit.part
    if (low, high) == (0, 100):
        return np.ones(len(keys), dtype=bool)
    draw = np.floor(_draws(keys, 7, seed) * 100)
    return (draw >= low) & (draw < high)


def _first_centres(rows: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Weighted k-means++ on the candidates of a fit, settled by a few weighted rounds."""
    rng = np.random.default_rng(seed)
    chosen = [rows[rng.choice(len(rows), p=weights / weights.sum())]]
    nearest = ((rows - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = (nearest * weights).sum()
        pick = rng.choice(len(rows), p=nearest * weights / total) if total > 0 else rng.integers(len(rows))
        chosen.append(rows[pick])
        nearest = np.minimum(nearest, ((rows - chosen[-1]) ** 2).sum(axis=1))
    centres = np.array(chosen)
    for _ in range(WEIGHTED_ROUNDS):
        label, _ = _nearest(rows, centres)
        mass = np.bincount(label, weights, len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, label, rows * weights[:, None])
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance to it) of every row."""
    apart = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)
    label = apart.argmin(axis=1)
    return label, np.maximum(apart[np.arange(len(rows)), label], 0)


def _nearest_of_each(rows: np.ndarray, models: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_nearest`` for several sets of centres, from one product of matrices."""
    every = np.concatenate(models)
    apart = -2 * every @ rows.T + (rows * rows).sum(axis=1) + (every * every).sum(axis=1)[:, None]
    begin = 0
    for centres in models:
        own = apart[begin : begin + len(centres)]
        begin += len(centres)
        least, label = own[0].copy(), np.zeros(len(rows), dtype=np.int64)
        for number in range(1, len(own)):
            label[own[number] < least] = number
            np.minimum(least, own[number], out=least)
        yield label, np.maximum(least, 0)


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _passed(points: DataFrame, wanted: list[Start], models: dict[int, np.ndarray], figures) -> dict[int, np.ndarray]:
    """One pass over the rows for all open fits: [cluster, figure] sums of each.

    ``figures`` gives the figures of the rows that take part from (rows, squared distance to the
    nearest centre). Tasks add them up by cluster; only those sums are shuffled and collected.
    """
    held = points.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        whole = [i for i in held.value if wanted[i].part[1:] == (0, 100)]
        parts = {}
        for i in held.value:
            if i not in whole:
                parts.setdefault(wanted[i].part, []).append(i)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, keys = _rows_of(batch.column("x")), batch.column("key").to_numpy()
            groups = [(rows, whole)] if whole else []
            for members in parts.values():
                groups.append((rows[_taking_part(keys, wanted[members[0]])], members))
            for own, members in groups:
                for i, (label, apart) in zip(members, _nearest_of_each(own, [held.value[i] for i in members])):
                    member = (label == np.arange(len(held.value[i]))[:, None]).astype(float)
                    found = member @ np.stack(figures(own, apart), axis=1)
                    sums[i] = sums[i] + found if i in sums else found
        if sums:
            fit = np.concatenate([np.full(v.size, i) for i, v in sums.items()])
            place = np.concatenate([np.arange(v.size) for v in sums.values()])
            value = np.concatenate([v.reshape(-1) for v in sums.values()])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (fit, place, value)], names=["fit", "place", "v"])

    table = points.mapInArrow(run, "fit long, place long, v double").groupBy("fit", "place").agg(
        F.sum("v").alias("v")).toArrow()  # clusters x figures of each fit
    fit, place, value = (table.column(c).to_numpy() for c in ("fit", "place", "v"))
    out = {}
    for i, centres in models.items():
        own = fit == i
        flat = np.zeros(int(place[own].max()) + 1) if own.any() else np.zeros(len(centres))
        flat[place[own]] = value[own]
        out[i] = flat.reshape(len(centres), -1)
    return out


def _oversampled(points: DataFrame, wanted: list[Start]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(candidates, rows nearest to each) of every fit, by k-means|| in shared passes.

    A round takes each row with probability 2 k d^2 / cost, d being its distance to the nearest
    candidate so far, so copies of a point are no likelier to fill the candidates than one
    heavy point is. Candidates are a few times k, whatever the number of rows.
    """
    first = points.orderBy("key", "x").limit(1).toArrow()
    start = _rows_of(first.column("x").combine_chunks())
    models = {i: start for i in range(len(wanted))}
    cost_of = lambda rows, apart: [apart]
    for number in range(SEED_ROUNDS):
        costs = {i: float(v.sum()) for i, v in _passed(points, wanted, models, cost_of).items()}
        held = points.sparkSession.sparkContext.broadcast((models, costs))

        def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows, keys = _rows_of(batch.column("x")), batch.column("key").to_numpy()
                for i, candidates in held.value[0].items():
                    fit, cost = wanted[i], held.value[1][i]
                    if cost <= 0:
                        continue
                    _, apart = _nearest(rows, candidates)
                    chance = _draws(keys, 3, fit.seed, number)
                    taken = np.flatnonzero(_taking_part(keys, fit) & (chance < 2 * fit.k * apart / cost))
                    if len(taken):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(taken), i)), batch.column("x").take(pa.array(taken))], names=["fit", "x"])

        found = points.mapInArrow(drawn, "fit long, x array<double>").orderBy("fit", "x").toArrow()  # about 2 k rows a fit
        if not found.num_rows:
            break
        fit, rows = found.column("fit").to_numpy(), _rows_of(found.column("x").combine_chunks())
        models = {i: np.unique(np.concatenate([m, rows[fit == i]]), axis=0) for i, m in models.items()}
    weights = _passed(points, wanted, models, lambda rows, apart: [np.ones(len(rows))])
    return [(models[i], np.maximum(weights[i][:, 0], 1e-9)) for i in range(len(wanted))]


def fit_many(points: DataFrame, wanted: list[Start], passes: int = PASSES) -> list[Found]:
    """Every fit of ``wanted`` on the rows of ``points`` (x, key), all of them in the same passes.

    Centres start by k-means|| over all rows; one pass over the rows then moves the centres of
    every fit that has not settled.
    """
    fits = [_first_centres(rows, weights, fit.k, fit.seed) for fit, (rows, weights) in zip(wanted, _oversampled(points, wanted))]
    out: list[Found | None] = [None] * len(wanted)
    open_fits = list(range(len(wanted)))
    for number in range(passes + 1):
        if not open_fits:
            break
        sums = _passed(points, wanted, {i: fits[i] for i in open_fits}, lambda rows, apart: [*rows.T, np.ones(len(rows)), apart])
        still = []
        for i in open_fits:
            sizes = sums[i][:, -2]
            after = np.where(sizes[:, None] > 0, sums[i][:, :-2] / np.maximum(sizes, 1)[:, None], fits[i])
            out[i] = Found(fits[i], sizes, float(sums[i][:, -1].sum()))  # of the centres the pass began with
            if np.abs(after - fits[i]).max() > SETTLED and number < passes:
                fits[i] = after
                still.append(i)
        open_fits = still
    return out


def kmeans_grid(
    matrix: DataFrame, id_col: str, ks=GRID_K, starts: int = GRID_STARTS, seed: int = 42
) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """ML-6: inertia and quality of every k, and the centres of its cheapest start.

    All starts of all k share their passes, and all labelings are judged in one evaluation.
    Beyond 2, k stays below the number of different rows; a table of equal rows has nothing
    to cluster and is refused.
    """
    spark = matrix.sparkSession
    with held(matrix) as rows:
        different = rows.select(as_array(rows, "features").alias("x")).distinct().limit(max(ks) + 1).count()
        if different < 2:
            raise ValueError("clustering needs two different rows")
        points = stage(rows.select(id_col, as_array(rows, "features").alias("x"), F.xxhash64(id_col).alias("key")), "points")
        wanted = [Start(k, seed + start) for k in ks if k < max(different, 3) for start in range(starts)]
        fits: dict[int, Found] = {}
        for start, found in zip(wanted, fit_many(points.select("x", "key"), wanted)):
            if start.k not in fits or found.cost < fits[start.k].cost:
                fits[start.k] = found
        labelled = stage(nearest_labels(points.drop("key"), {f"k{k}": f.centres for k, f in fits.items()}), "labelled")
        scored = stage(evaluate(labelled, id_col, "x", [f"k{k}" for k in fits], invalid={
            "silhouette": 0.0, "davies_bouldin": 0.0, "calinski_harabasz": 0.0}), "kgrid")
    costs = small_table(
        spark, {"run": [f"k{k}" for k in fits], "k": list(fits), "inertia": [f.cost for f in fits.values()]}
    )
    grid = costs.join(scored, "run").select(
        "k", rounded("inertia", 2).alias("inertia"),
        rounded("silhouette", 4).alias("silhouette_score"),
        rounded("davies_bouldin", 4).alias("davies_bouldin"),
        rounded("calinski_harabasz", 2).alias("calinski_harabasz"),
    ).orderBy("k")
    return grid, {k: f.centres for k, f in fits.items()}


def nearest_labels(points: DataFrame, models: dict[str, np.ndarray]) -> DataFrame:
    """``points`` with the nearest centre of every model, in one pass."""
    held = points.sparkSession.sparkContext.broadcast(list(models.items()))
    names = points.columns
    schema = T.StructType(points.schema.fields + [T.StructField(m, T.IntegerType()) for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows_of(batch.column("x")) if batch.num_rows else np.zeros((0, 1))
            labels = [pa.array(_nearest(rows, c)[0].astype(np.int32) if len(rows) else np.zeros(0, np.int32)) for _, c in held.value]
            yield pa.RecordBatch.from_arrays([*batch.columns, *labels], names=[*names, *[m for m, _ in held.value]])

    return points.mapInArrow(run, schema)


def best_k(grid: DataFrame) -> int:
    return grid.orderBy(F.col("silhouette_score").desc(), "k").first()["k"]


@dataclass
class MixtureFit:
    """Gaussian components with full covariances, the heaviest first."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float  # of all rows
    rows: int
    rounds: int = 0

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k * d + k * d * (d + 1) // 2 + k - 1

    @property
    def bic(self) -> float:
        return -2 * self.log_likelihood + self.parameters * math.log(self.rows)

    @property
    def aic(self) -> float:
        return -2 * self.log_likelihood + 2 * self.parameters

    def factors(self) -> tuple[np.ndarray, ...]:
        """(log weights less the log determinants, means, inverse Cholesky factors)."""
        lower = np.linalg.cholesky(self.covariances)
        inverse = np.linalg.inv(lower)
        constant = np.log(np.maximum(self.weights, 1e-300)) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
        return constant - self.means.shape[1] / 2 * math.log(2 * math.pi), self.means, inverse

    def transform(self, df: DataFrame, out: str = "GMM_Cluster", probability: str | None = None, vec_col: str = "features") -> DataFrame:
        """Hard labels, and soft ones (an array) in ``probability`` if named."""
        factors = self.factors()

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:
            return pd.Series(list(_responsibilities(np.array(x.tolist(), dtype=float).reshape(len(x), -1), factors)[0]))

        soft = df.withColumn("_p", shares(as_array(df, vec_col)))
        labelled = soft.withColumn(out, (F.array_position("_p", F.array_max("_p")) - 1).cast("int"))
        return labelled.withColumnRenamed("_p", probability) if probability else labelled.drop("_p")

    def save(self, spark, path: str) -> None:
        small_table(spark, {
            "component": list(range(len(self.weights))), "weight": self.weights.tolist(), "mean": self.means.tolist(),
            "covariance": self.covariances.reshape(len(self.weights), -1).tolist(),
        }).coalesce(1).write.mode("overwrite").parquet(path)


def _responsibilities(rows: np.ndarray, factors: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """([row, component] shares, log density of each row)."""
    constant, means, inverse = factors
    logs = np.empty((len(rows), len(means)))
    for c in range(len(means)):
        logs[:, c] = constant[c] - 0.5 * (((rows - means[c]) @ inverse[c].T) ** 2).sum(axis=1)
    top = logs.max(axis=1, initial=-np.inf)
    shares = np.exp(logs - top[:, None])
    total = shares.sum(axis=1)
    return shares / total[:, None], top + np.log(total)


def _moments(points: DataFrame, shares_of) -> dict[int, np.ndarray]:
    """One pass for all open fits: per fit [component, 1 + d + d * d + 1] sums of share, share * x,
    share * x x', and, in the last column of the first component, of log densities. Tasks add
    up; only the sums are shuffled and collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows_of(batch.column("x"))
            for i, (shares, logs) in shares_of(rows):
                squares = np.stack([(rows * shares[:, c : c + 1]).T @ rows for c in range(shares.shape[1])])
                last = np.zeros((shares.shape[1], 1))
                last[0] = logs.sum()
                found = np.concatenate([shares.sum(axis=0)[:, None], shares.T @ rows, squares.reshape(len(squares), -1), last], axis=1)
                sums[i] = sums[i] + found if i in sums else found
        for i, value in sums.items():
            columns = [np.full(value.size, i), np.full(value.size, value.shape[1]), np.arange(value.size), value.reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fit", "width", "place", "v"])

    table = points.mapInArrow(run, "fit long, width long, place long, v double").groupBy("fit", "width", "place").agg(
        F.sum("v").alias("v")).toArrow().sort_by([("fit", "ascending"), ("place", "ascending")])
    fit, width, value = (table.column(c).to_numpy() for c in ("fit", "width", "v"))
    return {int(i): value[fit == i].reshape(-1, int(width[fit == i][0])) for i in np.unique(fit)}


def _maximised(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mass = np.maximum(sums[:, 0], 1e-9)
    means = sums[:, 1 : 1 + d] / mass[:, None]
    squares = sums[:, 1 + d : 1 + d + d * d].reshape(-1, d, d) / mass[:, None, None]
    return mass / mass.sum(), means, squares - means[:, :, None] * means[:, None, :] + REGULAR * np.eye(d)


def fit_mixtures(points: DataFrame, starts: dict[int, np.ndarray], rounds: int = MIXTURE_ROUNDS, settled: float = MIXTURE_SETTLED) -> dict[int, MixtureFit]:
    """Expectation-maximisation of every fit at once, on the rows of ``points`` (x).

    A fit starts from the rows' nearest of the given centres. Each round is one pass that all
    fits share; a fit is done when its mean log density rises by less than ``settled``.
    """
    first = points.sparkSession.sparkContext.broadcast(starts)
    hard = lambda rows: [(i, (np.eye(len(c))[_nearest(rows, c)[0]], np.zeros(1))) for i, c in first.value.items()]
    sums = _moments(points, hard)
    d = next(iter(starts.values())).shape[1]
    count = int(round(next(iter(sums.values()))[:, 0].sum()))
    fits = {i: MixtureFit(*_maximised(s, d), -math.inf, count) for i, s in sums.items()}
    open_fits = list(fits)
    for number in range(rounds + 1):
        held = points.sparkSession.sparkContext.broadcast({i: fits[i].factors() for i in open_fits})
        sums = _moments(points, lambda rows: ((i, _responsibilities(rows, f)) for i, f in held.value.items()))
        still = []
        for i in open_fits:
            before, reached = fits[i].log_likelihood, float(sums[i][0, -1])
            fits[i] = replace(fits[i], log_likelihood=reached, rounds=number)
            if number < rounds and (reached - before) / count >= settled:
                fits[i] = MixtureFit(*_maximised(sums[i], d), reached, count, number)
                still.append(i)
        open_fits = still
        if not open_fits:
            break
    return {i: _ordered(f) for i, f in fits.items()}


def _ordered(fit: MixtureFit) -> MixtureFit:
    order = sorted(range(len(fit.weights)), key=lambda c: (-fit.weights[c], tuple(fit.means[c])))
    return replace(fit, weights=fit.weights[order], means=fit.means[order], covariances=fit.covariances[order])


def _mixtures(matrix: DataFrame, id_col: str, ks, seed: int) -> dict[int, MixtureFit]:
    points = stage(sized_points(matrix, id_col), "points")
    found = fit_many(points, [Start(k, seed) for k in ks])
    return fit_mixtures(points.select("x"), {k: f.centres for k, f in zip(ks, found)})


def fit_mixture(matrix: DataFrame, k: int, seed: int = 42, id_col: str | None = None) -> MixtureFit:
    """ML-7: full covariances, started from a K-Means fit."""
    return _mixtures(matrix, id_col or matrix.columns[0], [k], seed)[k]


def mixture_grid(matrix: DataFrame, id_col: str, ks=GRID_COMPONENTS, seed: int = 42) -> DataFrame:
    """ML-8: BIC, AIC and quality by number of components, best BIC first."""
    fits = _mixtures(matrix, id_col, list(ks), seed)
    labelled = matrix.select(id_col, "features")
    for k, fit in fits.items():
        labelled = fit.transform(labelled, f"n{k}")
    labelled = stage(labelled, "labelled")
    scored = stage(evaluate(labelled, id_col, "features", [f"n{k}" for k in fits]), "ngrid")
    costs = small_table(
        matrix.sparkSession,
        {"run": [f"n{k}" for k in fits], "n_components": list(fits),
         "bic": [f.bic for f in fits.values()], "aic": [f.aic for f in fits.values()]},
    )
    return costs.join(scored, "run").select(
        "n_components", "bic", "aic", F.col("silhouette").alias("silhouette_score"),
        "davies_bouldin", "calinski_harabasz",
    ).orderBy("bic", "n_components")
