"""Hard negatives by shared lists of anchor clusters.

Anchors are clustered by direction. For a cluster, every candidate has one upper bound of its
inner product with any member: the angle between candidate and centre, less the widest angle
between a member and the centre, gives the largest cosine a member can reach. A block of
candidates is sorted by that bound once for each cluster; every member walks the shared list
from the top and stops where the bound certifies that nothing further on can still enter.

Two walks are taken: for the positives of an anchor, and, once their scores are known, for
the negatives inside the band of scores that each positive allows. Anchors are worked on in
passes of bounded bytes over all candidates. A task keeps the best rows of every anchor of
the pass while it goes through its blocks, so later blocks are cut off early, and sends on
no more than those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens.llm.text import smallest_hashes
from clientlens.session import small_table, stage

POSITIVES = 5
NEGATIVES = 10
#: Scores of negatives over scores of their positive, in hundredths.
BAND = (30, 90)
SCALE = 256
LABELS = 10
#: Bytes of anchors a pass broadcasts, anchors of a cluster on average, candidates of a block, and
#: list places a member looks at in one step.
PASS_BYTES = 32 << 20
CLUSTER_ROWS = 32
BLOCK_ROWS = 8192
STEP_ROWS = 256
SAMPLE_ANCHORS = 20_000
ROUNDS = 6
SEED = 13
_EXACT = float(1 << 53)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def prepared(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q): rows that take part, ``q`` holding floor(scale * x) of each component.

    Out are null ids, labels and vectors, vectors with null or non-finite components or without
    any, and those that differ in length from the most frequent length (of equally frequent
    ones the smallest). Components are kept as doubles holding whole numbers.
    """
    v = F.col(vector_col).cast("array<double>")
    held = vectors.select(F.col(id_col).alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).where(
        "vec_id is not null and label is not null and v is not null and size(v) > 0"
    ).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = held.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    # F.floor would round to a long; doubles of 2^53 and more are whole already
    whole = lambda x: F.when(F.abs(x) < _EXACT / scale, F.floor(x * scale).cast("double")).otherwise(x * scale)
    return held.where(F.size("v") == (sizes["size"] if sizes else 0)).select("vec_id", "label", F.transform("v", whole).alias("q"))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers [rows of a, rows of b], as longs.

    Doubles are exact below 2^53; beyond, Python's integers are. Products that no long
    holds become the nearest long.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object)
    return np.clip(whole(a).dot(whole(b).T), _LEAST, _MOST).astype(np.int64)


def _directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, lengths); zero rows keep a zero vector."""
    most = np.abs(rows).max(axis=1, keepdims=True)
    scaled = rows / np.where(most > 0, most, 1)  # squares neither overflow nor vanish
    length = np.sqrt((scaled * scaled).sum(axis=1))
    return scaled / np.where(length > 0, length, 1)[:, None], length * most[:, 0]


def clustered(units: np.ndarray, sample: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The cluster of each unit vector; centres are fitted on ``sample`` by spherical k-means."""
    count = max(1, len(units) // CLUSTER_ROWS)
    rng = np.random.default_rng(SEED)
    centres = sample[rng.permutation(len(sample))[:count]]
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        np.add.at(sums, _nearest(sample, centres), sample)
        fresh, length = _directions(sums)
        centres = np.where(length[:, None] > 0, fresh, centres)
    return _nearest(units, centres)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[i : i + 8192] @ centres.T).argmax(axis=1) for i in range(0, len(rows), 8192)] or [np.zeros(0, np.int64)])


@dataclass(frozen=True)
class Anchors:
    """Anchors of a pass, ordered by cluster. ``low`` and ``high`` are the bands of scores of a walk,
    [anchor, slot]: one open slot for positives, one band for each positive for negatives."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    length: np.ndarray
    begins: np.ndarray  # of the clusters, and the end
    centres: np.ndarray
    spread: np.ndarray  # widest angle of a member, by cluster
    low: np.ndarray
    high: np.ndarray
    positive: bool = True


def _anchors_of(table: pa.Table, sample: np.ndarray) -> Anchors:
    q = _matrix(table.column("q").combine_chunks())
    units, length = _directions(q)
    own = clustered(units, sample)
    order = np.argsort(own, kind="stable")
    q, units, length = q[order], units[order], length[order]
    begins = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) > 0, [True])))
    centres, _ = _directions(np.add.reduceat(units, begins[:-1], axis=0))
    each = np.repeat(np.arange(len(centres)), np.diff(begins))
    angles = np.arccos(np.clip((units * centres[each]).sum(axis=1), -1, 1))
    angles[length == 0] = 0.0  # a zero anchor scores zero with every row, whatever the angle
    labels = table.column("label").to_numpy()
    return Anchors(table.column("vec_id").to_numpy()[order], labels[order], q, length, begins, centres,
                   np.maximum.reduceat(angles, begins[:-1]), *(np.full((len(q), 1), x) for x in (_LEAST, _MOST)))


def _bounds(told: Anchors, cluster: int, units: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For every candidate, what its inner product with a member of unit length cannot exceed."""
    angle = np.arccos(np.clip(units @ told.centres[cluster], -1, 1)) - told.spread[cluster] - 1e-6
    return length * np.where(length > 0, np.cos(np.clip(angle, 0, np.pi)), 0.0) + length * 1e-9


class _Best:
    """The ``k`` best (score, id) of every slot, ties to smaller ids. ``bar`` is the score a row must
    reach to enter: the band's lower end, and, in a full slot, the least score held."""

    def __init__(self, low: np.ndarray, k: int) -> None:
        self.k, self.bar = k, low.copy()
        self.scores, self.ids = ([np.zeros(0, np.int64)] * low.size for _ in range(2))

    def add(self, slot: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        at = slot[0] * self.bar.shape[1] + slot[1]
        scores, ids = np.concatenate([self.scores[at], scores]), np.concatenate([self.ids[at], ids])
        order = np.lexsort((ids, ~scores))[: self.k]  # ~x falls as x grows, without overflow
        self.scores[at], self.ids[at] = scores[order], ids[order]
        if len(order) == self.k:
            self.bar[slot] = max(self.bar[slot], self.scores[at][-1])


def _walk(told: Anchors, best: _Best, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> int:
    """Lead every anchor through one block of candidates; returns how many products were taken."""
    units, length = _directions(q)
    taken = 0
    for cluster in range(len(told.centres)):
        bounds = _bounds(told, cluster, units, length)
        shared = np.argsort(-bounds, kind="stable")  # the list of the cluster, sorted once
        tops = bounds[shared]
        members = np.arange(told.begins[cluster], told.begins[cluster + 1])
        for at in range(0, len(shared), STEP_ROWS):
            reach = tops[at] * told.length[members]
            certified = (told.low[members] > told.high[members]) | (reach[:, None] < best.bar[members])
            members = members[~certified.all(axis=1)]
            if not len(members):
                break
            rows = shared[at : at + STEP_ROWS]
            scores = _products(told.q[members], q[rows])
            taken += scores.size
            same = told.labels[members][:, None] == labels[rows][None, :]
            wanted = same & (ids[rows][None, :] != told.ids[members][:, None]) if told.positive else ~same
            enters = wanted[:, None, :] & (scores[:, None, :] >= best.bar[members][:, :, None])
            enters &= scores[:, None, :] <= told.high[members][:, :, None]
            for line, number in np.argwhere(enters.any(axis=2)):
                fits = enters[line, number]
                best.add((members[line], number), scores[line, fits], ids[rows[fits]])
    return taken


def _best_rows(rows: DataFrame, told: Anchors, k: int) -> DataFrame:
    """(anchor_id, slot, vec_id, score): what each task keeps, k rows a slot at most."""
    shared = rows.sparkSession.sparkContext.broadcast(told)  # PASS_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        best, per_anchor = _Best(anchors.low, k), anchors.low.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                _walk(anchors, best, part.column("vec_id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("q")))
        sizes = [len(s) for s in best.scores]
        slots = np.repeat(np.arange(len(sizes)), sizes)
        columns = anchors.ids[slots // per_anchor], slots % per_anchor, *map(np.concatenate, (best.ids, best.scores))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "slot", "vec_id", "score"])

    found = rows.mapInArrow(run, "anchor_id long, slot long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _whole_parts(score: int, hundredths: int) -> tuple[int, int]:
    """(floor, ceiling) of score * hundredths / 100, for the largest and smallest score inside a bound."""
    return score * hundredths // 100, -(-score * hundredths // 100)


def mine(vectors: DataFrame, label: Column, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, scale: int = SCALE,
         pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` is an expression over ``vectors``, ``is_anchor`` one over ``vec_id``. A score is the
    inner product of the whole-number vectors; higher ones come first, ties to the smaller id.
    For each anchor and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of another label follow whose score is between ``band[0]`` and ``band[1]``
    hundredths of the positive's. Pairs without such a row are not returned. See ``prepared`` for
    the rows that take part; a row with the anchor's id is never its positive. Of rows that
    repeat the id of an anchor the one with the smallest vector asks; as candidates all of them
    count. An empty table gives an empty result, other columns are not read.
    """
    spark = vectors.sparkSession
    rows = stage(prepared(vectors, label, id_col, vector_col, scale), "whole")
    asking = stage(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("q", "label")).alias("x")).select(
        "vec_id", "x.label", "x.q"), "anchors")
    width = asking.select(F.size("q")).first()
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if width is None:
        return spark.createDataFrame([], kinds)
    passes = max(1, -(-asking.count() * (8 * width[0] + 200) // pass_bytes))
    drawn = smallest_hashes(asking, ["vec_id"], SAMPLE_ANCHORS).select("q").toArrow()
    sample, _ = _directions(_matrix(drawn.column("q").combine_chunks()))
    found = []
    for number in range(passes):
        part = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number).orderBy("vec_id").toArrow()
        if not part.num_rows:
            continue
        told = _anchors_of(part, sample)
        near = stage(_best_rows(rows, told, positives), "positives")
        best = near.select("anchor_id", "rank", "vec_id", "score").toArrow()  # ``positives`` rows an anchor at most
        place = np.argsort(told.ids)[np.searchsorted(np.sort(told.ids), best.column("anchor_id").to_numpy())]
        low, high = np.ones((len(told.ids), positives), np.int64), np.zeros((len(told.ids), positives), np.int64)
        for at, rank, score in zip(place, best.column("rank").to_pylist(), best.column("score").to_pylist()):
            low[at, rank - 1], high[at, rank - 1] = _whole_parts(score, band[0])[1], _whole_parts(score, band[1])[0]
        bands = Anchors(**{**vars(told), "low": low, "high": high, "positive": False})
        hard = _best_rows(rows, bands, negatives).select(
            "anchor_id", (F.col("slot") + 1).cast("int").alias("place"), "rank", F.col("vec_id").alias("negative_id"),
            F.col("score").alias("negative_score"))
        known = near.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"),
                            F.col("score").alias("positive_score"))
        found.append(stage(hard.join(known, ["anchor_id", "place"]).select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op13_hard_negatives(spark, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the label of every seventh is taken one further."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{folder}/embeddings.parquet"), moved, F.col("vec_id") % 100 == 0)


SQL = r"""
WITH rows AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * r.q[i])) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
