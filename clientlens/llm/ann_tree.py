"""Nearest neighbours by a hierarchical k-means tree with best-first search.

The tree is fitted on a bounded sample (``SAMPLE_ROWS``); every row is then filed under the
leaf its descent ends in. A search walks the tree with a priority queue, the branch whose
centre has the largest inner product with the query first, and visits leaves in that
order. How many leaves it visits is calibrated: a bounded set of queries is answered in
full, and the number of visits is widened until their recall reaches ``RECALL``.

Neighbouring leaves of few rows share a shelf, crowded leaves are cut into blocks. A query goes
to each shelf it visits once, with the leaves it visits there; shelves with many queries cut
those into blocks too, so a task compares two blocks of bounded size at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm.text import smallest_hashes
from clientlens.session import small_table, stage

SAMPLE_ROWS = 20_000
BRANCHES = 16
LEAF_ROWS = 48
ROUNDS = 8
RECALL = 0.95
CALIBRATION_QUERIES = 96
BLOCK_ROWS = 4096
BLOCK_QUERIES = 512
SEED = 7


@dataclass
class Tree:
    """Nodes in breadth-first order; ``children[i]`` are node numbers, empty for a leaf."""

    centres: list[np.ndarray]
    children: list[list[int]]

    def leaves(self) -> int:
        return sum(not c for c in self.children)

    def ordered_leaves(self) -> list[int]:
        """Leaves from left to right, so that neighbours share their last branches."""
        out, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            waiting += reversed(self.children[node])
            if not self.children[node]:
                out.append(node)
        return out

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf each row's descent to the nearest centre ends in."""
        at = np.zeros(len(rows), dtype=np.int64)
        waiting = [0]
        while waiting:
            node = waiting.pop()
            below = self.children[node]
            here = np.flatnonzero(at == node) if below else []
            if len(here):
                at[here] = np.array(below)[_closest(rows[here], self.centres[node])]
                waiting += below
        return at

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-first order."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not below:
                out.append(node)
                continue
            for child, nearness in zip(below, (self.centres[node] @ query).tolist()):
                heapq.heappush(queue, (-nearness, child))
        return out


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), dtype=np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for start in range(0, len(rows), 8192):
        out[start : start + 8192] = (rows[start : start + 8192] @ centres.T - half).argmax(axis=1)
    return out


def build(rows: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, rounds: int = ROUNDS) -> Tree:
    """Split every node of more than ``leaf_rows`` sample rows by k-means."""
    rng = np.random.default_rng(SEED)
    tree, waiting = Tree([np.zeros((0, rows.shape[1]))], [[]]), [(0, np.arange(len(rows)))]
    while waiting:
        node, members = waiting.pop(0)
        if len(members) <= leaf_rows:
            continue
        own = rows[members]
        different = np.unique(own, axis=0)
        if len(different) < 2:
            continue
        centres = different[rng.permutation(len(different))[:branches]]
        for _ in range(rounds):
            label = _closest(own, centres)
            sizes = np.bincount(label, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, label, own)
            centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        label = _closest(own, centres)
        used = np.flatnonzero(np.bincount(label, minlength=len(centres)))
        if len(used) < 2:
            continue
        tree.centres[node] = centres[used]
        for number in used:
            tree.children[node].append(len(tree.children))
            waiting.append((len(tree.children), members[label == number]))
            tree.children.append([])
            tree.centres.append(np.zeros((0, rows.shape[1])))
    return tree


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): rows that take part. Out are null ids and vectors, vectors that are zero,
    hold null or non-finite components, or differ in length from the most frequent length
    (of equally frequent ones the smallest)."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0"
    ).where(good & F.exists("v", lambda x: x != 0))
    sizes = held.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return held.where(F.size("v") == (sizes["size"] if sizes else 0))


def _shelves(leaves: list[int], sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(leaf, shelf, blocks of rows): leaves in order share a shelf up to ``BLOCK_ROWS`` rows; a
    larger one has its own, in several blocks."""
    out, shelf, held = [], 0, 0
    for leaf in leaves:
        n = sizes.get(leaf, 0)
        if n and held and held + n > BLOCK_ROWS:
            shelf, held = shelf + 1, 0
        if n:
            out.append((leaf, shelf, -(-n // BLOCK_ROWS)))
            held += n
    return out


def _best(
    scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, seen: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray]]:
    """For every row of ``scores`` the places of its k best, ties to smaller ids; ``ids`` ascend.
    With ``seen`` only places that are true there count."""
    for i, line in enumerate(scores):
        open_places = np.flatnonzero(ids != own[i] if seen is None else seen[i] & (ids != own[i]))
        if len(open_places) > k:
            values = line[open_places]
            least = np.partition(values, len(values) - k)[len(values) - k]
            open_places = open_places[values >= least]
        yield i, open_places[np.argsort(-line[open_places], kind="stable")][:k]


def _brute_force(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, leaf, vec_id, score): the k nearest of a bounded set of queries, in full."""
    asked = queries.toArrow()
    if not asked.num_rows:
        return rows.sparkSession.createDataFrame([], "query_id long, leaf long, vec_id long, score double")
    held = rows.sparkSession.sparkContext.broadcast(
        (asked.column("vec_id").to_numpy(), _matrix(asked.column("v").combine_chunks()))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = held.value
        for batch in batches:
            order = np.argsort(batch.column("vec_id").to_numpy(), kind="stable")
            own, leaf = batch.column("vec_id").to_numpy()[order], batch.column("leaf").to_numpy()[order]
            scores = points @ _matrix(batch.column("v"))[order].T
            out = [(np.full(len(p), ids[i]), leaf[p], own[p], scores[i, p]) for i, p in _best(scores, own, ids, k)]
            columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "leaf", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, leaf long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def calibrated_visits(tree: Tree, truth: list, queries: dict[int, np.ndarray], recall: float) -> int:
    """The smallest number of leaf visits at which the answers in ``truth`` (query_id, leaf) are
    found at the wanted rate."""
    needed = []
    for query, point in queries.items():
        order = {leaf: i + 1 for i, leaf in enumerate(tree.visits(point, tree.leaves()))}
        needed += [order[r["leaf"]] for r in truth if r["query_id"] == query]
    if not needed:
        return tree.leaves()
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query.

    ``is_query`` is a condition on ``vec_id``. Nearness is the inner product in double
    precision, ties go to the smaller id, a query's own id is no candidate. See ``usable``
    for the rows that take part. Of rows that repeat the id of a query the one with the
    smallest vector asks; as candidates all of them count. An empty table gives an empty
    result. Rows found lie in the visited leaves, so recall is about ``recall``.
    """
    spark = vectors.sparkSession
    clean = stage(usable(vectors, id_col, vector_col), "vectors")
    chosen = smallest_hashes(clean, ["vec_id", "v"], sample_rows).select("v").toArrow()
    sample = _matrix(chosen.column("v").combine_chunks()) if chosen.num_rows else np.zeros((0, 1))
    tree = build(sample)
    shared = spark.sparkContext.broadcast(tree)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaf_of(_matrix(batch.column("v"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["vec_id", "v", "leaf"])

    rows = stage(clean.mapInArrow(filed, "vec_id long, v array<double>, leaf long"), "filed")
    queries = stage(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    known = smallest_hashes(queries, ["vec_id"], CALIBRATION_QUERIES)
    asked = {r["vec_id"]: np.array(r["v"]) for r in known.collect()}
    visits = calibrated_visits(tree, _brute_force(rows, known, k).collect(), asked, recall)

    sizes = {r["leaf"]: r["n"] for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # one row a leaf
    shelves = _shelves(tree.ordered_leaves(), sizes)
    shelf_of = spark.sparkContext.broadcast({leaf: shelf for leaf, shelf, _ in shelves})

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("shelf", pa.int64()), ("leaves", pa.list_(pa.int64()))]))
        for batch in batches:
            stops = []
            for query in _matrix(batch.column("v")) if batch.num_rows else []:
                by_shelf: dict[int, list[int]] = {}
                for leaf in shared.value.visits(query, visits):
                    if leaf in shelf_of.value:
                        by_shelf.setdefault(shelf_of.value[leaf], []).append(leaf)
                stops.append([{"shelf": shelf, "leaves": leaves} for shelf, leaves in by_shelf.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stops, kind)], names=["vec_id", "v", "stops"])

    walks = stage(queries.mapInArrow(
        walked, "vec_id long, v array<double>, stops array<struct<shelf:long,leaves:array<long>>>"), "walks")
    table = small_table(spark, {
        "leaf": [x for x, _, _ in shelves], "shelf": [x for _, x, _ in shelves], "row_blocks": [x for _, _, x in shelves],
    }) if shelves else spark.createDataFrame([], "leaf long, shelf long, row_blocks long")
    visited = walks.select("vec_id", "v", F.inline("stops"))
    query_blocks = visited.groupBy("shelf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("query_blocks"))
    blocks = stage(table.select("shelf", "row_blocks").distinct().join(query_blocks, "shelf"), "blocks")
    part = lambda count: F.pmod(F.xxhash64("vec_id"), F.col(count))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    candidates = rows.join(table.select("leaf", "shelf"), "leaf").join(blocks, "shelf").withColumn(
        "a", part("row_blocks")).withColumn("b", every("query_blocks")).select("shelf", "a", "b", "vec_id", "v", "leaf")
    visitors = visited.join(blocks, "shelf").withColumn("b", part("query_blocks")).withColumn(
        "a", every("row_blocks")).select("shelf", "a", "b", "vec_id", "v", "leaves")

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("vec_id").to_numpy(), kind="stable")
            ids, asking = right.column("vec_id").to_numpy()[order], left.column("vec_id").to_numpy()
            points = _matrix(right.column("v").combine_chunks())[order]
            scores = _matrix(left.column("v").combine_chunks()) @ points.T
            here, place = np.unique(right.column("leaf").to_numpy()[order], return_inverse=True)
            seen = np.array([np.isin(here, leaves)[place] for leaves in left.column("leaves").to_pylist()])
            out += [(np.full(len(p), asking[i]), ids[p], scores[i, p]) for i, p in _best(scores, ids, asking, k, seen)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    found = visitors.groupBy("shelf", "a", "b").cogroup(candidates.groupBy("shelf", "a", "b")).applyInArrow(
        compared, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_ann_tree(spark, folder: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth id."""
    return search(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
