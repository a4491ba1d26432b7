"""Euclidean silhouettes of all rows, from cells with certain bounds.

A k-d tree of bounded size, fitted on a sample, cuts space into cells; of every cluster's
rows in a cell only number, mean and mean squared distance to it are kept. The mean
distance of a point to those rows is at least its distance D to their mean (convexity), and
at most sqrt(D^2 + s^2), s^2 being the mean squared distance (concavity). So each row gets
an interval for its mean distance to every cluster from the cells alone. Clusters that
cannot be the nearest other one are left out there and then; for the own and the remaining
ones, only those cells are opened - compared row by row, in blocks of bounded size - that
are needed to bring the value inside the wanted bound, the widest intervals first.

With a bound of zero every cell of those clusters is opened that is not a single point, and
the value is exact. Several labelings share the tree, the shuffle and the distances.

Where data are crowded or of many dimensions, a row asks for most cells, and writing its
requests would cost far more than the distances. A sample tells: beyond a few requests a
row, groups of near rows meet all rows of the clusters they want in one stream instead,
tile by tile, and no request is written. That costs every pair of those rows and clusters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.session import stage

CELL_ROWS = 512
MOST_CELLS = 4096
SAMPLE_ROWS = 65_536
BLOCK_ROWS = 4096
#: Rows whose intervals a task holds at a time.
PASS_CELLS = 1 << 21
#: Requests of a row, on average, up to which cells are opened one by one, and rows of the sample that tell.
FEW_REQUESTS = 16
PROBES = 256
#: Groups of rows that meet all rows: their number for a middling table, and their rows at most.
GROUPS = 12
GROUP_ROWS = 131_072
TILE_ROWS, TILE_COLUMNS = 512, 1024


@dataclass(frozen=True)
class Tree:
    """A full binary tree in heap order; a row goes right where its value is above the cut."""

    axis: np.ndarray
    cut: np.ndarray

    def cells_of(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), dtype=np.int64)
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            at = 2 * at + 1 + (rows[np.arange(len(rows)), self.axis[at]] > self.cut[at])
        return at - len(self.axis)


def fit_tree(sample: np.ndarray, cells: int) -> Tree:
    """Median cuts of the sample along the axis of largest variance."""
    depth = max(0, (max(cells, 1) - 1).bit_length())
    inner = (1 << depth) - 1
    axis, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    members = {0: np.arange(len(sample))}
    for node in range(inner):
        own = members.pop(node, np.zeros(0, dtype=np.int64))
        right = np.zeros(len(own), dtype=bool)
        if len(own) > 1:
            values = sample[own]
            axis[node] = values.var(axis=0).argmax()
            line = values[:, axis[node]]
            cut[node] = np.median(line)
            if cut[node] == line.max() and line.min() < line.max():  # many copies of the largest value
                cut[node] = line[line < line.max()].max()
            right = line > cut[node]
        if 2 * node + 2 < inner:
            members[2 * node + 1], members[2 * node + 2] = own[~right], own[right]
    return Tree(axis, cut)


def _matrix(lists: pa.Array) -> np.ndarray:
    if not len(lists):
        return np.zeros((0, 1))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


@dataclass(frozen=True)
class Summary:
    """Cells of one labeling by (label, cell): number, mean, mean squared distance to it."""

    label: np.ndarray
    cell: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def by_label(self) -> Summary:
        """One summary for all cells of a label."""
        begins = np.flatnonzero(np.concatenate(([True], self.label[1:] != self.label[:-1])))
        n = np.add.reduceat(self.n, begins)
        mean = np.add.reduceat(self.mean * self.n[:, None], begins) / n[:, None]
        squares = np.add.reduceat((self.spread + (self.mean * self.mean).sum(axis=1)) * self.n, begins) / n
        return Summary(self.label[begins], self.cell[begins], n, mean, np.maximum(squares - (mean * mean).sum(axis=1), 0) + 1e-12 * (1 + squares))

    def intervals(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[row, summary]: bounds of the sum of distances to the rows of each summary."""
        squares = (rows * rows).sum(axis=1)[:, None] + (self.mean * self.mean).sum(axis=1)[None, :] - 2 * rows @ self.mean.T
        slack = 1e-9 * (1 + np.abs(squares))  # of the cancellation above
        low = np.sqrt(np.maximum(squares - slack, 0)) * self.n
        return low, np.sqrt(np.maximum(squares + slack, 0) + self.spread) * self.n


def _wanted(told: Summary, own: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the rows of one labeling: bounds for each summary, the first summary and the size of each
    label, [row, label place] of the own and the possibly nearest other labels, and a lower bound of
    the larger of both mean distances. ``own`` is the place of each row's label."""
    begins = np.flatnonzero(np.concatenate(([True], told.label[1:] != told.label[:-1])))
    sizes = np.add.reduceat(told.n, begins)
    low, high = told.intervals(rows)
    every = np.arange(len(rows))
    least, most = (np.add.reduceat(x, begins, axis=1) for x in (low, high))
    others = np.maximum(sizes - 1, 1)[own]
    mine = np.zeros(least.shape, dtype=bool)
    mine[every, own] = True
    apart_low = np.where(mine, np.inf, least / sizes)
    reach = np.where(mine, np.inf, most / sizes).min(axis=1, initial=np.inf)
    wanted = mine | (apart_low <= reach[:, None])
    scale = np.maximum(least[every, own] / others, apart_low.min(axis=1, initial=np.inf))
    return low, high, begins, sizes, wanted, np.where(np.isfinite(scale), scale, 0.0)


def _needed(told: Summary, own: np.ndarray, rows: np.ndarray, bound: float) -> tuple[np.ndarray, ...]:
    """Requests of the rows of one labeling: (row, label place, closed sum) and (row, label place,
    cell) of the cells to open. ``own`` is the place of each row's label."""
    low, high, begins, sizes, wanted, scale = _wanted(told, own, rows)
    mine = np.arange(len(begins)) == own[:, None]
    others = np.maximum(sizes - 1, 1)[own]
    room = scale[:, None] * bound * np.where(mine, others[:, None], sizes[None, :])

    place = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(told.label))))
    width = np.where(wanted[:, place], high - low, 0.0)
    if bound > 0:  # keep the narrowest of each cluster closed, while they fit in together
        order = np.lexsort((width, np.broadcast_to(place, width.shape)), axis=1)
        ranked = np.take_along_axis(width, order, axis=1)
        total = np.cumsum(ranked, axis=1)
        before = np.concatenate([np.zeros((len(rows), 1)), np.take_along_axis(total, begins[None, 1:] - 1, axis=1)], axis=1)
        opens = np.zeros(width.shape, dtype=bool)
        np.put_along_axis(opens, order, total - before[:, place] > room[:, place], axis=1)
    else:
        opens = (width > 0) & ((told.spread > 0)[None, :] | (width > 1e-8 * low))  # the distance to a far point is known
    opens &= wanted[:, place]
    closed = np.where(wanted[:, place] & ~opens, (low + high) / 2, 0.0)
    row, at = np.nonzero(wanted)
    open_row, open_at = np.nonzero(opens)
    return row, at, np.add.reduceat(closed, begins, axis=1)[row, at], open_row, place[open_at], told.cell[open_at]


def euclidean_rows(df: DataFrame, id_col: str, vec_col: str, label_cols: list[str], bound: float = 0.0,
                   cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS) -> DataFrame:
    """(run, id, label, silhouette) of every row that is not noise (-1), by Euclidean distance.

    ``vec_col`` holds vectors or arrays. Each value is within ``bound`` of the exact one, and exact with a bound of zero. A cluster of
    one row, and a labeling of one cluster, score 0. Ids are unique. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    x = vector_to_array(F.col(vec_col)) if dict(df.dtypes)[vec_col] == "vector" else F.col(vec_col).cast("array<double>")
    labels = F.array(*[F.col(c).cast("int") for c in label_cols])
    points = stage(df.select(F.col(id_col).alias("id"), x.alias("x"), labels.alias("labels")), "points")
    id_field = points.schema["id"]
    count = points.count()
    draw, top = F.pmod(F.xxhash64("id"), F.lit(1 << 31)), 1 << 31
    sample = points.where(draw <= top * min(1.0, SAMPLE_ROWS / max(count, 1))).select("x", "labels").limit(2 * SAMPLE_ROWS).toArrow()
    kinds = T.StructType([T.StructField("run", T.StringType()), T.StructField(id_col, id_field.dataType), *T.StructType.fromDDL(
        "label int, silhouette double").fields])
    if not sample.num_rows:
        return spark.createDataFrame([], kinds)
    tree = fit_tree(_matrix(sample.column("x").combine_chunks()), min(most_cells, -(-count // (cell_rows * math.isqrt(len(label_cols))))))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = tree.cells_of(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["id", "x", "labels", "cell"])

    rows = stage(points.mapInArrow(filed, T.StructType([*points.schema.fields, T.StructField("cell", T.LongType())])), "filed")
    norm = F.aggregate("x", F.lit(0.0), lambda acc, y: acc + y * y)
    told = rows.select("x", "cell", F.posexplode("labels").alias("run", "label")).where("label <> -1").groupBy("run", "label", "cell").agg(
        F.count("*").alias("n"), Summarizer.mean(array_to_vector("x")).alias("m"), F.avg(norm).alias("norm"),
    ).select("run", "label", "cell", "n", vector_to_array("m").alias("m"), "norm").toArrow().sort_by(
        [("run", "ascending"), ("label", "ascending"), ("cell", "ascending")])
    summaries = {}
    for run in range(len(label_cols)):
        own = told.filter(pa.compute.equal(told.column("run"), run))
        if own.num_rows:
            mean, squares = _matrix(own.column("m").combine_chunks()), own.column("norm").to_numpy()
            spread = squares - (mean * mean).sum(axis=1)
            label, cell, n = (own.column(c).to_numpy() for c in ("label", "cell", "n"))
            # rounding must not turn a spread cell into a point, nor a single row into a spread one
            summaries[run] = Summary(label, cell, n, mean, np.where(n > 1, np.maximum(spread, 0) + 1e-12 * (1 + squares), 0.0))
    shared = spark.sparkContext.broadcast(summaries)  # at most one row for each cell and label in it
    names = F.element_at(F.array(*[F.lit(c) for c in label_cols]), F.col("run") + 1)
    if summaries and _requests(sample, summaries, bound) > FEW_REQUESTS:
        scored = _met(rows, _telling(sample, summaries), count, id_field, bound)
        return scored.select(names.alias("run"), F.col("id").alias(id_col), "label", "silhouette")

    kinds_asked = T.StructType([id_field, *T.StructType.fromDDL(
        "run int, label int, own boolean, n long, closed double, cell long, x array<double>, codes array<long>").fields])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        widest = max(len(s.n) for s in runs.values()) if runs else 1
        step = max(1, PASS_CELLS // widest)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield from told_of(batch.slice(at, step), runs)

    def told_of(batch: pa.RecordBatch, runs: dict[int, Summary]) -> Iterator[pa.RecordBatch]:
        x, given = _matrix(batch.column("x")), _matrix(batch.column("labels")).astype(np.int64)
        base, opened = [], []
        for run, summary in runs.items():
            names, sizes = np.unique(summary.label).astype(np.int64), np.add.reduceat(summary.n, np.flatnonzero(np.diff(summary.label, prepend=summary.label[0] - 1)))
            here = np.flatnonzero(given[:, run] != -1)
            if not len(here):
                continue
            own = np.searchsorted(names, given[here, run])
            row, place, closed, open_row, open_place, cell = _needed(summary, own, x[here], bound)
            base.append((here[row], np.full(len(row), run), names[place], own[row] == place, sizes[place], closed))
            opened.append((here[open_row], cell, run * (1 << 32) + names[open_place]))
        if not base:
            return
        row, run, label, mine, n, closed = map(np.concatenate, zip(*base))
        none = lambda kind: pa.nulls(len(row), kind)
        columns = [run.astype(np.int32), label.astype(np.int32), mine, n.astype(np.int64), closed]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(row)), *map(pa.array, columns), none(pa.int64()), none(pa.list_(pa.float64())),
             none(pa.list_(pa.int64()))], names=kinds_asked.names)
        row, cell, code = map(np.concatenate, zip(*opened))
        if not len(row):
            return
        order = np.lexsort((code, cell, row))
        row, cell, code = row[order], cell[order], code[order]
        begins = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]))))
        codes = pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)).astype(np.int32)), pa.array(code))
        picked = pa.array(row[begins])
        none = lambda kind: pa.nulls(len(begins), kind)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(picked), none(pa.int32()), none(pa.int32()), none(pa.bool_()), none(pa.int64()), none(pa.float64()),
             pa.array(cell[begins]), batch.column("x").take(picked), codes], names=kinds_asked.names)

    requests = stage(rows.mapInArrow(asked, kinds_asked), "asked")
    base = requests.where("cell is null").select("id", "run", "label", "own", "n", "closed")
    askers = requests.where("cell is not null").select("cell", "id", "x", "codes")

    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("row_blocks"))
    turns = askers.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("asker_blocks"))
    blocks = stage(sizes.join(turns, "cell"), "blocks")
    part = lambda name: F.pmod(F.xxhash64("id"), F.col(name))
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    left = askers.join(blocks, "cell").withColumn("b", part("asker_blocks")).withColumn("a", each("row_blocks")).select(
        "cell", "a", "b", "id", "x", "codes")
    right = rows.join(blocks, "cell").withColumn("a", part("row_blocks")).withColumn("b", each("asker_blocks")).select(
        "cell", "a", "b", "x", "labels")
    opened = left.groupBy("cell", "a", "b").cogroup(right.groupBy("cell", "a", "b")).applyInArrow(
        lambda asking, held: _compared(asking, held, bound == 0), T.StructType([id_field, *T.StructType.fromDDL("run int, label int, distance double").fields]))
    sums = opened.groupBy("id", "run", "label").agg(F.sum("distance").alias("distance"))
    known = base.join(sums, ["id", "run", "label"], "left").withColumn("total", F.col("closed") + F.coalesce("distance", F.lit(0.0)))
    per_row = known.groupBy("id", "run").agg(
        F.max(F.when(F.col("own"), F.col("label"))).alias("label"),
        F.max(F.when(F.col("own") & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("inner"),
        F.min(F.when(~F.col("own"), F.col("total") / F.col("n"))).alias("other"),
    )
    larger = F.greatest("inner", "other")
    score = F.when(F.col("inner").isNotNull() & F.col("other").isNotNull() & (larger > 0), (F.col("other") - F.col("inner")) / larger)
    return per_row.select(names.alias("run"), F.col("id").alias(id_col), "label", F.coalesce(score, F.lit(0.0)).alias("silhouette"))


def _probed(sample: pa.Table, summaries: dict[int, Summary]) -> Iterator[tuple]:
    """(labeling, its summaries, some rows of the sample, their places in it, their values)."""
    picked = sample.take(np.unique(np.linspace(0, sample.num_rows - 1, min(PROBES, sample.num_rows)).astype(np.int64)))
    x, given = (_matrix(picked.column(c).combine_chunks()) for c in ("x", "labels"))
    for run, told in summaries.items():
        here = np.flatnonzero(np.nan_to_num(given[:, run], nan=-1) != -1)
        if len(here):
            yield run, told, here, np.searchsorted(np.unique(told.label), given[here, run]), x[here]


def _requests(sample: pa.Table, summaries: dict[int, Summary], bound: float) -> float:
    """Cells that a row of the sample asks for, on average."""
    asked = [np.zeros((2, 0), dtype=np.int64)]
    for _, told, here, own, x in _probed(sample, summaries):
        *_, row, _, cell = _needed(told, own, x, bound)
        asked.append(np.stack([here[row], cell]))
    return np.unique(np.concatenate(asked, axis=1), axis=1).shape[1] / min(PROBES, sample.num_rows)


def _telling(sample: pa.Table, summaries: dict[int, Summary]) -> dict[int, Summary]:
    """For each labeling its cells, or one summary a label where cells rule out hardly more pairs."""
    out = dict(summaries)
    for run, told, _, own, x in _probed(sample, summaries):
        whole = told.by_label()
        share = lambda t: (lambda found: (found[4] * found[3]).sum() / len(x) / found[3].sum())(_wanted(t, own, x))
        out[run] = told if share(told) < 0.9 * share(whole) else whole
    return out


def _met(rows: DataFrame, summaries: dict[int, Summary], count: int, id_field: T.StructField, bound: float) -> DataFrame:
    """(run, id, label, silhouette): groups of near rows, each beside a stream of all rows.

    Rows are dealt to the groups in the order of their cells, in equal shares, so a crowded cell is
    parted. The stream is sorted by labels: a tile holds few of them, and is skipped by rows that
    want none. Tasks hold one group and a batch of the stream.
    """
    groups = max(min(GROUPS, -(-count // BLOCK_ROWS)), -(-count // GROUP_ROWS))
    sizes = rows.groupBy("cell").count().toArrow()  # one row a cell
    cells, numbers = sizes.column("cell").to_numpy(), sizes.column("count").to_numpy()
    held = np.zeros(int(cells.max()) + 1)
    held[cells] = numbers
    before = np.cumsum(held) - held
    shared = rows.sparkSession.sparkContext.broadcast(summaries)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, draw = batch.column("cell").to_numpy(), batch.column("draw").to_numpy()
            group = np.minimum((before[cell] + draw * held[cell]) * groups // count, groups - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), pa.array(cell - (1 << 40)), *(batch.column(c) for c in ("id", "x", "labels"))], names=["group", "key", "id", "x", "labels"])

    kind = lambda fields: T.StructType([*T.StructType.fromDDL(fields).fields, id_field])
    valued = rows.where(F.exists("labels", lambda v: ~v.eqNullSafe(F.lit(-1))))
    draw = F.pmod(F.xxhash64("id", "x"), F.lit(1 << 31)) / float(1 << 31)
    asking = valued.select("id", "x", "labels", "cell", draw.alias("draw")).mapInArrow(
        dealt, T.StructType([*T.StructType.fromDDL("group int, key long").fields, id_field, rows.schema["x"], rows.schema["labels"]]))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    stream = valued.select(every, F.shiftrightunsigned(F.xxhash64("labels"), 1).alias("key"), F.lit(None).cast(id_field.dataType).alias("id"), "x", "labels")
    ordered = asking.unionByName(stream).repartitionById(groups, "group").sortWithinPartitions("key").drop("group")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, group = [], None
        for batch in batches:
            edge = int(np.searchsorted(batch.column("key").to_numpy(), 0)) if batch.num_rows else 0
            if edge:
                own.append(batch.slice(0, edge))
            if edge < batch.num_rows and own:
                group = group or Group(pa.Table.from_batches(own), shared.value, bound)
                group.meet(*(_matrix(batch.column(c).slice(edge)) for c in ("x", "labels")))
        if group:
            yield from group.told()

    return ordered.mapInArrow(compared, kind("run int, label int, silhouette double"))


class Group:
    """Rows in tiles with the sums of their distances to the labels that a row of the tile wants.

    Labels of all labelings are numbered one after the other (``place``). Squared distances come from
    one product of matrices of centred rows; those too small for its rounding are taken anew from the
    differences. With a bound above zero single precision does, where its rounding is a small share of it.
    """

    def __init__(self, table: pa.Table, runs: dict[int, Summary], bound: float):
        x, given = (_matrix(table.column(c).combine_chunks()) for c in ("x", "labels"))
        once = ~table.select(["id"]).to_pandas().assign(row=[r.tobytes() for r in x]).duplicated().to_numpy()
        self.ids, x, given = table.column("id").combine_chunks().filter(pa.array(once)), x[once], given.astype(np.int64)[once]
        self.names = {run: np.unique(told.label).astype(np.int64) for run, told in runs.items()}
        self.first = dict(zip(runs, np.cumsum([0, *(len(n) for n in self.names.values())])))
        self.size = np.concatenate([np.add.reduceat(t.n, np.searchsorted(t.label, self.names[r])) for r, t in runs.items()])
        told = next(iter(runs.values()))
        self.centre = (told.mean * told.n[:, None]).sum(axis=0) / told.n.sum()
        self.single, self.bound = bound > 0, bound
        self.space = np.empty(TILE_ROWS * TILE_COLUMNS, dtype=np.float32 if self.single else float)
        self.tiles = [self._tile(x[at : at + TILE_ROWS], given[at : at + TILE_ROWS], runs) for at in range(0, len(x), TILE_ROWS)]

    def _tile(self, x: np.ndarray, given: np.ndarray, runs: dict[int, Summary]) -> dict:
        own = np.full((len(x), len(runs)), -1)
        wanted, scale = np.zeros((len(x), len(self.size)), dtype=bool), np.inf
        for number, (run, told) in enumerate(runs.items()):
            begin, names = self.first[run], self.names[run]
            here = np.flatnonzero(given[:, run] != -1)
            step = max(1, PASS_CELLS // len(told.n))
            for at in range(0, len(here), step):
                part = here[at : at + step]
                place = np.searchsorted(names, given[part, run])
                *_, wants, least = _wanted(told, place, x[part])
                own[part, number] = begin + place
                wanted[part, begin : begin + len(names)] = wants
                scale = min(scale, least.min())
        used = np.flatnonzero(wanted.any(axis=0))
        at = np.full(len(self.size) + 1, -1)  # the last one stands for no label
        at[used] = np.arange(len(used))
        x = x - self.centre
        squares = (x * x).sum(axis=1)
        left = np.concatenate([-2 * x, squares[:, None], np.ones((len(x), 1))], axis=1)
        return {"x": x, "left": left.astype(np.float32) if self.single else left, "most": squares.max(), "scale": scale, "own": own,
                "used": used, "at": at, "wanted": wanted[:, used], "sums": np.zeros((len(x), len(used)))}

    def meet(self, x: np.ndarray, labels: np.ndarray) -> None:
        x = x - self.centre
        squares = (x * x).sum(axis=1)
        right = np.concatenate([x, np.ones((len(x), 1)), squares[:, None]], axis=1)
        right = right.astype(np.float32) if self.single else right
        changes = np.concatenate(([True], (labels[1:] != labels[:-1]).any(axis=1)))
        kind, kinds = np.cumsum(changes) - 1, np.full((int(changes.sum()), len(self.names)), len(self.size))
        for number, (run, names) in enumerate(self.names.items()):
            label = labels[changes, run]
            place = np.minimum(np.searchsorted(names, label), len(names) - 1)
            kinds[:, number] = np.where(names[place] == label, self.first[run] + place, len(self.size))
        begins = np.append(np.flatnonzero(changes), len(x))
        at = 0
        while at < len(x):
            # whole kinds of equal labels while they fit, or a part of one
            fits = begins[np.searchsorted(begins, at + TILE_COLUMNS, side="right") - 1]
            end = int(fits) if fits > at else min(at + TILE_COLUMNS, int(begins[kind[at] + 1]))
            self._meet(x[at:end], right[at:end].T, squares[at:end].max(), kind[at:end] - kind[at], kinds[kind[at] : kind[end - 1] + 1])
            at = end

    def _meet(self, x: np.ndarray, right: np.ndarray, most: float, kind: np.ndarray, kinds: np.ndarray) -> None:
        member = np.zeros((len(x), len(kinds)), dtype=right.dtype)
        member[np.arange(len(x)), kind] = 1
        for tile in self.tiles:
            columns = tile["at"][kinds]
            of, run = np.nonzero(columns >= 0)
            if not len(of):
                continue
            column = columns[of, run]
            rows = np.flatnonzero(tile["wanted"][:, np.unique(column)].any(axis=1))
            if not len(rows):
                continue
            rows = slice(None) if len(rows) > 0.8 * len(tile["x"]) else rows
            distance = self._distances(tile["x"][rows], tile["left"][rows], x, right, tile["most"] + most, tile["scale"])
            to = np.zeros((len(kinds), len(tile["used"])))
            to[of, column] = 1
            tile["sums"][rows] += (distance @ member) @ to

    def _distances(self, a: np.ndarray, left: np.ndarray, b: np.ndarray, right: np.ndarray, most: float, scale: float) -> np.ndarray:
        squares = np.matmul(left, right, out=self.space[: len(a) * len(b)].reshape(len(a), -1))
        error = (a.shape[1] + 5) * float(np.finfo(squares.dtype).eps) * most  # of a square at most
        edge = 1e9 * error
        if self.single:  # mean distances may be off by half the bound; sums round a little too
            edge = (error / (0.4 * self.bound * scale)) ** 2 + 3 * error if scale > 0 else np.inf
        near = np.flatnonzero(squares.min(axis=1) < edge)
        if len(near):
            at, column = np.nonzero(squares[near] < edge)
            if self.single and len(at) > 0.05 * squares.size:
                exact = a @ (-2 * b.T) + (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)
                return self._settled(a, b, exact, 1e9 * error * float(np.finfo(float).eps / np.finfo(np.float32).eps))
            squares[near[at], column] = ((a[near[at]] - b[column]) ** 2).sum(axis=1)
        return np.sqrt(squares, out=squares)

    @staticmethod
    def _settled(a: np.ndarray, b: np.ndarray, squares: np.ndarray, edge: float) -> np.ndarray:
        row, column = np.nonzero(squares < edge)
        squares[row, column] = ((a[row] - b[column]) ** 2).sum(axis=1)
        return np.sqrt(squares, out=squares)

    def told(self) -> Iterator[pa.RecordBatch]:
        for number, tile in enumerate(self.tiles):
            ids = self.ids.slice(number * TILE_ROWS, TILE_ROWS)
            for place, run in enumerate(self.names):
                here = np.flatnonzero(tile["own"][:, place] >= 0)
                if not len(here):
                    continue
                own, begin = tile["own"][here, place], self.first[run]
                inside = np.flatnonzero((tile["used"] >= begin) & (tile["used"] < begin + len(self.names[run])))
                mean = np.where(tile["wanted"][np.ix_(here, inside)], tile["sums"][np.ix_(here, inside)] / self.size[tile["used"][inside]], np.inf)
                mean[tile["used"][inside] == own[:, None]] = np.inf
                other, n = mean.min(axis=1), self.size[own]
                inner = tile["sums"][here, tile["at"][own]] / np.maximum(n - 1, 1)
                larger = np.maximum(inner, other)
                known = (n > 1) & np.isfinite(other) & (larger > 0)
                score = np.where(known, (other - inner) / np.where(known, larger, 1), 0.0) if known.any() else np.zeros(len(here))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(here), run, np.int32)), pa.array(self.names[run][own - begin].astype(np.int32)), pa.array(score), ids.take(pa.array(here))],
                    names=["run", "label", "silhouette", "id"])


def _compared(left: pa.Table, right: pa.Table, exact: bool) -> pa.Table:
    """(id, run, label, distance): sums of distances from each asking row to the rows of the labels it
    asks for. ``exact`` takes differences, so that near rows keep all their digits."""
    names = ["id", "run", "label", "distance"]
    if not left.num_rows or not right.num_rows:
        return pa.table([left.column("id").slice(0, 0), *(pa.array([], k) for k in (pa.int32(), pa.int32(), pa.float64()))], names=names)
    a, b = (_matrix(t.column("x").combine_chunks()) for t in (left, right))
    lists = left.column("codes").combine_chunks()
    code = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(a)), np.diff(lists.offsets.to_numpy()))
    labels = _matrix(right.column("labels").combine_chunks()).astype(np.int64)
    run, label, out = code >> 32, code & 0xFFFFFFFF, np.zeros(len(code))
    step = max(1, (1 << 22) // len(b))
    for at in range(0, len(a), step):
        own = a[at : at + step]
        if exact:
            squares = np.zeros((len(own), len(b)))
            for axis in range(a.shape[1]):
                squares += (own[:, axis][:, None] - b[None, :, axis]) ** 2
        else:
            squares = own @ (-2 * b.T)
            squares += (own * own).sum(axis=1)[:, None]
            squares += (b * b).sum(axis=1)
            np.maximum(squares, 0, out=squares)
        distance = np.sqrt(squares, out=squares)
        here = (row >= at) & (row < at + step)
        for number in np.unique(run[here]):
            present, column = np.unique(labels[:, number], return_inverse=True)
            sums = distance @ np.eye(len(present))[column]
            mine = np.flatnonzero(here & (run == number))
            place = np.minimum(np.searchsorted(present, label[mine]), len(present) - 1)
            found = present[place] == label[mine]
            out[mine[found]] = sums[row[mine[found]] - at, place[found]]
    columns = [left.column("id").take(pa.array(row)), pa.array(run.astype(np.int32)), pa.array(label.astype(np.int32)), pa.array(out)]
    return pa.table(columns, names=names)
