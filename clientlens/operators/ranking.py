"""Global order statistics, quintiles, percentile ranks and row numbers at scale.

A window without a partition key sends every row to one task, so none is used on data of
unknown size. Exact quantiles and quintile edges are found by narrowing brackets around
the wanted ranks: a bounded sample proposes the brackets, one counting pass checks them,
and only a bracket known to be small is sorted. Rows never move.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientlens.functions.expressions import tuple_greater
from clientlens.session import stage

SORT_ROWS = 200_000  # rows one task may sort
SAMPLE_ROWS = 20_000  # rows a bracket sample brings to the driver


@dataclass
class _Bracket:
    """Rows of one measure with low < (key, id) < high; ``below`` rows come before."""

    measure: str
    ranks: list[int]
    below: int
    size: int
    low: tuple | None = None
    high: tuple | None = None

    def contains(self) -> Column:
        key, ident = F.col(self.measure), F.col("_id")
        inside = key.isNotNull()
        if self.low is not None:
            inside = inside & tuple_greater(key, ident, *self.low)
        if self.high is not None:
            inside = inside & _tuple_less(key, ident, *self.high)
        return inside


@dataclass
class _Point(_Bracket):
    """The rows equal to one (key, id), however many they are."""

    def contains(self) -> Column:
        return (F.col(self.measure) == F.lit(self.low[0])) & (F.col("_id") == F.lit(self.low[1]))


@dataclass
class OrderStatistics:
    rows: dict[str, int]
    values: dict[tuple[str, int], tuple] = field(default_factory=dict)

    def at(self, measure: str, rank: int) -> tuple:
        return self.values[(measure, rank)]


def _tuple_less(key: Column, ident: Column, bound_key, bound_id) -> Column:
    return (key < F.lit(bound_key)) | ((key == F.lit(bound_key)) & (ident < F.lit(bound_id)))


def order_statistics(
    df: DataFrame,
    id_expr: Column,
    measures: dict[str, Column],
    ranks_of,
    sort_rows: int = SORT_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> OrderStatistics:
    """(key, id) at chosen 1-based ranks of each measure, ordered by key, then id.

    ``ranks_of(measure, n)`` names the ranks wanted once the number of its non-null keys
    is known. Ids must not be null; repeated ids are allowed.
    """
    base = df.select(
        id_expr.alias("_id"), *[expr.cast("double").alias(m) for m, expr in measures.items()]
    )
    sizes = base.agg(*[F.count(m).alias(m) for m in measures]).first().asDict()
    result = OrderStatistics(sizes)
    todo = [
        _Bracket(m, sorted({r for r in ranks_of(m, n) if 1 <= r <= n}), 0, n)
        for m, n in sizes.items()
        if n
    ]
    level = 0
    while any(b.size > sort_rows for b in todo):
        level += 1
        todo = _narrow(base, todo, sort_rows, sample_rows, level, result)
    _read_ranks(base, todo, result)
    return result


def _narrow(base, brackets, sort_rows, sample_rows, level, result) -> list[_Bracket]:
    """Replace each large bracket by the pieces of it that hold wanted ranks.

    The sample only proposes where to cut; the counts decide. A cut point is a piece of
    its own, so every round removes at least that value and ties cannot stall it.
    """
    large = [b for b in brackets if b.size > sort_rows]
    kept = [b for b in brackets if b.size <= sort_rows]
    wanted = [
        F.when(
            b.contains() & (F.rand(level * 1000 + i) < sample_rows / b.size),
            F.struct(F.lit(i).alias("b"), F.col(b.measure).alias("k"), F.col("_id").alias("i")),
        )
        for i, b in enumerate(large)
    ]
    # expected size: sample_rows per bracket, whatever the table holds
    drawn = (
        base.select(F.explode(F.array_compact(F.array(*wanted))).alias("s")).select("s.*").toArrow().to_pydict()
    )
    samples: dict[int, list[tuple]] = {i: [] for i in range(len(large))}
    for number, key, ident in zip(drawn["b"], drawn["k"], drawn["i"]):
        samples[number].append((key, ident))

    pieces: list[tuple[_Bracket, _Bracket]] = []
    numbers = []
    for i, bracket in enumerate(large):
        points = sorted(samples[i])
        cuts = set()
        for rank in bracket.ranks:
            centre = (rank - bracket.below) / bracket.size * len(points)
            spread = 2.0 * math.sqrt(len(points)) + 2.0
            for position in (math.floor(centre - spread), math.ceil(centre + spread)):
                if 0 <= position < len(points):
                    cuts.add(points[position])
        low = bracket.low
        number = _piece_number(F.col(bracket.measure), F.col("_id"), sorted(cuts), len(pieces))
        numbers.append(F.when(bracket.contains(), number).alias(f"p{i}"))
        for cut in sorted(cuts):
            pieces.append((bracket, _Bracket(bracket.measure, [], 0, 0, low, cut)))
            pieces.append((bracket, _Point(bracket.measure, [], 0, 0, cut, cut)))
            low = cut
        pieces.append((bracket, _Bracket(bracket.measure, [], 0, 0, low, bracket.high)))
    owner = {id(b): f"p{i}" for i, b in enumerate(large)}
    counts = base.select(*numbers).agg(
        *[F.count_if(F.col(owner[id(parent)]) == i).alias(f"c{i}") for i, (parent, _) in enumerate(pieces)]
    ).first()

    position: dict[int, int] = {}
    for i, (parent, piece) in enumerate(pieces):
        piece.below = position.get(id(parent), parent.below)
        piece.size = counts[f"c{i}"]
        position[id(parent)] = piece.below + piece.size
        piece.ranks = [r for r in parent.ranks if piece.below < r <= piece.below + piece.size]
        if isinstance(piece, _Point):
            for rank in piece.ranks:
                result.values[(piece.measure, rank)] = piece.low
        elif piece.ranks:
            kept.append(piece)
    return kept


def _piece_number(key: Column, ident: Column, cuts: list[tuple], first: int) -> Column:
    """Number of the piece that holds (key, ident): below the first cut, that cut, between
    it and the next, … counted from ``first``, found by halving the cuts."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    cut = cuts[middle]
    at = first + 2 * middle + 1
    return (
        F.when(_tuple_less(key, ident, *cut), _piece_number(key, ident, cuts[:middle], first))
        .when(tuple_greater(key, ident, *cut), _piece_number(key, ident, cuts[middle + 1:], at + 1))
        .otherwise(F.lit(at))
    )


def _read_ranks(base: DataFrame, brackets: list[_Bracket], result: OrderStatistics) -> None:
    if not any(b.ranks for b in brackets):
        return
    members = [
        F.when(b.contains(), F.struct(F.lit(i).alias("b"), F.col(b.measure).alias("k")))
        for i, b in enumerate(brackets)
    ]
    position = F.row_number().over(Window.partitionBy("b").orderBy("k", "_id"))
    below = F.element_at(F.array(*[F.lit(b.below) for b in brackets]), F.col("b") + 1)
    hits = [
        (F.col("b") == i) & F.col("rank").isin(b.ranks) for i, b in enumerate(brackets) if b.ranks
    ]
    wanted = hits[0]
    for hit in hits[1:]:
        wanted = wanted | hit
    rows = (
        base.select("_id", F.explode(F.array_compact(F.array(*members))).alias("m"))
        .select("_id", "m.b", "m.k")
        .withColumn("rank", position + below)
        .where(wanted)
        .collect()
    )
    for row in rows:
        result.values[(brackets[row["b"]].measure, row["rank"])] = (row["k"], row["_id"])


def exact_quantiles(
    df: DataFrame, wanted: dict[str, Sequence[float]], **limits
) -> dict[str, dict[float, float]]:
    """Exact quantiles by linear interpolation between neighbouring ranks, nulls left out."""

    def ranks_of(column: str, n: int) -> Iterable[int]:
        for p in wanted[column]:
            spot = (n - 1) * p
            yield math.floor(spot) + 1
            yield math.ceil(spot) + 1

    stats = order_statistics(df, F.lit(0), {c: F.col(c) for c in wanted}, ranks_of, **limits)
    out: dict[str, dict[float, float]] = {}
    for column, probabilities in wanted.items():
        out[column] = {}
        for p in probabilities:
            if stats.rows[column] == 0:
                out[column][p] = None
                continue
            spot = (stats.rows[column] - 1) * p
            low = stats.at(column, math.floor(spot) + 1)[0]
            high = stats.at(column, math.ceil(spot) + 1)[0]
            out[column][p] = low + (high - low) * (spot - math.floor(spot))
    return out


def with_bins(
    df: DataFrame,
    id_col: str,
    measures: dict[str, Column],
    bins: int = 5,
    reverse: frozenset[str] = frozenset(),
    shrink_to_rows: bool = False,
    **limits,
) -> DataFrame:
    """Equal-count bins 1..q of each measure; the output column is the dict key.

    Rows are ranked by (measure, id); rank k of n falls in bin ceil((k-1)*q/(n-1)). Only
    the q-1 edge rows are looked up, so scoring is a projection. ``reverse`` measures
    count their bins from the top; ``shrink_to_rows`` uses min(q, n) bins.
    """

    def bin_count(n: int) -> int:
        return max(1, min(bins, n)) if shrink_to_rows else bins

    def edge(j: int, n: int) -> int:
        return j * (n - 1) // bin_count(n) + 1

    stats = order_statistics(
        df,
        F.col(id_col),
        measures,
        lambda _, n: [edge(j, n) for j in range(1, bin_count(n))],
        **limits,
    )
    scores = {}
    for name, expr in measures.items():
        n = stats.rows[name]
        q = bin_count(n)
        key, ident = expr.cast("double"), F.col(id_col)
        score = F.lit(1)
        if n:
            for j in range(1, q):
                bound = stats.at(name, edge(j, n))
                score = score + tuple_greater(key, ident, *bound).cast("int")
        scores[name] = (q + 1 - score if name in reverse else score).cast("int")
    return df.withColumns(scores)


def _split_points(df: DataFrame, key: str) -> list:
    """Ordered cut points that part ``df`` into about equal ranges of ``key``, by its rows."""
    n = df.count()
    if n <= SORT_ROWS:
        return []
    pieces = max(2, math.ceil(n / (SORT_ROWS / 2)))
    rate = int(min(1.0, SAMPLE_ROWS / n) * (1 << 31))
    sample = sorted(
        r[0] for r in df.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < rate).select(key).collect()
    )
    return sorted({sample[len(sample) * i // pieces] for i in range(1, pieces)} if sample else [])


def range_piece(key: Column, cuts: Sequence, first: int = 0) -> Column:
    """Number of the range that holds ``key``, as a balanced CASE over fixed cut points."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(
        key < F.lit(cuts[middle]), range_piece(key, cuts[:middle], first)
    ).otherwise(range_piece(key, cuts[middle + 1:], first + middle + 1))


def with_running_total(
    df: DataFrame, key: str, value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller ``key`` (keys unique), exactly.

    Rows are cut into ranges at fixed points, so a repeated task sees the same ranges;
    range totals are few and become constants, and each range sorts on its own.
    """
    valued = df.withColumn("_v", value)
    cuts = _split_points(df, key)
    ranged = valued.withColumn("_p", range_piece(F.col(key), cuts))
    offsets = F.lit(0).cast("long")
    if cuts:
        totals = {r["_p"]: r["t"] for r in ranged.groupBy("_p").agg(F.sum("_v").alias("t")).collect()}
        starts, running = [], 0
        for piece in range(len(cuts) + 1):
            starts.append(running)
            running += totals.get(piece, 0)
        offsets = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_p") + 1)
    earlier = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    total = offsets + F.coalesce(F.sum("_v").over(earlier), F.lit(0))
    return ranged.withColumn(out, total).drop("_v", "_p")


def with_row_number(df: DataFrame, key: str, out: str) -> DataFrame:
    """1-based position by a unique ``key``, without a single-task window."""
    numbered = with_running_total(df, key, F.lit(1).cast("long"), out)
    return numbered.withColumn(out, F.col(out) + 1)


def with_percent_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average-tie percentile rank of each column as ``<column>_pct``.

    Ranks are worked out once per distinct value and joined back, so a value shared by a
    third of all rows is one row while ranking. All columns are counted in one shuffle as
    (column, value, n); totals of fixed ranges of values, and a window inside each range,
    give the rows before a value. The ranked values are written: their known size decides
    whether a join back broadcasts them or shuffles and splits.
    """
    if not columns:
        return df
    values = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    counts = stage(
        df.select(F.inline(values)).where(F.col("_v").isNotNull()).groupBy("_i", "_v").agg(F.count("*").alias("_c")), "values"
    )
    own = lambda i: F.col("_i") == i
    piece, last = F.lit(None).cast("int"), []
    distinct = {r["_i"]: r["n"] for r in counts.groupBy("_i").agg(F.count("*").alias("n")).collect()}  # one row a column
    for i in range(len(columns)):
        few = distinct.get(i, 0) <= SORT_ROWS
        cuts = [] if few else _split_points(counts.where(own(i)), "_v")
        piece = F.when(own(i), range_piece(F.col("_v"), cuts, len(last))).otherwise(piece)
        last += [i] * (len(cuts) + 1)
    ranged = counts.withColumn("_p", piece)
    totals = {r["_p"]: r["t"] for r in ranged.groupBy("_p").agg(F.sum("_c").alias("t")).collect()}  # one row a range
    before, rows = [], [0] * len(columns)
    for number, i in enumerate(last):
        before.append(rows[i])
        rows[i] += totals.get(number, 0)
    at = lambda numbers, place: F.element_at(F.array(*[F.lit(n).cast("long") for n in numbers]), place + 1)
    earlier = F.coalesce(F.sum("_c").over(Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = (at(before, F.col("_p")) + earlier + (F.col("_c") + 1) / 2) / at(rows, F.col("_i"))
    ranked = stage(ranged.select("_i", "_v", share.alias("_share")), "ranked")
    out = df
    for i, column in enumerate(columns):
        found = ranked.where(own(i)).select(F.col("_v").alias("_key"), F.col("_share").alias(f"{column}_pct"))
        out = out.join(found, out[column].cast("double") == found["_key"], "left").drop("_key")
    return out


def stable_sample(df: DataFrame, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """At most ``size`` rows, uniform without replacement, whole table when smaller.

    The order of a seeded hash decides, so any partitioning gives the same sample.
    """
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(size)
