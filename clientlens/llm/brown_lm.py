"""Class-based n-gram scoring (Brown classes by exchange).

P(word | previous) = P(class of the word | history of the previous word) * P(word | its class),
mixed with a small share of the unigram model. Every training word has its own class, found
by exchange: words move to the class that fits their neighbours' best, and a pass stands
only if the class likelihood of the training texts rises; else half of its words move.

The ``FREQUENT`` most frequent words are exchanged first, over dense context counts. Then all
other words of the training texts are, however many there are: what precedes them is kept
as one row a word in a distributed table, and each pass is an aggregation of that table under
the broadcast class-by-class counts. The history of a frequent word is its class, that of
another word the class of its ending; words never seen in training take the class of their
ending too.

Only tables of fixed size are broadcast or collected (frequent words, endings, classes).
Counts and classes of all other words stay in a distributed table that the words of the
documents are joined with.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm.text import byte_values, chunks, mixed
from clientlens.llm.vocabulary import most_frequent, word_counts
from clientlens.session import small_table, stage

FREQUENT = 8192
ENDINGS = 1024
CLASSES = 64
PASSES = 10
#: Passes over the words outside the frequent ones.
FAR_PASSES = 2
#: Of the words outside them, those whose counts and classes are broadcast for scoring; the
#: others are joined with the table of all.
NEAR_WORDS = 100_000
PARTS = 64
CHUNK_TOKENS = 1 << 21
#: Share of the unigram model in each word, and the weight of class frequencies in transitions.
UNIGRAM_SHARE = 0.05
PRIOR = 20.0


def split_words(text: bytes) -> list[bytes]:
    return text.lower().split()


@dataclass(frozen=True)
class Numbering:
    """Numbers of the frequent words, then of the endings, then of the end of a text."""

    words: dict[bytes, int]
    frequent: int = FREQUENT
    endings: int = ENDINGS
    _tails: dict[bytes, int] = field(default_factory=dict, compare=False)

    @property
    def end(self) -> int:
        return self.frequent + self.endings

    @property
    def count(self) -> int:
        return self.end + 1

    def ending(self, word: bytes) -> int:
        return self.frequent + zlib.crc32(word.decode()[-2:].encode()) % self.endings

    def of(self, words: list[bytes]) -> list[int]:
        """The number of each word."""
        get, tails = self.words.get, self._tails
        out = [get(w, -1) for w in words]
        for at in [i for i, n in enumerate(out) if n < 0]:
            tail = words[at][-2:]
            number = tails.get(tail)
            if number is None:
                number = self.ending(words[at])
                if tail.isascii():  # two whole characters, or one
                    tails[tail] = number
            out[at] = number
        return out


@dataclass(frozen=True)
class ClassModel:
    numbers: Numbering
    counts: np.ndarray  # of the frequent words and, last, of the end
    classes: np.ndarray  # of every number
    factor: np.ndarray  # [history, class]: what (count + 1) is multiplied with
    tokens: int
    distinct: int
    far: DataFrame  # (word, n, class) of all other training words

    def held(self) -> ClassModel:
        """What tasks need of it."""
        return replace(self, far=None)


def contexts(texts: DataFrame, known) -> DataFrame:
    """(id, side, neighbour, n): how often each number follows (side 0) or precedes (side 1)
    each other one, as arrays. Tasks add up dense rows of their own ids, of fixed size."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        end, ids_all, held = numbers.end, numbers.count, [numbers.end]

        def told() -> Iterator[pa.RecordBatch]:
            ids = np.array(held, dtype=np.int64)
            both, n = np.unique(ids[:-1] * ids_all + ids[1:], return_counts=True)
            before, after = both // ids_all, both % ids_all
            for side, (own, other) in enumerate(((before, after), (after, before))):
                order = np.argsort(own % PARTS, kind="stable")
                cuts = np.searchsorted((own % PARTS)[order], np.arange(PARTS + 1))
                flat = [pa.array(x[order].astype(np.int32)) for x in (own, other, n)]
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), x) for x in flat]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, side, np.int32)), *lists],
                    names=["part", "side", "own", "other", "n"],
                )

        for batch in batches:
            for text in byte_values(batch.column("text")):
                held += numbers.of(split_words(text))
                held.append(end)
                if len(held) > CHUNK_TOKENS:
                    yield from told()
                    held = [end]
        if len(held) > 1:
            yield from told()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        ids_all = known.value.count
        for batch in batches:
            for row in range(batch.num_rows):
                part, side = batch.column("part")[row].as_py(), batch.column("side")[row].as_py()
                own, other, n = (batch.column(c)[row].values.to_numpy() for c in ("own", "other", "n"))
                if (part, side) not in sums:
                    sums[part, side] = np.zeros((-(-ids_all // PARTS), ids_all), dtype=np.int64)
                sums[part, side][own // PARTS, other] += n  # pairs are distinct within a row
        for (part, side), table in sums.items():
            for line in np.flatnonzero(table.any(axis=1)):
                full = np.flatnonzero(table[line])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([line * PARTS + part], pa.int32()), pa.array([side], pa.int32()),
                     pa.array([full.astype(np.int32)], pa.list_(pa.int32())), pa.array([table[line][full]], pa.list_(pa.int64()))],
                    names=["id", "side", "neighbour", "n"],
                )

    dealt = texts.select("text").mapInArrow(pairs, "part int, side int, own array<int>, other array<int>, n array<int>")
    return dealt.repartition(PARTS, "part").mapInArrow(added, "id int, side int, neighbour array<int>, n array<long>")


def _class_contexts(table: DataFrame, classes: np.ndarray, count: int) -> np.ndarray:
    """[side, id, class] counts under the present classes; a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("neighbour")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            cell = row * count + classes[lists.flatten().to_numpy()]
            sums = np.bincount(cell, weights=batch.column("n").flatten().to_numpy(), minlength=batch.num_rows * count)
            offsets = pa.array(np.arange(0, len(sums) + 1, count, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("side"), pa.ListArray.from_arrays(offsets, pa.array(sums))],
                names=["id", "side", "sums"],
            )

    found = table.mapInArrow(run, "id int, side int, sums array<double>").toArrow()
    out = np.zeros((2, len(classes), count))
    if found.num_rows:
        out[found.column("side").to_numpy(), found.column("id").to_numpy()] = (
            found.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, count)
        )
    return out


def _phi(x: np.ndarray) -> np.ndarray:
    """x ln x, zero where x is."""
    return x * np.log(np.maximum(x, 1))


def likelihood(follow: np.ndarray) -> float:
    """The part of the log-likelihood of the training texts that depends on the classes:
    log P(class | history) over all transitions, and log (1 / size of the class)."""
    return float(_phi(follow).sum() - _phi(follow.sum(axis=1)).sum() - _phi(follow.sum(axis=0)).sum())


def exchange(table: DataFrame, ids: int, passes: int = PASSES, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(class of every number, [side, number, class] context counts, likelihood after each pass).

    In each pass part of the numbers may move, each to the class with the largest gain in
    log-likelihood given the classes of its neighbours. A pass that lowers the likelihood is
    taken back and tried with half as many. The end of a text keeps a class of its own.
    """
    count, numbers, end = classes + 1, np.arange(ids), ids - 1
    own = numbers % classes
    own[end] = classes
    best, trail, share = None, [], 2
    for number in range(passes + 1):
        contexts_of = _class_contexts(table, own, count)
        follow = np.zeros((count, count))
        np.add.at(follow, own, contexts_of[0])
        reached = likelihood(follow)
        if best is None or reached >= best[0]:
            best = (reached, own, contexts_of, follow)
        else:
            share *= 2
        trail.append(best[0])
        if number == passes:
            break
        _, own, (after, before), follow = best
        gain = _dense_gains(follow.T, after, own) + _dense_gains(follow, before, own)  # [number, class]
        gain[:, classes] = -np.inf
        wanted = gain.argmax(axis=1)
        better = gain[numbers, wanted] > gain[numbers, own] + 1e-9
        turn = mixed((numbers + number * ids).astype(np.uint64)) % np.uint64(share) == 0
        own = np.where((numbers != end) & better & turn, wanted, own)
    return best[1], best[2], trail


def far_contexts(texts: DataFrame, known, histories) -> DataFrame:
    """(word, n, contexts of (history, n)): words outside the frequent ones and what precedes
    them. A row holds one entry a history at most; no word outside the frequent ones is frequent
    enough to weigh on one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, history_of = known.value, histories.value
        for batch in batches:
            texts = byte_values(batch.column("text"))
            for a, b in chunks(texts):
                asked, before = [], []
                for text in texts[a:b]:
                    words = split_words(text)
                    ids = np.array([numbers.end, *numbers.of(words)], dtype=np.int64)
                    far = ids[1:] >= numbers.frequent
                    asked += compress(words, far.tolist())
                    before.append(history_of[ids[:-1][far]].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked, pa.binary()).cast(pa.string()), pa.array(np.concatenate(before))], names=["word", "history"])

    sent = texts.select("text").mapInArrow(run, "word string, history int")
    # one shuffle: rows of a word meet, are added up by history, and become one row
    return sent.repartition("word").groupBy("word", "history").agg(F.count("*").alias("n")).groupBy("word").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("history", "n")).alias("contexts"))


@dataclass(frozen=True)
class Pass:
    """One exchange pass over the far words: transition counts before it, and who may move."""

    follow: np.ndarray
    salt: int
    share: int


_TABLED = 32  # counts up to which rises are looked up


def _rises(base: np.ndarray, which, n: np.ndarray) -> np.ndarray:
    """phi(base[which] + n) - phi(base[which]) along the last axis, for whole numbers n."""
    table = _phi(base + np.arange(_TABLED + 1).reshape(-1, *[1] * base.ndim)) - _phi(base)
    small = np.minimum(n, _TABLED).astype(np.int64)
    out = table[small] if which is None else table[small, which]
    large = np.flatnonzero(n > _TABLED)
    if len(large):
        at = base if which is None else base[which[large]]
        out[large] = _phi(at + n[large, None]) - _phi(at)
    return out


def _gains(follow: np.ndarray, row: np.ndarray, history: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """[word, class]: the exact change in likelihood if that word alone moved there.

    Entries (row, history, n) are ordered by row.
    """
    sizes = follow.sum(axis=0)
    begins = np.searchsorted(row, np.arange(len(own)))
    total = np.add.reduceat(n, begins)
    joins = np.add.reduceat(_rises(follow, history, n), begins, axis=0) - _rises(sizes, None, total)
    held = follow[history, own[row]]
    leaves = np.add.reduceat(_phi(held - n) - _phi(held), begins) - _phi(sizes[own] - total) + _phi(sizes[own])
    out = joins + leaves[:, None]
    out[np.arange(len(own)), own] = 0.0
    return out


def _dense_gains(follow: np.ndarray, contexts_of: np.ndarray, own: np.ndarray, rows: int = 1024) -> np.ndarray:
    """``_gains`` of all numbers from their [number, class] counts, a few at a time."""
    out = np.zeros(contexts_of.shape)
    used = np.flatnonzero(contexts_of.any(axis=1))
    for at in range(0, len(used), rows):
        here = used[at : at + rows]
        row, history = np.nonzero(contexts_of[here])
        out[here] = _gains(follow, row, history, contexts_of[here][row, history], own[here])
    return out


def _settled(batch: pa.RecordBatch, numbers: Numbering, first: np.ndarray, passes: list[Pass]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(class of each word of a batch after the passes, its entries)."""
    lists = batch.column("contexts")
    entries = lists.flatten()
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    history, n = (entries.field(k).to_numpy() for k in ("history", "n"))
    words = batch.column("word").cast(pa.binary()).to_pylist()
    own = np.array([first[numbers.ending(w)] for w in words], dtype=np.int64)
    names = mixed(np.array([zlib.crc32(w) for w in words], dtype=np.uint64))
    for step in passes:
        gain = _gains(step.follow, row, history, n, own)
        gain[:, -1] = -np.inf  # the class of the end
        wanted = gain.argmax(axis=1)
        moves = (gain[np.arange(len(own)), wanted] > 1e-9) & (mixed(names + np.uint64(step.salt)) % np.uint64(step.share) == 0)
        own = np.where(moves, wanted, own)
    return own, (row, history, n)


def exchange_far(table: DataFrame, numbers: Numbering, first: np.ndarray, rest: np.ndarray,
                 passes: int = FAR_PASSES) -> tuple[list[Pass], np.ndarray, list[float]]:
    """(passes to apply, [history, class] counts of all tokens, likelihood after each pass).

    ``first`` is the class a word starts from, by number of its ending, ``rest`` the counts of all
    tokens that are not in ``table``. The classes of the far words are never gathered: a pass is
    an aggregation of the table, and applying the passes anew gives the classes.
    """
    shape = rest.shape

    def counted(steps: list[Pass]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape[0] * shape[1], dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    own, (row, history, n) = _settled(batch, numbers, first, steps)
                    np.add.at(sums, history * shape[1] + own[row], n)
            full = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(sums[full])], names=["cell", "n"])

        cells = table.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        out = rest.reshape(-1).copy()
        for cell in cells:  # one row for each pair of classes at most
            out[cell["cell"]] += cell["n"]
        return out.reshape(shape)

    steps: list[Pass] = []
    follow, share = counted(steps), 1
    trail = [likelihood(follow)]
    for number in range(passes):
        tried = [*steps, Pass(follow, number, share)]
        moved = counted(tried)
        if likelihood(moved) > trail[-1]:
            steps, follow = tried, moved
        else:
            share *= 2
        trail.append(likelihood(follow))
    return steps, follow, trail


def train(texts: DataFrame, counts: DataFrame, most: int = FREQUENT, endings: int = ENDINGS) -> ClassModel:
    """Model of the rows of ``texts``; ``counts`` (word, n) are their words, without ends."""
    ends = texts.count()
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    frequent = most_frequent(counts, most)
    numbers = Numbering({w.encode(): i for i, (w, _) in enumerate(frequent)}, most, endings)
    context = texts.sparkSession.sparkContext
    known = context.broadcast(numbers)
    own, (_, before), _ = exchange(stage(contexts(texts, known), "contexts"), numbers.count)
    far = stage(far_contexts(texts, known, context.broadcast(own)), "far")

    near = np.append(np.arange(most), numbers.end)
    rest = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(rest.T, own[near], before[near])
    steps, follow, _ = exchange_far(far, numbers, own, rest)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _settled(batch, numbers, own, steps)[0] if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(found.astype(np.int32))], names=["word", "n", "class"])

    placed = stage(far.mapInArrow(classed, "word string, n long, class int"), "classes")
    mass = np.zeros(CLASSES + 1)
    for row in placed.groupBy("class").agg(F.sum(F.col("n") + 1).alias("mass")).collect():
        mass[row["class"]] += row["mass"]
    values = np.zeros(numbers.count)
    values[: len(frequent)] = [n for _, n in frequent]
    values[numbers.end] = ends
    held = np.append(np.arange(len(frequent)), numbers.end)
    np.add.at(mass, own[held], values[held] + 1)
    size = mass + 1  # and one share for unseen words
    shares = size / size.sum()
    moves = (follow + PRIOR * shares) / (follow.sum(axis=1, keepdims=True) + PRIOR)
    factor = (1 - UNIGRAM_SHARE) * moves / size + UNIGRAM_SHARE / (tokens + distinct + 1)
    return ClassModel(numbers, values, own, factor, tokens, distinct, placed)


def _near_words(far: DataFrame, size: int) -> tuple[dict[bytes, int], np.ndarray]:
    """(number of each word, [number, (n, class)]) of at most ``size`` words, the most frequent ones of
    ``far``; the last row stands for all others."""
    least = min((n for _, n in most_frequent(far, size)), default=1)
    rows = far.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).toArrow()
    words = rows.column("word").cast(pa.binary()).to_pylist()
    told = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("n", "class")], axis=1)
    return {w: i for i, w in enumerate(words)}, np.concatenate([told, [[-1, 0]]])


def score(docs: DataFrame, model: ClassModel, carry: list[str], text_col: str = "text", near_words: int = NEAR_WORDS) -> DataFrame:
    """``carry`` columns with n_tokens, n_known, base_score and score of every row."""
    spark = docs.sparkSession
    known = _near_words(model.far, near_words)
    held = spark.sparkContext.broadcast((model.held(), known))
    source = docs.select(*[F.col(c) for c in carry], F.col(text_col).alias("_scored_text"))
    kinds = ("_row long, n_tokens long, near_known long, near_sum double, class_sum double, "
             "far array<struct<word:string,history:int,ending:int>>")
    schema = T.StructType(source.schema.fields[:-1] + T.StructType.fromDDL(kinds).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (told, (known, figures_of)), row = held.value, TaskContext.get().partitionId() << 33
        factor, numbers = np.log10(told.factor), told.numbers
        number_of = known.get
        for batch in batches:
            texts = byte_values(batch.column("_scored_text"))
            for a, b in chunks(texts):
                figures, offsets = np.zeros((4, b - a)), [0]
                asked, histories, endings = [], [], []
                for at, text in enumerate(texts[a:b]):
                    words = split_words(text)
                    ids = np.array([numbers.end, *numbers.of(words), numbers.end], dtype=np.int64)
                    history, ids = told.classes[ids[:-1]], ids[1:]
                    other = (ids >= numbers.frequent) & (ids < numbers.end)
                    outside = np.flatnonzero(other)
                    own, count = told.classes[ids], told.counts[ids]
                    others = list(compress(words, other.tolist()))
                    found = figures_of[np.array([number_of(w, -1) for w in others], dtype=np.int64)]
                    count[outside] = found[:, 0]
                    own[outside] = np.where(found[:, 0] >= 0, found[:, 1], own[outside])
                    near = count >= 0
                    figures[:, at] = len(ids), (count[near] > 0).sum(), np.log10(count[near] + 1).sum(), factor[history[near], own[near]].sum()
                    far = ~near[outside]
                    asked += compress(others, far.tolist())
                    histories.append(history[outside][far]), endings.append(own[outside][far])
                    offsets.append(len(asked))
                entries = pa.StructArray.from_arrays([
                    pa.array(asked, pa.binary()).cast(pa.string()), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (histories, endings)),
                ], ["word", "history", "ending"])
                far_lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
                part = batch.slice(a, b - a)
                whole = [pa.array(x.astype(np.int64)) for x in (np.arange(row, row + b - a), *figures[:2])]
                row += b - a
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in carry] + whole + [pa.array(x) for x in figures[2:]] + [far_lists], names=schema.names)

    rows = stage(source.mapInArrow(run, schema), "scored")  # written once, so row numbers hold
    classes = model.factor.shape[1]
    logs = small_table(spark, {
        "history": np.repeat(np.arange(len(model.factor), dtype=np.int32), classes),
        "class": np.tile(np.arange(classes, dtype=np.int32), len(model.factor)), "link": np.log10(model.factor).reshape(-1),
    })
    joined = rows.select("_row", F.inline("far")).join(model.far, "word", "left").withColumn("class", F.coalesce("class", "ending"))
    far = joined.join(logs, ["history", "class"]).groupBy("_row").agg(
        F.count_if(F.col("n") > 0).alias("far_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("far_sum"),
        F.sum("link").alias("far_links"),
    )
    total = F.col("near_sum") + F.coalesce("far_sum", F.lit(0.0))
    return rows.drop("far").join(far, "_row", "left").select(
        *carry, "n_tokens", (F.col("near_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        (total - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.distinct + 1)))).alias("base_score"),
        (total + F.col("class_sum") + F.coalesce("far_links", F.lit(0.0))).alias("score"),
    )


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(id as text) modulo 7 is 2 are held out, the model learns from the
    others. A null id counts as empty text, a null text too: its only token is the end.
    Repeated rows all count and get equal scores. Without training rows all counts are zero.
    Other columns are not read; an empty table gives an empty result.
    """
    part = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(7))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (part == 2).alias("held_out"))
    learned = source.where(~F.col("held_out")).select("text")
    counts = stage(word_counts(learned, split_words), "counts")
    model = train(learned, counts)
    found = score(source, model, ["doc_id", "held_out"])
    return found.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op4_brown_lm(spark, folder: str) -> DataFrame:
    """Unigram and class-model scores of every document."""
    return score_corpus(spark.read.parquet(f"{folder}/documents.parquet"))
