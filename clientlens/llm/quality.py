"""Quality classifier: ordinal cumulative-link regression over hashed text.

Labels are read as grades: 0 toxic, 1 poor, 2 good. One weight vector over hashed words and
binned style figures gives every document a place on a line; ordered thresholds cut the
line into grades, P(grade > k) = sigmoid(score - threshold_k). Fitting uses a bounded sample
of labelled rows (``LABELLED_ROWS``); scoring reads every document once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm.text import byte_values, chunks, smallest_hashes, word_hashes

#: Bound of the labelled rows used for fitting, those with the smallest hash of their id.
LABELLED_ROWS = 16_000
BUCKETS = 1 << 18
STEM_BYTES = 4
GRADES = 3
KEEP_AT = 0.5
ROUNDS = 80
RIDGE = 3e-4
STEP = 0.05

_TO_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Cut points of the style figures: share of upper case, of punctuation, of distinct words; word
#: length; punctuation repeated at once, for each word.
_CUTS = (
    np.array([0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7]),
    np.array([0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3]),
    np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]),
    np.array([2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0]),
    np.array([0.001, 0.01, 0.03, 0.1, 0.2, 0.4, 0.8, 1.5]),
)
_STYLE = sum(len(c) + 1 for c in _CUTS)
WIDTH = BUCKETS + _STYLE


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the features of a chunk of texts, in row order.

    Every distinct word of a text counts once, whatever its case and punctuation, and so does
    every distinct beginning of ``STEM_BYTES`` bytes.
    """
    plain = [t.translate(_TO_PLAIN) for t in texts]
    codes, counts = word_hashes(plain)
    stems, _ = word_hashes(plain, STEM_BYTES)
    row = np.repeat(np.arange(len(texts)), counts)
    mask = np.uint64(BUCKETS - 1)
    cells = np.unique(row * BUCKETS + (codes & mask).astype(np.int64))
    distinct = np.bincount(cells // BUCKETS, minlength=len(texts))
    cells = np.concatenate([cells, np.unique(row * BUCKETS + ((stems >> np.uint64(20)) & mask).astype(np.int64))])
    row, column = cells // BUCKETS, cells % BUCKETS
    style = np.zeros((len(texts), len(_CUTS)))
    for i, text in enumerate(texts):
        signs = np.frombuffer(text, np.uint8)
        bytes_of = np.bincount(signs, minlength=256)
        again = np.count_nonzero(_MARK[signs[1:]] & (signs[1:] == signs[:-1]))
        upper, lower, marks = bytes_of[_UPPER].sum(), bytes_of[_LOWER].sum(), bytes_of[_MARK].sum()
        style[i] = (
            upper / max(upper + lower, 1), marks / max(len(text), 1),
            distinct[i] / max(counts[i], 1), (len(text) - marks) / max(counts[i], 1) - 1, again / max(counts[i], 1),
        )
    begin, bins = BUCKETS, []
    for figure, cuts in zip(style.T, _CUTS):
        bins.append(begin + np.searchsorted(cuts, figure, side="right"))
        begin += len(cuts) + 1
    every = np.arange(len(texts))
    row = np.concatenate([row] + [every] * len(bins))
    column = np.concatenate([column, *bins])
    order = np.argsort(row, kind="stable")
    return row[order], column[order].astype(np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit(counts: np.ndarray, column: np.ndarray, grades: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Weights and ordered thresholds by Adam on the likelihood of the cumulative-link model.

    ``counts`` has the number of features of every row, at least one. Without rows the
    model calls everything good.
    """
    n = len(grades)
    if not n:
        return Model(np.zeros(WIDTH, np.float32), np.array([-50.0, -50.0]))
    begins = np.cumsum(counts) - counts
    weights = np.zeros(WIDTH, np.float32)
    share = [np.mean(grades > k) for k in range(GRADES - 1)]
    first = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    gaps = np.array([first[0], np.log(max(first[1] - first[0], 1e-3))])
    moments = [np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), np.zeros(2), np.zeros(2)]
    for t in range(1, rounds + 1):
        theta = np.array([gaps[0], gaps[0] + np.exp(gaps[1])])
        score = np.add.reduceat(weights[column], begins).astype(float)
        above = _sigmoid(score[:, None] - theta)  # P(grade > k)
        upper = np.where(grades == 0, 1.0, above[np.arange(n), np.maximum(grades - 1, 0)])
        lower = np.where(grades == GRADES - 1, 0.0, above[np.arange(n), np.minimum(grades, GRADES - 2)])
        mass = np.maximum(upper - lower, 1e-12)
        slope = (upper * (1 - upper) - lower * (1 - lower)) / mass  # d log p / d score
        change = np.zeros(2)
        for k in range(2):
            change[k] = np.sum(np.where(grades == k, lower * (1 - lower), np.where(grades == k + 1, -upper * (1 - upper), 0)) / mass)
        steps = (
            np.bincount(column, weights=np.repeat(slope, counts), minlength=WIDTH) / n - RIDGE * weights,
            np.array([change.sum(), change[1] * np.exp(gaps[1])]) / n,
        )
        for which, (target, grad) in enumerate(zip((weights, gaps), steps)):
            m, v = moments[2 * which], moments[2 * which + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            target += STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(weights, np.array([gaps[0], gaps[0] + np.exp(gaps[1])]))


def grades_of(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade): 0 toxic, 1 poor, 2 good; rows with a null id or label have no grade."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where(f"{id_col} is not null and quality is not null and toxic is not null").select(
        F.col(id_col).alias("_id"), grade.cast("int").alias("grade")
    )


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          most_rows: int = LABELLED_ROWS) -> Model:
    """Fit on the ``most_rows`` graded rows (_id, grade) with the smallest hash of their id.

    At most ``most_rows`` rows of features reach the driver. Texts that are missing for a
    label are left out; a text that is null counts as empty.
    """
    chosen = smallest_hashes(graded, ["_id", "grade"], most_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    known = texts.join(F.broadcast(chosen), "_id")  # most_rows rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = byte_values(batch.column("text"))
            for a, b in chunks(values):
                row, column = features(values[a:b])
                ends = np.cumsum(np.bincount(row, minlength=b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(column))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(a, b - a), batch.column("grade").slice(a, b - a), lists],
                    names=["_id", "grade", "columns"],
                )

    schema = T.StructType([known.schema["_id"], *T.StructType.fromDDL("grade int, columns array<int>").fields])
    table = known.mapInArrow(run, schema).toArrow()
    columns = table.column("columns").combine_chunks()
    if not len(columns):
        return fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
    counts = np.diff(columns.offsets.to_numpy())
    return fit(counts, columns.flatten().to_numpy(), table.column("grade").to_numpy())


def rate(docs: DataFrame, model: Model, text_col: str = "text", keep_at: float = KEEP_AT,
         carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all of ``docs``) with ``expected_grade``, ``good_probability`` and ``keep``.

    good_probability is the tail P(grade > 1), keep whether it reaches ``keep_at``. Columns of
    those names in ``docs`` are replaced. Null and empty texts are rated by their style
    figures alone; every repeated row gets the same rating; an empty table stays empty.
    """
    fresh = ["expected_grade", "good_probability", "keep"]
    kept = [c for c in (carry or docs.columns) if c not in fresh]
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(c) for c in kept], F.col(text_col).alias("_rated_text"))
    schema = T.StructType(
        source.schema.fields[:-1] + T.StructType.fromDDL("expected_grade double, good_probability double, keep boolean").fields
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = held.value.weights, held.value.thresholds
        for batch in batches:
            values = byte_values(batch.column("_rated_text"))
            parts = [np.zeros(0)]
            for a, b in chunks(values):
                row, column = features(values[a:b])
                parts.append(np.bincount(row, weights=weights[column], minlength=b - a))
            above = _sigmoid(np.concatenate(parts)[:, None] - thresholds)
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= keep_at)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *fresh])

    return source.mapInArrow(run, schema)


def op3_quality(spark, folder: str) -> DataFrame:
    """Expected grade, probability of a good grade and the decision for every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = train(docs, grades_of(spark.read.parquet(f"{folder}/labels.parquet")))
    return rate(docs, model, carry=["doc_id"])
