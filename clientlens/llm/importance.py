"""Importance resampling of documents towards a target text collection.

Features are the runs of one to three neighbouring words, counted in hashed buckets. A bucket's
gain is the log of its smoothed share in the target over its share in the documents; a
document weighs the sum of the gains of its features. Adding Gumbel noise to the weights and
taking the highest draws without replacement, in proportion to the weights.

Texts are worked on in batches: a batch is joined with separator sentinels, one pass of a
regular expression finds all its words, the documents' offsets are searched among the words,
and runs that would cross into the next document are masked before the buckets are counted.
The CRC of a run is combined from those of its words, so no run is ever built as a string.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm.text import byte_values, chunks
from clientlens.session import small_table, stage

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
#: Rows of one range of the draw; ranges are numbered in parallel.
RANGE_ROWS = 500_000

#: A word, or the sentinel after a text; the texts' own line ends become blanks before they are joined.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+|\n")
_SENTINEL = b"\n"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 10 else c for c in range(256))
_REVERSED_POLYNOMIAL = 0xEDB88320
#: Word lengths whose shift tables stand side by side; longer words are shifted one length at a time.
_SHORT = 64


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


@lru_cache(maxsize=4096)
def _shift_table(count: int) -> np.ndarray:
    """[4, 256]: by byte of a CRC, what it becomes when ``count`` zero bytes follow."""
    power, square = [1 << b for b in range(32)], [_REVERSED_POLYNOMIAL] + [1 << b for b in range(31)]
    for _ in range(3):  # eight bits a byte
        square = [_times(square, row) for row in square]
    while count:
        if count & 1:
            power = [_times(square, row) for row in power]
        square = [_times(square, row) for row in square]
        count >>= 1
    return np.array([[_times(power, byte << (8 * k)) for byte in range(256)] for k in range(4)], dtype=np.uint32)


@lru_cache(maxsize=1)
def _short_tables() -> np.ndarray:
    return np.stack([_shift_table(n) for n in range(_SHORT)])


def _followed(crc: np.ndarray, then: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of texts with CRC ``crc``, followed by texts of ``lengths`` bytes with CRC ``then``."""
    tables, short = _short_tables(), np.minimum(lengths, _SHORT - 1)
    out = then.copy()
    for k in range(4):
        out ^= tables[short, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    for n in np.unique(lengths[lengths >= _SHORT]):
        here, table = np.flatnonzero(lengths == n), _shift_table(int(n))
        out[here] = then[here]
        for k in range(4):
            out[here] ^= table[k, (crc[here] >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def features(texts: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number of each feature, its bucket, words of each document) of a batch of texts.

    Features come by length of the run, not in the order of the text.
    """
    joined = _SENTINEL.join([*(t.translate(_LOWER) for t in texts), b""])
    found = _WORD.findall(joined)
    single = np.fromiter(map(zlib.crc32, found), dtype=np.uint32, count=len(found))
    length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    sentinel = (length == 1) & (single == zlib.crc32(_SENTINEL))  # CRCs of single bytes differ
    ends_of_texts = np.flatnonzero(sentinel) - np.arange(len(texts))
    single, length = single[~sentinel], length[~sentinel] + 1  # with the blank before it
    owner = np.searchsorted(ends_of_texts, np.arange(len(single)), side="right")
    words = np.bincount(owner, minlength=len(texts))
    spaced = _followed(np.full(len(single), zlib.crc32(b" "), dtype=np.uint32), single, length - 1)
    owners, codes, run = [owner], [single], single
    for width in range(2, longest + 1):
        run = _followed(run[:-1], spaced[width - 1 :], length[width - 1 :])
        within = owner[: len(run)] == owner[width - 1 :]  # not over a sentinel
        owners.append(owner[: len(run)][within]), codes.append(run[within])
    return np.concatenate(owners), np.concatenate(codes) % np.uint32(buckets), words


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; tasks send on one row for each bucket they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            given = byte_values(batch.column(0))
            for a, b in chunks(given):
                counts += np.bincount(features(given[a:b], buckets)[1], minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["bucket", "n"])

    told = texts.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in told.collect():  # at most one row a bucket
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares), by bucket."""
    s_all, t_all = (float(x.sum()) + len(source) for x in (source, target))
    return np.array([
        math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source, target)
    ], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, carry: list[str], text_col: str = "text", longest: int = LONGEST_RUN) -> DataFrame:
    """``carry`` columns with n_words, n_features and weight (long) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket
    source = docs.select(*carry, F.col(text_col).alias("_weighed_text"))
    schema = T.StructType(source.schema.fields[:-1] + T.StructType.fromDDL("n_words long, n_features long, weight long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for batch in batches:
            given, out = byte_values(batch.column(len(carry))), [np.zeros((3, 0), dtype=np.int64)]
            for a, b in chunks(given):
                owner, bucket, words = features(given[a:b], len(by_bucket), longest)
                order = np.argsort(owner, kind="stable")
                totals = np.concatenate(([0], np.cumsum(by_bucket[bucket[order]])))
                edges = np.searchsorted(owner[order], np.arange(b - a + 1))
                out.append(np.stack([words, np.diff(edges), np.diff(totals[edges])]))
            columns = [pa.array(x) for x in np.concatenate(out, axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def noise(id_col: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u drawn from a hash of the seed and the id."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    head = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((head + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
             range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank numbers the drawn rows.

    Of the N rows with ``least_words`` words or more, floor(N * share[0] / share[1]) with the
    highest scores are drawn, ties to the smaller id, missing ids last; the other rows have a
    null rank. Null and empty texts have no features and weight zero; a null id draws its
    noise from the empty string. Repeated rows share a score and take ranks next to each
    other. An empty table gives an empty result, an empty target still ranks. Other columns
    of either table are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(bucket_counts(source, "text", buckets), bucket_counts(target, target_text_col, buckets))
    rows = weighed(source, gain, ["doc_id"]).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = stage(rows, "weighed")
    open_rows, order = rows.where(F.col("n_words") >= least_words), [F.desc("score"), F.asc_nulls_last("doc_id")]
    eligible = open_rows.count()
    draw = eligible * share[0] // share[1]
    ranges = open_rows.repartitionByRange(max(1, -(-eligible // range_rows)), *order).withColumn("range", F.spark_partition_id())
    dealt = stage(ranges, "ranges")  # written once, so a row stays in its range
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n")).orderBy("range").collect()  # one row a range
    before, first = 0, {"range": [], "before": []}
    for row in sizes:
        if before < draw:
            first["range"].append(row["range"]), first["before"].append(before)
        before += row["n"]
    columns = [F.col("doc_id").alias(id_col), "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    left = rows.where(F.col("n_words") < least_words).select(*columns, unranked)
    if not first["range"]:
        return left.unionByName(open_rows.select(*columns, unranked))
    last = first["range"][-1]
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    ranked = dealt.where(F.col("range") <= last).join(small_table(docs.sparkSession, first), "range").withColumn("place", place)
    drawn = ranked.select(*columns, F.when(F.col("place") <= draw, F.col("place")).cast("long").alias("rank"))
    return drawn.unionByName(dealt.where(F.col("range") > last).select(*columns, unranked)).unionByName(left)


def op12_importance(spark, folder: str) -> DataFrame:
    """A twentieth of the documents, drawn by their likeness to the benchmark texts."""
    docs, target = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target)
