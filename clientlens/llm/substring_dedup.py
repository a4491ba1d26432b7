"""Repeated passages by seed and extend.

Seeds are winnowed anchors: of every ``min_words`` consecutive words the smallest hash of
``seed_words`` neighbouring words is selected, so equal passages select the same seed at
the same place. Consecutive passages that select one seed form its stretch, the widest
context the seed has to be extended over. Documents are joined on seeds:

* a seed whose stretches are all equal extends over the whole stretch;
* where stretches of one seed differ, one stretch of each kind is extended word by word to
  both sides: the hash of every passage of ``min_words`` around the seed is compared.

What is joined, grouped or counted is one row a seed, or one row a passage for the few
stretches that differ; never pairs of documents. Stretches of a hot seed are summed before
any shuffle. Adjoining matches merge into the maximal
repeats of a document. Passages are compared by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm.text import byte_values, chunks, mixed, range_hashes, row_key, word_hashes
from clientlens.session import stage

MIN_WORDS = 35
SEED_WORDS = 8
#: A key with more than one row in this many is joined by broadcast; there are fewer such keys than that.
HOT_SHARE = 1024
_SEED_BASE, _BODY_BASE, _WIDE_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """For every place, where the smallest of the next ``width`` values is (the last, if tied)."""
    best, place, covered = values, np.arange(len(values)), 1
    while covered < width:
        step = min(covered, width - covered)
        later = best[step:] <= best[:-step]
        best = np.where(later, best[step:], best[:-step])
        place = np.where(later, place[step:], place[:-step])
        covered += step
    return place


def _stretches(codes: np.ndarray, counts: np.ndarray, min_words: int, seed_words: int):
    """(document, start, windows, seed, body) of every stretch in a chunk of texts."""
    if len(codes) < min_words:
        return None
    owner = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(codes) - seed_words + 1)
    seeds = mixed(range_hashes(codes, places, places + seed_words, _SEED_BASE))
    chosen = _lowest(seeds, min_words - seed_words + 1)
    at = np.flatnonzero(owner[: len(chosen)] == owner[min_words - 1 :])
    if not len(at):
        return None
    chosen = chosen[at]
    new = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (owner[at[1:]] != owner[at[:-1]])))
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(at)))
    start = at[first]
    body = range_hashes(codes, start, start + windows + min_words - 1, _BODY_BASE)
    body = mixed(body + (windows * min_words + chosen[first] - start).astype(np.uint64) * np.uint64(_WIDE_BASE))
    begins = np.concatenate(([0], np.cumsum(counts)))
    document = owner[start]
    return document, start - begins[document], windows, seeds[chosen[first]], body


def stretches(docs: DataFrame, min_words: int, seed_words: int) -> DataFrame:
    """(key, start, windows, seed, body) of every stretch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = byte_values(batch.column("text")), batch.column("key").to_numpy(zero_copy_only=False)
            for a, b in chunks(texts):
                found = _stretches(*word_hashes(texts[a:b]), min_words, seed_words)
                if found:
                    document, start, windows, seed, body = found
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[a:b][document]), pa.array(start.astype(np.int32)),
                         pa.array(windows.astype(np.int32)), pa.array(seed.view(np.int64)), pa.array(body.view(np.int64))],
                        names=["key", "start", "windows", "seed", "body"],
                    )

    return docs.select("key", "text").mapInArrow(run, "key long, start int, windows int, seed long, body long")


def _passages(docs: DataFrame, kinds: DataFrame, min_words: int) -> DataFrame:
    """(key, at, low, high, n): the passages of one stretch of each kind, hashed."""
    wanted = kinds.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "n")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = byte_values(batch.column("text")), batch.column("key").to_numpy(zero_copy_only=False)
            wishes = batch.column("wanted")
            for a, b in chunks(texts):
                codes, counts = word_hashes(texts[a:b])
                part = wishes.slice(a, b - a)
                flat = part.flatten()
                row = np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
                start, windows, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "windows", "n"))
                offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                at = np.repeat(start, windows) + offset
                row, n = np.repeat(row, windows), np.repeat(n, windows)
                place = at + (np.cumsum(counts) - counts)[row]
                low = mixed(range_hashes(codes, place, place + min_words, _BODY_BASE))
                high = mixed(range_hashes(codes, place, place + min_words, _WIDE_BASE))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b][row]), pa.array(at.astype(np.int32)), pa.array(low.view(np.int64)),
                     pa.array(high.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["key", "at", "low", "high", "n"],
                )

    return docs.select("key", "text").join(wanted, "key").mapInArrow(run, "key long, at int, low long, high long, n long")


def _by_weight(found: DataFrame, told: DataFrame, keys: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """``found`` joined with ``told`` (one row a key, ``n`` of them in ``found``), in two parts: the
    hot keys, whose rows stay where they lie, and all others, which are shuffled by key.

    The hot keys are fewer than ``HOT_SHARE``, since their rows add up to ``total`` at most."""
    hot = told.where(F.col("n") * HOT_SHARE > total)
    others = found.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return found.join(F.broadcast(hot.drop("n")), keys), others.join(told.where(F.col("n") * HOT_SHARE <= total).drop("n"), keys)


def _repeats(docs: DataFrame, min_words: int, seed_words: int, keep_first: bool) -> DataFrame:
    """(key, start, windows): runs of repeated passages, not yet merged."""
    found = stage(stretches(docs, min_words, seed_words), "stretches")
    seeds = found.groupBy("seed").agg(
        F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high"),
        *([F.min(F.struct("key", "start")).alias("first")] if keep_first else []),
    ).where("n > 1")
    seeds = stage(seeds, "seeds")
    total = found.count()
    hot, others = (
        part.groupBy("seed", "body").agg(F.count("*").alias("n"), F.min(F.struct("key", "start", "windows")).alias("first"))
        for part in _by_weight(found, seeds.where("low <> high").select("seed", "n"), ["seed"], total)
    )
    kinds = stage(hot.unionByName(others), "kinds")
    # stretches that occur as a whole again, of seeds with one kind of stretch and with several
    first = [F.struct("first.key", "first.start").alias("first")] if keep_first else []
    repeated = seeds.where("low = high").select("seed", F.col("low").alias("body"), "n", *first).unionByName(
        kinds.where("n > 1").select("seed", "body", "n", *first)
    )
    hot, others = _by_weight(found, stage(repeated, "repeated"), ["seed", "body"], total)
    whole = hot.unionByName(others)
    if keep_first:
        whole = whole.where(F.struct("key", "start") != F.col("first"))
    whole = whole.select("key", "start", "windows")

    passages = stage(_passages(docs, kinds.select("first.*", "n"), min_words), "passages")
    place = F.struct("key", "at")
    shared = passages.groupBy("low", "high").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.max("n").alias("n")
    ).where("first <> last or n > 1").select("low", "high", "first")
    singles = passages if keep_first else passages.where("n = 1")
    extended = singles.join(stage(shared, "shared"), ["low", "high"])
    if keep_first:
        extended = extended.where(place != F.col("first"))
    extended = extended.select("key", F.col("at").alias("start"), F.lit(1).alias("windows"))
    return whole.unionByName(extended)


def _cut(texts: list[bytes], runs: list, min_words: int):
    """(words, removed words, maximal repeats, kept text) of every text."""
    for text, own in zip(texts, runs):
        words = text.split()
        if not own:
            yield len(words), 0, [], b" ".join(words)
            continue
        edges = np.zeros(len(words) + 1, dtype=np.int64)
        begin = np.array([r["start"] for r in own])
        end = np.minimum(begin + np.array([r["windows"] for r in own]) + min_words - 1, len(words))
        np.add.at(edges, begin, 1)
        np.add.at(edges, end, -1)
        hit = np.cumsum(edges)[:-1] > 0
        turns = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        spans = [{"start": int(s), "words": int(e - s)} for s, e in zip(turns[::2], turns[1::2])]
        kept = b" ".join([w for w, h in zip(words, hit.tolist()) if not h])
        yield len(words), int(hit.sum()), spans, kept


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS,
                   seed_words: int = SEED_WORDS, keep_first: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_removed``, ``repeats`` (start and number of
    words of every maximal repeat that is removed) and ``kept`` (the other words, joined by
    one space). Columns of those names in ``docs`` are replaced.

    A word goes if a passage of ``min_words`` words around it also starts anywhere else, in
    the same document or another. Occurrences are judged on the input. With ``keep_first``
    one occurrence of every passage (the first in the order of row keys) stays; repeated
    rows (equal id and text) count as one place then. Null, blank and short texts lose
    nothing; an empty table stays empty.
    """
    fresh = ("n_words", "n_removed", "repeats", "kept")
    source = docs.drop(*fresh)
    carried = source.columns
    key, runs = "_repeat_key", "_repeat_runs"
    keyed = source.withColumn(key, row_key(id_col, text_col))
    plain = keyed.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    found = _repeats(plain, min_words, seed_words, keep_first)
    per_row = found.groupBy(F.col("key").alias(key)).agg(F.collect_list(F.struct("start", "windows")).alias(runs))
    joined = keyed.join(stage(per_row, "runs"), key, "left").drop(key)
    kinds = "n_words long, n_removed long, repeats array<struct<start:int,words:int>>, kept string"
    schema = T.StructType(source.schema.fields + T.StructType.fromDDL(kinds).fields)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = byte_values(batch.column(text_col)), batch.column(runs)
            for a, b in chunks(texts, 1 << 24):
                done = _cut(texts[a:b], own.slice(a, b - a).to_pylist(), min_words)
                n, gone, spans, kept = zip(*done)
                columns = [batch.column(c).slice(a, b - a) for c in carried]
                columns += [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span_type),
                            pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, *fresh])

    return joined.mapInArrow(run, schema)


def op2_substring_dedup(spark, folder: str) -> DataFrame:
    """Words of every document that repeated passages of 35 words take away."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\x0c\r]+') AS w
  FROM documents
), places AS (
  SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
), windows AS (
  SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM places WHERE i + 34 <= len(w)
), repeated AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), starts AS (
  SELECT r, i FROM windows SEMI JOIN repeated USING (h)
), marked AS (
  SELECT p.r, p.i, w[p.i] AS word,
         max(s.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS UNBOUNDED PRECEDING) AS last_start
  FROM places p LEFT JOIN starts s ON p.r = s.r AND p.i = s.i
), kept AS (
  SELECT r, count(*) FILTER (last_start IS NOT NULL AND i - last_start < 35) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (last_start IS NULL OR i - last_start >= 35) AS kept
  FROM marked GROUP BY r
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.r = k.r
"""
