"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words joined by one space. The windows of all benchmark
items form the automaton; every document is scanned once, and matches are mapped back to
its words and to the code points of the original text.

The automaton is bounded: windows beyond ``BLOCK_WINDOWS`` go to further automata, each of
which scans the documents after the one before, so a benchmark of any size is searched
whole and no task holds more than one bounded automaton.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm.text import byte_values
from clientlens.session import stage

WINDOW_WORDS = 10
BLOCK_WINDOWS = 20_000

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TO_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_RAW_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_automata: dict[str, ahocorasick.Automaton] = {}


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """(window, words, items): the distinct windows of all items and the items that have them.

    An item of fewer words than ``width`` is one window; an item without words, or with a
    null text or id, has none.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _LETTERS, _LETTERS.lower())
    words = benchmark.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("w")
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("w"))
    return each.groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("words")).agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )


def _automaton(name: str, patterns: list[tuple[str, int]]) -> ahocorasick.Automaton:
    """Built once in each worker. Every byte is one character (latin-1), so match ends are byte offsets."""
    if name not in _automata:
        _automata.clear()
        built = ahocorasick.Automaton()
        for number, (window, words) in enumerate(patterns):
            built.add_word(f" {window} ".encode().decode("latin-1"), (number, words))
        built.make_automaton()
        _automata[name] = built
    return _automata[name]


def _offsets(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as [start, end) in code points of the original text."""
    spots = [m.span() for m in _RAW_WORD.finditer(text)]
    turns = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    length = lambda end: len(text[:end].decode("utf-8", "replace"))
    return [{"start": length(spots[a][0]), "end": length(spots[b - 1][1])} for a, b in zip(turns[::2], turns[1::2])]


def _scan(docs: DataFrame, name: str, rows: list, text_col: str, earlier: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(
        ([(r["window"], r["words"]) for r in rows], [r["items"] for r in rows])
    )
    carried = [c for c in docs.columns if c not in _FOUND]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in _FOUND] + T.StructType.fromDDL(_KINDS).fields)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, items = shared.value
        search = _automaton(name, patterns).iter if patterns else lambda _: ()
        for batch in batches:
            before = list(zip(*(batch.column(c).to_pylist() for c in ("hit_words", "items")))) if earlier else None
            n_words, hits, runs, found = [], [], [], []
            for i, text in enumerate(byte_values(batch.column(text_col))):
                words = text.translate(_TO_PLAIN).split()
                plain = b" " + b" ".join(words) + b" " if words else b""
                matches = list(search(plain.decode("latin-1"))) if words else []
                old, ids = before[i] if earlier else ((), ())
                if matches or old:
                    hit = np.zeros(len(words), dtype=bool)
                    hit[list(old)] = True
                    blanks = np.flatnonzero(np.frombuffer(plain, dtype=np.uint8) == 32)
                    ends = np.searchsorted(blanks, [e for e, _ in matches])
                    for end, (_, (_, width)) in zip(ends, matches):
                        hit[end - width : end] = True
                    ids = sorted({x for _, (number, _) in matches for x in items[number]}.union(ids))
                    hits.append(np.flatnonzero(hit).tolist())
                    runs.append(_offsets(text, hit))
                else:
                    hits.append([]), runs.append([])
                n_words.append(len(words))
                found.append(list(ids))
            fresh = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(runs, span_type),
                     pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + fresh, names=[*carried, *_FOUND])

    return docs.mapInArrow(run, schema)


_FOUND = ["n_words", "hit_words", "spans", "items"]
_KINDS = "n_words long, hit_words array<int>, spans array<struct<start:int,end:int>>, items array<string>"


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", width: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``hit_words`` (numbers of the words inside any
    occurrence of a window), ``spans`` (runs of hit words as code-point offsets [start, end)
    of the original text) and ``items`` (ids of the items found, as sorted strings).

    Columns of those names in ``docs`` are replaced, all others kept. Null and empty texts
    have no words and no hits. Repeated rows are scanned each. An empty benchmark hits
    nothing; an empty table stays empty.
    """
    held = stage(windows(benchmark, item_col, item_text_col, width), "windows")
    blocks = max(1, -(-held.count() // block_windows))
    numbered = held.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    out = docs.drop(*_FOUND)
    for block in range(blocks):
        rows = numbered.where(F.col("block") == block).orderBy("window").collect()  # about block_windows rows
        name = uuid.uuid4().hex  # workers keep the automaton built under it
        out = _scan(stage(out, "scanned") if block else out, name, rows, text_col, block > 0)
    return out


def op6_decontaminate(spark, folder: str) -> DataFrame:
    """Benchmark windows found in every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = mark(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, len(list_slice(w, i, i + 9)) AS k, array_to_string(list_slice(w, i, i + 9), ' ') AS window
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), widths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS window
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, widths WHERE len(w) >= k)
), found AS (
  SELECT d.r, d.i, d.k, m.item_id FROM doc_windows d JOIN item_windows m ON d.k = m.k AND d.window = m.window
), hits AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM found) GROUP BY r
), ids AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(x.n_items, 0) AS n_items,
       sha256(coalesce(x.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON d.r = h.r LEFT JOIN ids x ON d.r = x.r
"""
