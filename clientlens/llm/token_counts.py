"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens; the distinct new pre-tokens of a chunk lie end to end in one
array of symbols. In every step each sequence finds its lowest-rank pair and merges all its
occurrences at once, from left to right; sequences without a known pair leave the array with
the number of symbols they have left. A merged symbol only occurs in pairs of a higher
rank, so merging all occurrences together gives what merging one after the other gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 1024
#: Pre-tokens a worker remembers before it starts anew.
REMEMBERED = 300_000
CHUNK_CHARS = 1 << 20

_BLANK = r"\t-\r\x20\x85\xa0  -     　"
_PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself
    if printable in Latin-1, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merger:
    """The merges of one byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        vocabulary = told["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.first = np.array([vocabulary[c] for c in _byte_letters()], dtype=np.int64)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.into = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.never = len(pairs)
        special = sorted((t["content"] for t in told.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols each piece has left when nothing can be merged any more."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        out = np.zeros(len(pieces), dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        names = np.flatnonzero(sizes)
        sizes = sizes[names]
        while len(names):
            begins = np.cumsum(sizes) - sizes
            keys = np.empty(len(symbols), dtype=np.int64)
            keys[:-1] = symbols[:-1] << 32 | symbols[1:]
            keys[begins + sizes - 1] = -1  # the last symbol has no pair
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where(self.keys[place] == keys, self.ranks[place], self.never)
            lowest = np.minimum.reduceat(rank, begins)
            over = lowest == self.never
            out[names[over]] = sizes[over]
            chosen = (rank == np.repeat(lowest, sizes)) & (rank < self.never)
            # of pairs that overlap, every other one from the left
            at = np.flatnonzero(chosen)
            run_start = np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.zeros(0, bool)
            number = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[number % 2 == 0]
            symbols[at] = self.into[rank[at]]
            stay = np.repeat(~over, sizes)
            stay[at + 1] = False
            left = np.add.reduceat(stay.astype(np.int64), begins)
            symbols, names, sizes = symbols[stay], names[~over], left[~over]
        return out

    def texts(self, texts: list[str]) -> list[int]:
        """Number of tokens of every text; a special string is one token."""
        lists, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            lists.append([p for part in parts for p in _PIECES.findall(part)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*lists) - self.known.keys())
        self.known.update(zip(new, self.counts([p.encode() for p in new]).tolist()))
        get = self.known.__getitem__
        return [sum(map(get, pieces)) + more for pieces, more in zip(lists, extra)]


@lru_cache(maxsize=2)
def _merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """``carry`` columns (all of ``docs``) with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``path`` names a byte-level BPE file that every executor can read. Null and empty texts
    have no tokens. Columns of the new names in ``docs`` are replaced; repeated rows are
    counted each; an empty table stays empty.
    """
    fresh = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in (carry or docs.columns) if c not in fresh]
    source = docs.select(*[F.col(c) for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias("_counted_text"))
    schema = T.StructType(source.schema.fields[:-1] + T.StructType.fromDDL("n_bytes long, n_tokens long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(path)
        for batch in batches:
            texts = batch.column("_counted_text").to_pylist()
            sizes, counts, start = [len(t.encode()) for t in texts], [], 0
            while start < len(texts):
                stop, total = start, 0
                while stop < len(texts) and (stop == start or total + sizes[stop] <= CHUNK_CHARS):
                    total += sizes[stop]
                    stop += 1
                counts += merger.texts(texts[start:stop])
                start = stop
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=[*kept, "n_bytes", "n_tokens"],
            )

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"])
