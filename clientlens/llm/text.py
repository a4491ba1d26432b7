"""Words of whole texts, as byte strings or as arrays of 64-bit hashes.

A word is a run of bytes outside space and ``\\x09-\\x0D``. Those bytes never occur inside
a longer UTF-8 character, so texts are cut on their bytes without decoding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java pattern of one word, for counting in SQL expressions.
WORD = r"[^\x20\x09-\x0D]+"

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's content; equal rows share it, and get equal results."""
    return F.xxhash64(*[F.col(c) for c in columns])


def smallest_hashes(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """At most ``size`` rows, those with the smallest hash of ``columns``.

    Rows whose hash is surely too large are left out by a threshold first, ten deviations
    above the wanted number, so tasks together pass on little more than ``size`` rows. Copies
    share their hash, so where too few rows lie below it the threshold is widened.
    """
    rows, top = df.count(), 1 << 31
    wanted = size + 10 * math.sqrt(size)
    cut = top if rows <= wanted else math.ceil(wanted / rows * top)
    draw = F.pmod(F.xxhash64(*columns), F.lit(top))
    while cut < top and df.where(draw < cut).count() < size:
        cut = min(top, 4 * cut)
    return df.where(draw < cut).orderBy(draw, *columns).limit(size)


def byte_values(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``size`` bytes; a longer text stands alone."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > size:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    values = (values ^ (values >> np.uint64(30))) * _MIX1
    values = (values ^ (values >> np.uint64(27))) * _MIX2
    return values ^ (values >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < count; base is odd."""
    up, down = _powers.get(base, (None, None))
    if up is None or len(up) < count:
        def table(step: int) -> np.ndarray:
            steps = np.full(count, step, dtype=np.uint64)
            steps[:1] = 1
            return np.cumprod(steps, dtype=np.uint64)

        up, down = table(base), table(pow(base, -1, 1 << 64))
        if count <= 1 << 23:
            _powers[base] = (up, down)
    return up[:count], down[:count]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[start:end]`` for every range, independent of its place."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(texts: list[bytes], prefix: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text), for a chunk of texts.

    With ``prefix`` only the first so many bytes of each word are hashed.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    word = ~_BLANK[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if prefix:
        ends = np.minimum(ends, starts + prefix)
    codes = range_hashes(joined.astype(np.uint64) + np.uint64(1), starts, ends, int(_BASE))
    codes = mixed(codes + (ends - starts).astype(np.uint64) * _MIX2)
    borders = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, borders), prepend=0)
    return codes, counts
