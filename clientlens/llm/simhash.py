"""Near-duplicate documents by SimHash fingerprints, compared exactly tile by tile.

Copies of a fingerprint collapse to one node before any comparison. Two fingerprints at
``radius`` differing bits or fewer agree in ``BLOCKS - radius`` of their blocks of bits at
least, so nodes meet only where such a choice of blocks agrees (the grid). Within a cell of
the grid the nodes are cut into tiles by population count and, where many share one, by a
hash; tile pairs whose population counts differ by more than the radius are skipped, the
others are compared in full with exclusive or and bit counts. A task sees two tiles of
bounded size and returns a spanning forest of the links it finds, so no group of near
copies is expanded into pairs, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.llm.components import smallest_reachable
from clientlens.llm.text import byte_values, chunks
from clientlens.session import stage

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BLOCKS = 4
TILE_ROWS = 256


def _fingerprints_of(texts: list[bytes], shingle_words: int, seed: int) -> np.ndarray:
    """Majority bits of the XXH64 of all shingles, repeats included; no words give zero."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()  # bytes: A-Z only, and the ASCII blanks only
        if not words:
            continue
        before = len(hashes)
        last = len(words) - shingle_words
        if last <= 0:
            hashes.append(digest(b" ".join(words), seed))
        elif shingle_words == 3:
            hashes += [digest(b"%b %b %b" % t, seed) for t in zip(words, words[1:], words[2:])]
        else:
            hashes += [digest(b" ".join(words[j : j + shingle_words]), seed) for j in range(last + 1)]
        counts[i] = len(hashes) - before
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    values = np.array(hashes, dtype="<u8")
    begins = np.concatenate(([0], np.cumsum(counts[full])))
    for number, row in enumerate(full):
        part = values[begins[number] : begins[number + 1]]
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(part), 1 << 16):
            piece = part[at : at + (1 << 16)]
            bits = np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int32)
        out[row] = np.packbits(ones * 2 > len(part), bitorder="little").view("<u8")[0]
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle_words: int = SHINGLE_WORDS, seed: int = SEED,
                     keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (long, the 64 bits) of every row.

    Null and blank texts have fingerprint zero.
    """
    source = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    schema = source.drop("_text").withColumn("fingerprint", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch.column("_text"))
            prints = [_fingerprints_of(texts[a:b], shingle_words, seed) for a, b in chunks(texts)]
            bits = np.concatenate(prints or [np.zeros(0, dtype=np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(bits)], names=[*keep, "fingerprint"]
            )

    return source.mapInArrow(run, schema)


def _units(nodes: DataFrame, radius: int, tile_rows: int, blocks: int, agree: int) -> DataFrame:
    """(unit, fingerprint): every node once for each pair of tiles it belongs to."""
    width = 64 // blocks
    masks = []
    for chosen in combinations(range(blocks), agree):
        value = sum(((1 << width) - 1) << (width * b) for b in chosen)
        masks.append(value - (1 << 64) if value >> 63 else value)
    fp = F.col("fingerprint")
    cells = F.array(*[F.struct(F.lit(i).alias("grid"), fp.bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks)])
    placed = nodes.select("fingerprint", F.bit_count(fp).alias("ones"), F.inline(cells))
    per_count = placed.groupBy("grid", "cell", "ones").agg(F.count("*").alias("n"))
    # at most 65 population counts a cell, so this map is of fixed size
    cell_sizes = per_count.groupBy("grid", "cell").agg(
        F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile_rows).cast("int")))).alias("tiles"),
        F.sum("n").alias("total"),
    ).where("total > 1")
    held = stage(cell_sizes, "cells")
    both = placed.join(held, ["grid", "cell"])
    own = F.pmod(F.xxhash64("fingerprint"), F.col("tiles")[F.col("ones")]).cast("int")
    # whole small cells are one unit; else one unit for each pair of tiles within the radius
    pairs = F.flatten(F.transform(
        F.filter(F.map_entries("tiles"), lambda e: F.abs(e["key"] - F.col("ones")) <= radius),
        lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda j: F.when(
            (e["key"] < F.col("ones")) | ((e["key"] == F.col("ones")) & (j < F.col("own"))),
            F.array(e["key"].cast("int"), j, F.col("ones").cast("int"), F.col("own")),
        ).otherwise(F.array(F.col("ones").cast("int"), F.col("own"), e["key"].cast("int"), j))),
    ))
    unit = F.when(F.col("total") <= 2 * tile_rows, F.array(F.array(F.lit(-1)))).otherwise(pairs)
    spread = both.withColumn("own", own).select("fingerprint", "grid", "cell", F.explode(unit).alias("pair"))
    return spread.select("fingerprint", F.xxhash64("grid", "cell", "pair").alias("unit"))


def _forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, smaller) that join what is linked among a few hundred fingerprints."""
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    roots = np.arange(len(prints))
    while True:
        low = np.where(close, roots[None, :], len(prints)).min(axis=1)
        if (low == roots).all():
            break
        roots = low
    moved = np.flatnonzero(roots != np.arange(len(prints)))
    return prints[moved], prints[roots[moved]]


def links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS, blocks: int = BLOCKS,
          agree: int = BLOCKS - RADIUS) -> DataFrame:
    """(u, v): links that join all distinct fingerprints within ``radius`` bits, if ``agree``
    is ``blocks - radius`` at most."""
    units = _units(nodes, radius, tile_rows, blocks, agree)
    ordered = units.repartition("unit").sortWithinPartitions("unit", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_unit, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def compared(unit: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            begins = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            sizes = np.diff(np.append(begins, len(unit)))
            # many small units at once: each row against the row `step` further on
            small = np.repeat(sizes <= 16, sizes)
            for step in range(1, 16):
                a = np.flatnonzero((unit[:-step] == unit[step:]) & small[:-step]) if len(unit) > step else []
                if not len(a):
                    break
                a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= radius]
                us.append(fp[a + step]), vs.append(fp[a])
            for at, size in zip(begins[sizes > 16], sizes[sizes > 16]):
                for found, into in zip(_forest(fp[at : at + size], radius), (us, vs)):
                    into.append(found)
            columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)]
            return pa.RecordBatch.from_arrays(columns, names=["u", "v"])

        for batch in batches:
            unit = np.concatenate([rest_unit, batch.column("unit").to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest_fp, batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            rest_unit, rest_fp = unit[cut:], fp[cut:]
            if cut:
                yield compared(unit[:cut], fp[:cut])
        if len(rest_unit):
            yield compared(rest_unit, rest_fp)

    return ordered.mapInArrow(run, "u long, v long").where("u != v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    component_id is the smallest id reachable over links of at most ``radius`` differing
    bits. Null or blank texts have fingerprint zero and are linked by it like any other.
    Repeated rows keep their number. Rows with a null id take part; a component of only
    such rows has a null component_id. An empty table gives an empty result. Other columns
    of the input are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = stage(with_fingerprint(source, "text", shingle_words, seed), "fingerprints")
    nodes = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = links(nodes, radius, TILE_ROWS, max(BLOCKS, radius + 1), max(BLOCKS - radius, 1))
    return _named(prints, nodes, smallest_reachable(found), id_col)


def _named(prints: DataFrame, nodes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    named = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = named.withColumn("root", F.coalesce("root", "fingerprint"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    placed = stage(named.join(lowest, "root").select("fingerprint", "component_id"), "components")
    return prints.join(placed, "fingerprint").select(F.col("doc_id").alias(id_col), "fingerprint", "component_id")


def op10_simhash(spark, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
