"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / size of its source times, which is a
whole number of copies and a fraction. Fractions are rounded in pairs: words move from one
document to the other, in a random direction that keeps both expectations, until one of
the two is taken wholly or not at all; the other one goes on. A pair keeps its sum of
words, so a whole block of documents is off by its last fraction only. Blocks of bounded
size round on their own, and their last fractions meet in the next level of a reduction
tree, up to one document for each source.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm.text import WORD
from clientlens.operators.ranking import with_row_number
from clientlens.session import stage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BLOCK_ROWS = 4096
FAN_IN = 256
SEED = 8
_WHOLE = 1e-9


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size, ...) with ``target``: shares of all words by weight, none
    above ``most`` times its source, the excess shared again among the others.

    Weights repeat over the sources in code-point order, null last. Only sums reach the
    driver; a round caps every source above its share, until none is.
    """
    named = with_row_number(sizes.where("source is not null").select("source"), "source", "place")
    count = named.count()
    place = sizes.join(named, "source", "left").withColumn("place", F.coalesce("place", F.lit(count + 1)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    held = stage(place.withColumn("weight", weight).drop("place"), "weights")
    roof = F.col("source_size") * float(most)
    rate, capped = None, -1
    while True:
        free = F.lit(True) if rate is None else ~(F.col("weight") * rate >= roof)
        row = held.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(free, F.col("weight"))).alias("weight"),
            F.sum(F.when(~free, roof)).alias("held"), F.count_if(~free).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["weight"]:
            break
        capped = row["capped"]
        rate = ((row["all"] or 0) - (row["held"] or 0.0)) / row["weight"]
    share = F.least(F.col("weight") * (rate or 0.0), roof)
    return held.withColumn("target", share).drop("weight")


def _rounded(rate: np.ndarray, size: np.ndarray, seed: list[int]) -> np.ndarray:
    """0 or 1 for each fraction, but for one that may stay a fraction."""
    rng = np.random.default_rng(seed)
    rate, live = rate.copy(), np.argsort(size, kind="stable")
    while len(live) > 1:
        a, b = live[: len(live) // 2 * 2 : 2], live[1::2]
        gain = np.minimum((1 - rate[a]) * size[a], rate[b] * size[b])
        loss = np.minimum(rate[a] * size[a], (1 - rate[b]) * size[b])
        moved = np.where(rng.random(len(a)) * (gain + loss) < loss, gain, -loss)
        rate[a] += moved / size[a]
        rate[b] -= moved / size[b]
        near = np.round(rate)
        rate = np.where(np.abs(rate - near) < _WHOLE, near, rate)
        live = live[(rate[live] > 0) & (rate[live] < 1)]
    return rate


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row.

    size is the number of words, null texts have none; copies is how often the mix takes the
    row, taken its words. Rows without words take the whole copies of their source. Ids are of
    any type and may be null; rows are drawn in the order of a hash of the id. The draws
    depend on ids, sources and sizes only, so reruns agree; equal rows may exchange their
    draws. An empty table gives an empty result, other columns are not read.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    planned = stage(targets(stage(per_source, "sources"), weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    to = planned.withColumnRenamed("source", "_source")
    rows = sized.join(to, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("rate", rate)
    blocks = F.ceil(F.col("n") / block_rows)
    rows = rows.select(
        "doc_id", "source", "size", "source_size", "target", F.floor("rate").alias("copies"),
        F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(0.0).alias("part"),
        F.pmod(F.xxhash64("doc_id", "size"), blocks).alias("block"), F.xxhash64("doc_id").alias("turn"),
    )
    most_blocks = planned.agg(F.max(F.ceil(F.col("n") / block_rows))).first()[0] or 1
    schema: T.StructType = rows.schema

    def level(number: int):
        def run(table: pa.Table) -> pa.Table:
            table = table.take(np.lexsort([table.column(c).to_numpy() for c in ("size", "turn")]))
            part = table.column("part").to_numpy()
            words = table.column("size").to_numpy().astype(float)
            open_rows = np.flatnonzero((part > _WHOLE) & (part < 1 - _WHOLE))
            name = table.column("source")[0].as_py()
            done = np.round(part)
            key = zlib.crc32(str(name).encode()) + (name is None)
            done[open_rows] = _rounded(
                part[open_rows], words[open_rows], [seed, number, key, table.column("block")[0].as_py()]
            )
            whole = np.floor(done)
            copies = table.column("copies").to_numpy() + whole.astype(np.int64)
            out = table.set_column(table.schema.get_field_index("copies"), "copies", pa.array(copies))
            return out.set_column(table.schema.get_field_index("part"), "part", pa.array(done - whole))

        return run

    settled, number = [], 0
    while True:
        # one row a block, the last fraction, may go on to the next level
        rounded = stage(rows.groupBy("source", "block").applyInArrow(level(number), schema), "rounded")
        settled.append(rounded.where("part = 0"))
        rows = rounded.where("part > 0").withColumn("block", F.floor(F.col("block") / FAN_IN))
        number += 1
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // FAN_IN)
    last = rows.withColumn("copies", F.col("copies") + F.round("part").cast("long"))
    for done in settled:
        last = last.unionByName(done)
    return last.select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def op8_mixing(spark, folder: str) -> DataFrame:
    """How often, and so how many words of, every document enters the mix."""
    found = mix(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", "taken")
