"""Word counts over whole corpora, and the most frequent words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientlens.llm.text import byte_values

#: Distinct words a task holds before it passes their counts on.
HELD_WORDS = 200_000


def word_counts(texts: DataFrame, words_of: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(word, n) over the column ``text``; tasks count before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in byte_values(batch.column("text")):
                counts.update(words_of(text))
                if len(counts) > HELD_WORDS:
                    yield told()
        yield told()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, size: int) -> list[tuple[str, int]]:
    """At most ``size`` words with their counts, ties in the order of the words.

    ``counts`` is a written table. A histogram of the counts on a logarithmic scale tells
    how frequent a word must be to have a chance, so tasks pass on little more than that.
    """
    scale = F.floor(F.log2("n") * 8)
    bins = counts.groupBy(scale.alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("low")).orderBy(
        F.desc("bin")).collect()  # at most eight a power of two
    found, low = 0, 0
    for row in bins:
        if found < size:
            found, low = found + row["words"], row["low"]
    chosen = counts.where(F.col("n") >= low).orderBy(F.desc("n"), "word").limit(size)
    return [(r["word"], r["n"]) for r in chosen.collect()]
