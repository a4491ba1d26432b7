"""The corpus pipeline: the stages that turn raw documents into a training mix.

Every stage works on all rows the stage before it kept, and returns the columns of
``documents``; the last one adds how often the mix takes each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.llm import decontaminate, mixing, quality, simhash, substring_dedup
from clientlens.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and ``_key``: what tells rows apart is id and text together.

    Rows equal in both are one document; unlike texts under one id, and rows without an id,
    are not. Keys are ordered by id, missing ids last.
    """
    told = F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce("text", F.lit("")))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.md5(told).alias("text_md5"))
    return docs.select(*COLUMNS, key.alias("_key"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the ordinal classifier rejects go."""
    graded = quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.train(docs, graded)
    return quality.rate(docs, model, carry=COLUMNS).where("keep").select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Groups are those of the SimHash operator: three-word shingles, two differing bits at most.
    Documents without words are one group.
    """
    keyed = _keyed(docs)
    groups = simhash.near_duplicates(keyed, id_col="_key")
    first = groups.where(F.col("_key") == F.col("component_id")).select("_key").distinct()
    kept = keyed.join(stage(first, "first"), "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).select(*COLUMNS)  # partitioned by the key already


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur again stay in one place only."""
    found = substring_dedup.remove_repeats(docs, keep_first=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hit_words") == 0).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with ``size`` in words, ``copies`` and ``taken`` words.

    Rows equal in id and text become one row with the copies of all of them.
    """
    keyed = _keyed(docs)
    taken = mixing.mix(keyed, id_col="_key").where("copies > 0")
    plan = taken.groupBy("_key").agg(
        F.min("size").alias("size"), F.sum("copies").alias("copies"), F.sum("taken").alias("taken"))
    joined = keyed.join(plan, "_key").dropDuplicates(["_key"])
    return joined.select(*COLUMNS, "size", "copies", "taken")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL cannot express fitted models and seeded rounding; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each reading what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage(docs, "pipeline")
    return docs
