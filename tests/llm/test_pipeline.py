"""Every registered query runs, SQL agrees where there is some, and the stages do what they say."""

from __future__ import annotations

import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from clientlens.llm import quality, registry
from tests.compare import compare, duck
from tests.llm.conftest import sentence


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(name, spark, folder):
    assert compare(spark, duck(folder), folder, registry.QUERIES[name], registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(name, spark, folder):
    assert registry.QUERIES[name](spark, folder).take(1)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_of_groups(texts):
    """Ids that are the smallest of their group, by brute force over (id, text)."""
    left, kept = {i: fingerprint(t) for i, t in texts.items()}, set()
    while left:
        first = min(left)
        kept.add(first)
        waiting = [left.pop(first)]
        while waiting:
            at = waiting.pop()
            near = [i for i, f in left.items() if (f ^ at).bit_count() <= 2]
            waiting += [left.pop(i) for i in near]
    return kept


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for _, function in pipeline.STAGES:
        tables.append(function(spark, tables[-1], folder).cache())
    for table in tables[1:-1]:
        assert table.columns == docs.columns
    held = [{r["doc_id"]: r["text"] for r in t.collect()} for t in tables]
    raw, good, once, cut, clean, mixed = held

    labels = {r["_id"]: r["grade"] for r in quality.grades_of(spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert sum(i in good for i, g in labels.items() if g == 2) >= 0.97 * sum(g == 2 for g in labels.values())
    assert not any(i in good for i, g in labels.items() if g == 0)

    assert set(once) == smallest_of_groups(good)

    assert set(cut) == set(once)
    seen = {}
    for i, text in cut.items():
        w = words(text)
        for j in range(len(w) - 34):
            if "\n" not in text or text == once[i]:
                assert seen.setdefault(tuple(w[j : j + 35]), i) == i
    before = {x for t in once.values() for x in zip(*[words(t)[k:] for k in range(35)])}
    assert before and all(once[i] == cut[i] or len(words(cut[i])) < len(words(once[i])) for i in cut)

    items = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", r["text"].lower()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {" ".join(w[i : i + 10]) for w in items for i in range(max(len(w) - 10, 0) + 1)}
    plain = lambda t: " " + " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())) + " "
    leaked = {i for i, t in cut.items() if any(f" {w} " in plain(t) for w in windows)}
    assert set(clean) == set(cut) - leaked and leaked

    rows = tables[-1].collect()
    assert set(mixed) <= set(clean) and all(r["copies"] >= 1 and r["taken"] == r["copies"] * r["size"] for r in rows)
    total = sum(len(words(t)) for t in clean.values())
    assert abs(sum(r["taken"] for r in rows) - total) < 0.05 * total


def test_run_gives_the_last_stage(spark, folder):
    assert pipeline.run(spark, folder).where("copies < 1").count() == 0


def test_unlike_rows_under_one_id_stay(spark, folder):
    rows = [(1, sentence(1, 60), "a"), (1, sentence(2, 60), "b"), (42, sentence(3, 60), "a"), (None, None, None),
            (None, sentence(4, 60), "b"), (None, sentence(5, 60), "b"), (7, sentence(6, 60), "a"), (7, sentence(6, 60), "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").select(
        "doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(None).cast("long").alias("n_chars"))
    kept = pipeline.simhash_near_dedup(spark, table, folder)
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(map(repr, table.select("doc_id", "text").distinct().collect()))
    mixed = pipeline.mixing_stage(spark, table, folder).collect()
    assert len({(r["doc_id"], r["text"]) for r in mixed}) == len(mixed)
    assert abs(sum(r["taken"] for r in mixed) - 420) <= 120  # 420 words, each source is off by one document at most


def test_stages_survive_odd_rows(spark, docs, folder):
    odd = docs.select("doc_id", "text", "lang", "source", F.lit(None).cast("long").alias("n_chars"))
    for name, function in pipeline.STAGES:
        odd = function(spark, odd, folder)
        if name == "SimHash near-dedup":
            ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in odd.collect())
            assert len(ids) == len(set(ids)) and (True, None) in ids and (False, 1) not in ids
    assert sum(r["taken"] for r in odd.collect()) > 0
    empty = docs.where("false").select("doc_id", "text", "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    for _, function in pipeline.STAGES:
        empty = function(spark, empty, folder)
    assert empty.count() == 0
