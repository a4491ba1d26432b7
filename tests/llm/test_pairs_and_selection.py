"""Jaccard join, importance resampling and hard negatives, against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import hard_negatives, importance, jaccard_join
from tests.llm.conftest import DOCS, sentence


def five_word_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def components(texts):
    """(set size, smallest id) of every (id, text), by comparing all pairs."""
    sets = [five_word_set(t) for _, t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(top(i), []).append(texts[i][0])
    lowest = lambda ids: min((x for x in ids if x is not None), default=None)
    return [(texts[i][0], len(sets[i]), lowest(groups[top(i)])) for i in range(len(texts))]


def rows_of(table, *columns):
    return sorted(map(repr, (tuple(r) for r in table.select(*columns).collect())))


def family(number, size, words, changed, rng):
    """``size`` texts of ``words`` words with ``changed`` words of their own each."""
    out = []
    for k in range(size):
        w = sentence(number, words).split()
        for at in rng.choice(words, changed, replace=False):
            w[at] = f"own{number}x{k}x{at}"
        out.append(" ".join(w))
    return out


def test_jaccard_join_equals_all_pairs(spark, docs, no_docs):
    found = jaccard_join.join_similar(docs)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(map(repr, components([d[:2] for d in DOCS])))
    assert jaccard_join.join_similar(no_docs).count() == 0
    other = jaccard_join.join_similar(docs.select(F.col("doc_id").alias("key"), F.col("text").alias("body")), "key", "body")
    assert other.columns == ["key", "n_shingles", "component_id"] and other.count() == len(DOCS)


@pytest.mark.parametrize("tile", [4096, 6])
def test_families_around_the_threshold(spark, monkeypatch, tile):
    """Families whose members link, do not, or link in chains only; a hot passage; short texts."""
    monkeypatch.setattr(jaccard_join, "TILE_NODES", tile)
    rng = np.random.default_rng(5)
    texts = [t for number, (size, words, changed) in enumerate(
        [(30, 120, 1), (25, 120, 3), (25, 200, 4), (20, 60, 1), (20, 300, 6), (12, 9, 1), (12, 6, 1)], 100) for t in family(number, size, words, changed, rng)]
    chain = sentence(300, 200).split()
    texts += [" ".join(chain[4 * k : 4 * k + 100]) for k in range(20)]
    texts += [f"{sentence(310, 40)} {sentence(320 + k, 70)}" for k in range(30)]
    texts += ["a b c d e f", "a b c d e f g", "A  b\tc d e f", "x", "x", "y", "a b", "b a"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    found = jaccard_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(map(repr, components(rows)))


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(2)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    for size in [*range(1, 40), 80, 200, 500]:
        base = draw(size)
        sets = [base] + [np.unique(np.concatenate([rng.permutation(base)[: len(base) - out], draw(more)]))
                         for out in range(len(base) // 5 + 1) for more in (0, 1, len(base) // 9) if len(base) > out]
        sizes = np.array([len(s) for s in sets])
        names, owner = jaccard_join.signatures(np.concatenate(sets), sizes, (80, 100))
        held = [set(names[owner == i].tolist()) for i in range(len(sets))]
        for i, a in enumerate(sets):
            for j in range(i):
                common = len(np.intersect1d(a, sets[j]))
                if 100 * common >= 80 * (len(a) + len(sets[j]) - common) and not np.array_equal(a, sets[j]):
                    assert held[i] & held[j]


def test_nodes_without_enough_shared_shingles_have_no_link(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = jaccard_join._described(docs, 5, 0).where("n_shingles > 0")
    nodes = rows.groupBy("node").agg(F.min("n_shingles").alias("n"), F.min("text_key").alias("text_key"))
    left = jaccard_join.sharers(docs, nodes, 400_000, 5, (80, 100), 0).select("node")
    out = {r["doc_id"] for r in rows.join(left, "node", "left_anti").collect()}
    assert len(out) > 0.3 * rows.count()
    groups = jaccard_join.join_similar(docs)
    sets = {r["doc_id"]: five_word_set(r["text"]) for r in docs.collect() if r["doc_id"] in out}
    for a in sorted(sets)[:60]:
        assert all(sets[a] == s or 100 * len(sets[a] & s) < 80 * len(sets[a] | s) for s in sets.values())
    assert groups.where(~F.col("doc_id").isin(list(out))).count() == docs.count() - len(out)


def test_occurrence_search_skips_long_lists():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(60, rng.integers(3, 40))) for _ in range(80)]
    sets.append(np.arange(50))
    owner = np.repeat(np.arange(81), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    starts = np.searchsorted(token[order], np.arange(60))
    lists = (starts, owner[order], token[order] * 81 + owner[order])
    before = np.array([sum(t in s for s in sets[:80]) for t in range(50)])
    for need in (1, 5, 15, 25):
        found, times = jaccard_join.occurring(lists, np.arange(50), before, need, 81)
        want = {i: len(set(s) & set(range(50))) for i, s in enumerate(sets[:80])}
        assert dict(zip(found.tolist(), times.tolist())) == {i: n for i, n in want.items() if n >= need}


def plain_features(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(texts, bench):
    told = [(i, *plain_features(t)) for i, t in texts]
    s = Counter(b for _, _, bs in told for b in bs)
    t = Counter(b for x in bench for b in plain_features(x)[1])
    total = lambda c: sum(c.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total(s) / ((s[b] + 1) * total(t))))
    out = []
    for i, n, bs in told:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, bs))
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in out]


def test_features_of_joined_texts():
    texts = ["a b c d", "", " \n", "Foo " + "y" * 100 + " bar " + "z" * 70 + " É ñ 12", "one\ntwo", "A-b_c,d\n e\n\x00f", None]
    owner, bucket, words = importance.features([(t or "").encode() for t in texts])
    for i, text in enumerate(texts):
        n, buckets = plain_features(text)
        assert words[i] == n and Counter(bucket[owner == i].tolist()) == Counter(buckets)


@pytest.mark.parametrize("range_rows", [500_000, 7])
def test_resampling_equals_the_plain_way(spark, docs, no_docs, range_rows):
    texts = [(i, t) for i, t, _ in DOCS] + [(100 + i, sentence(i, 15 + i % 30)) for i in range(180)]
    bench = [sentence(3, 30), sentence(11, 25), None, ""]
    table = spark.createDataFrame(texts, "doc_id long, text string").withColumn("rank", F.lit("x")).repartition(5)
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    found = importance.resample(table, target, range_rows=range_rows)
    assert rows_of(found, "doc_id", "n_features", "weight", "score", "rank") == sorted(map(repr, plain_resample(texts, bench)))
    assert importance.resample(no_docs, target).count() == 0
    assert importance.resample(docs, target.where("false")).where("weight is null").count() == 0
    many = importance.resample(docs, target, share=(1, 1), least_words=0)
    assert sorted(r["rank"] for r in many.collect()) == list(range(1, len(DOCS) + 1))


def test_resampling_of_the_tables(spark, folder):
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    texts = [tuple(r) for r in read("documents").select("doc_id", "text").collect()]
    want = plain_resample(texts, [r["text"] for r in read("benchmark").collect()])
    assert rows_of(importance.op12_importance(spark, folder), "doc_id", "n_features", "weight", "score", "rank") == sorted(map(repr, want))


def plain_negatives(rows):
    """rows: (id, label, vector) that take part."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = []
    for i, label, q in sorted(whole):
        if i % 100:
            continue
        scored = sorted(((-dot(q, r), j, k) for j, k, r in whole if j != i))
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("pass_bytes", [32 << 20, 900])
def test_negatives_equal_the_plain_way(spark, pass_bytes):
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(3)), [float(x) for x in rng.normal(size=6)]) for i in range(0, 900, 3)]
    rows += [(1200, 1, [0.0] * 6), (1300, 2, [1e7, -3.0, 2.0, 0.0, 0.0, 1.0])] + [(2001 + k, 1, rows[0][2]) for k in range(30)]
    odd = [(5, None, [1.0] * 6), (7, 1, None), (8, 1, [1.0, None] + [0.0] * 4), (10, 2, [float("nan")] * 6), (11, 1, [1.0] * 5), (13, 0, []), (None, 1, [1.0] * 6)]
    table = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit(1)).repartition(4)
    found = hard_negatives.mine(table, F.col("label"), F.col("vec_id") % 100 == 0, pass_bytes=pass_bytes)
    assert rows_of(found, *COLUMNS) == sorted(map(repr, plain_negatives(rows)))
    assert hard_negatives.mine(table.where("false"), F.col("label"), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(table.where("label = 1"), F.col("label"), F.col("vec_id") % 100 == 0).count() == 0


def test_large_numbers_stay_exact():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**30, 1.0], [2.0**20, 1.0]])
    assert hard_negatives._products(a, b).tolist() == [[(1 << 63) - 1, (1 << 60) + 3]]


def test_walks_stop_early(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 4
    points = centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 16)) * 0.1
    table = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(points)], "vec_id long, label long, q array<double>").toArrow()
    told = hard_negatives._anchors_of(table.slice(0, 200), hard_negatives._directions(points)[0])
    best = hard_negatives._Best(told.low, 5)
    taken = hard_negatives._walk(told, best, np.arange(4000), np.ones(4000, np.int64), np.floor(points * 256))
    assert taken < 0.5 * 200 * 4000
