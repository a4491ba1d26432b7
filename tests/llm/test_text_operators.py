"""Operators on documents beside brute-force versions, over nulls, blanks, copies and ties."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clientlens.llm import brown_lm, decontaminate, mixing, simhash, substring_dedup, token_counts
from tests.llm.conftest import DOCS, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_repeats_match_brute_force(docs):
    places = collections.Counter()
    lists = [words(t) for _, t, _ in DOCS]
    for w in lists:
        places.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    expected = []
    for (doc, _, _), w in zip(DOCS, lists):
        gone = set()
        for i in range(len(w) - 34):
            if places[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = substring_dedup.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256))
    assert rows(found, "doc_id", "n_words", "n_removed", "sha") == sorted(expected, key=repr)
    assert {"key", "size", "window", "keep"} <= set(found.columns)


def test_one_occurrence_stays(docs):
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = substring_dedup.remove_repeats(once, keep_first=True).collect()
    left = collections.Counter()
    for r in found:
        w = words(r["kept"])
        left.update({tuple(w[i : i + 35]) for i in range(len(w) - 34)})
    assert left and max(left.values()) == 1
    before = {tuple(words(t)[i : i + 35]) for _, t, _ in DOCS for i in range(len(words(t)) - 34)}
    passage = tuple(words(sentence(3, 50))[:35])
    assert passage in before and left[passage] == 1


def test_spans_are_maximal(docs):
    spans = {r["doc_id"]: r["repeats"] for r in substring_dedup.remove_repeats(docs).where("doc_id in (8, 9, 10)").collect()}
    assert [(s["start"], s["words"]) for s in spans[8]] == [(40, 50)]
    assert [(s["start"], s["words"]) for s in spans[9]] == [(30, 50)]
    assert [(s["start"], s["words"]) for s in spans[10]] == [(0, 72)]


def fingerprint(text: str | None, k: int) -> int:
    w = words(lower(text))
    shingles = [" ".join(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)] if w else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


@pytest.mark.parametrize("radius", [0, 2, 5])
def test_fingerprints_and_components(docs, radius):
    prints = [fingerprint(t, 3) for _, t, _ in DOCS]
    group = list(range(len(DOCS)))
    for a in range(len(DOCS)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    lowest = {}
    for (doc, _, _), g in zip(DOCS, group):
        if doc is not None:
            lowest[g] = min(lowest.get(g, doc), doc)
    expected = [(doc, p - (1 << 64) if p >> 63 else p, lowest.get(g)) for (doc, _, _), p, g in zip(DOCS, prints, group)]
    found = simhash.near_duplicates(docs, radius=radius)
    assert rows(found, "doc_id", "fingerprint", "component_id") == sorted(expected, key=repr)


def test_tiles_lose_no_link(spark):
    """Crowded cells are cut into tiles; links are those of one big comparison."""
    base = 0x0123456789ABCDEF
    values = sorted({base ^ (1 << a) ^ (1 << b) ^ (c << 13) for a in range(0, 48, 3) for b in range(1, 40, 5) for c in range(4)})
    nodes = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    group = {v: v for v in values}

    def top(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    found = {r["node"]: r["root"] for r in simhash.smallest_reachable(simhash.links(nodes, 2, tile_rows=8)).collect()}
    assert {v: found.get(v, v) for v in values} == {v: top(v) for v in values}


ITEMS = [(1, sentence(3, 14).upper()), (2, "One, two;THREE"), (3, None), (4, "?!"), (5, sentence(3, 14)), (None, sentence(1, 12)), (6, "é" * 40)]


def test_windows_match_brute_force(spark, docs):
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for item, text in ITEMS:
        w = plain(text)
        for i in range(max(len(w) - 10, 0) + 1 if w and item is not None else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    expected = []
    for doc, text, _ in DOCS:
        w, hit, items = plain(text), set(), set()
        for window, ids in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    items |= ids
        expected.append((doc, len(w), sorted(hit), sorted(items)))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (20_000, 2):  # one automaton, and several of bounded size
        found = decontaminate.mark(docs, bench, block_windows=block)
        assert rows(found, "doc_id", "n_words", "hit_words", "items") == sorted(expected, key=repr)
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    text = next(t for d, t, _ in DOCS if d == 7)
    assert [text[s["start"] : s["end"]] for s in spans[7]] == ["one  TWO\tthree"]


def test_mix_meets_targets(docs):
    found = mixing.mix(docs, block_rows=4).collect()
    assert len(found) == len(DOCS) and found != []
    again = mixing.mix(docs.repartition(5), block_rows=4).collect()
    key = lambda r: (repr(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))
    total = sum(len(words(t)) for _, t, _ in DOCS)
    per_source = collections.defaultdict(list)
    for r in found:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        per_source[r["source"]].append(r)
    assert math.isclose(sum(own[0]["target"] for own in per_source.values()), total)
    for own in per_source.values():
        assert own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_targets_are_shared_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 490)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sizes, (5.0, 2.0, 1.0)).collect()}
    assert found["a"] == 30 and math.isclose(sum(found.values()), 2000)  # weights 5, 2, 1, 5 for a, b, c, null
    assert math.isclose(found[None], 1970 * 5 / 8) and math.isclose(found["b"], 1970 * 2 / 8)


def test_scores_match_counts(docs):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    lists = [words(lower(t)) + [None] for _, t, _ in DOCS]
    counts = collections.Counter(w for (d, _, _), ws in zip(DOCS, lists) if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    found = sorted(brown_lm.score_corpus(docs).collect(), key=lambda r: (repr(r["doc_id"]), r["n_tokens"]))
    expected = sorted(zip(DOCS, lists), key=lambda x: (repr(x[0][0]), len(x[1])))
    for r, ((doc, _, _), ws) in zip(found, expected):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["train_tokens"]) == (doc, held(doc), len(ws), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), abs_tol=1e-8)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_class_model_is_a_distribution_and_beats_unigrams(spark, folder):
    found = brown_lm.score_corpus(spark.read.parquet(f"{folder}/documents.parquet"))
    sums = found.where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert sums["s"] > sums["b"]
    texts = spark.createDataFrame([("a b a b c a b",), ("a b c",)], "text string")
    counts = brown_lm.word_counts(texts, brown_lm.split_words)
    model = brown_lm.train(texts, counts)
    for previous in ("a", "b", None):
        before = model.classes[model.numbers.end if previous is None else model.numbers.words[previous.encode()]]
        ids = [*model.numbers.words.values(), model.numbers.end]
        total = sum((model.counts[i] + 1) * model.factor[before, model.classes[i]] for i in ids)
        assert 0.2 < total < 1  # the rest is left to unseen words


def test_every_training_word_is_exchanged(spark):
    """Few frequent words, so that most words are far ones: likelihood, gains and scores by brute force."""
    rng = random.Random(2)
    kinds = [[f"{'xyzv'[k]}{i}" for i in range(60)] for k in range(4)]
    texts = [" ".join(rng.choice(kinds[(start + i) % 4]) for i in range(50)) for start in range(80)]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    known = {w: i for i, (w, _) in enumerate(collections.Counter(w.encode() for t in texts for w in t.split()).most_common(40))}
    numbers = brown_lm.Numbering(known, 40, 16)
    share = spark.sparkContext.broadcast
    near = brown_lm.stage(brown_lm.contexts(table, share(numbers)), "contexts")
    _, _, trail = brown_lm.exchange(near, numbers.count, classes=6)
    assert trail == sorted(trail) and trail[-1] > trail[0]
    own, (_, before), _ = brown_lm.exchange(near, numbers.count)

    far = brown_lm.stage(brown_lm.far_contexts(table, share(numbers), share(own)), "far")
    rest = np.zeros((65, 65))
    kept = np.append(np.arange(40), 56)
    np.add.at(rest.T, own[kept], before[kept])
    steps, follow, rises = brown_lm.exchange_far(far, numbers, own, rest, passes=4)
    assert rises == sorted(rises) and rises[-1] > rises[0] and steps
    number = lambda w: numbers.of([w])[0]
    batch = far.toArrow().combine_chunks().to_batches()[0]
    entries = {r["word"].encode(): {e["history"]: e["n"] for e in r["contexts"]} for r in far.collect()}
    assert set(entries) == {w.encode() for t in texts for w in t.split()} - set(known)

    def counted(class_of):
        out = np.zeros((65, 65))
        for text in texts:
            previous = 56
            for w in [*text.encode().split(), None]:
                out[own[previous], own[56] if w is None else own[known[w]] if w in known else class_of[w]] += 1
                previous = 56 if w is None else number(w)
        return out

    names = [w.encode() for w in batch.column("word").to_pylist()]
    for done in (steps[:0], steps):
        found, (row, history, n) = brown_lm._settled(batch, numbers, own, done)
        class_of = dict(zip(names, found.tolist()))
        assert np.array_equal(counted(class_of), follow if done else steps[0].follow)
        gains = brown_lm._gains(counted(class_of), row, history, n, found)
        for at in range(0, len(names), 37):
            for to in (0, 17, 63):
                moved = brown_lm.likelihood(counted({**class_of, names[at]: to})) - brown_lm.likelihood(counted(class_of))
                assert math.isclose(gains[at, to], moved, abs_tol=1e-6)

    counts = brown_lm.stage(brown_lm.word_counts(table, brown_lm.split_words), "counts")
    model = brown_lm.train(table, counts, 40, 16)
    placed = {r["word"].encode(): (r["n"], r["class"]) for r in model.far.collect()}
    asked = [*texts[:3], "x1 unseen y2 x59 unseen", ""]
    table = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    scored = [r for near in (0, 30, 1000) for r in brown_lm.score(table, model, ["doc_id"], near_words=near).collect()]
    assert len(scored) == 3 * len(asked)
    for r in scored:
        previous, total = 56, 0.0
        for w in [*asked[r["doc_id"]].encode().split(), None]:
            at = 56 if w is None else model.numbers.of([w])[0]
            n, c = placed.get(w, (0, model.classes[at])) if 40 <= at < 56 else (model.counts[at], model.classes[at])
            total += math.log10((n + 1) * model.factor[model.classes[previous], c])
            previous = at
        assert math.isclose(r["score"], total, abs_tol=1e-8)


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_counts_match_the_library(docs, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    expected = [(d, len((t or "").encode()), count(t), count(t) > 1024) for d, t, _ in DOCS]
    found = token_counts.count_tokens(docs, vocabulary)
    assert rows(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=repr)
    odd = ["", "a" * 3000, "aaaa aaa" * 9, "x<|endoftext|><|endoftext|> y", "we'll I'd 'S", "\x85 \u3000b", "\u0661 \u00bd", " " * 99, "\t\r\n\x1c",
           "\ufeff\u200b", "\U0001f469\u200d\U0001f467", "\u65e5\u672c\u8a9e " * 30]
    assert token_counts.Merger(vocabulary).texts(odd) == [count(t) for t in odd]


def test_bounded_choices_are_exact(spark):
    from clientlens.llm.text import smallest_hashes
    from clientlens.llm.vocabulary import most_frequent

    rows = spark.range(20_000).withColumnRenamed("id", "word").selectExpr("cast(word as string) word", "1 + 400000 div (word + 20) n")
    wanted = sorted(((r["word"], r["n"]) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    assert most_frequent(rows, 300) == wanted[:300] and most_frequent(rows, 30_000) == wanted
    assert most_frequent(rows.where("false"), 5) == []
    draw = F.pmod(F.xxhash64("word"), F.lit(1 << 31))
    ordered = [r["word"] for r in rows.orderBy(draw, "word").limit(500).collect()]
    assert [r["word"] for r in smallest_hashes(rows, ["word"], 500).collect()] == ordered
    assert smallest_hashes(rows, ["word"], 50_000).count() == 20_000


def test_empty_tables(spark, no_docs, vocabulary):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    results = (
        substring_dedup.remove_repeats(no_docs), simhash.near_duplicates(no_docs),
        decontaminate.mark(no_docs, bench), mixing.mix(no_docs), brown_lm.score_corpus(no_docs),
        token_counts.count_tokens(no_docs, vocabulary),
    )
    assert [r.count() for r in results] == [0] * len(results)


def test_empty_benchmark_hits_nothing(spark, docs):
    found = decontaminate.mark(docs, spark.createDataFrame([], "item_id long, text string"))
    assert found.where("size(hit_words) > 0").count() == 0 and found.count() == len(DOCS)
