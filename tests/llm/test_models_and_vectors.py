"""Classifier, page extraction, URL filter and nearest neighbours."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import ann_tree, html_extract, quality, url_filter
from clientlens.llm.text import smallest_hashes
from tests.llm.conftest import DOCS

LARGER = "/root/testdata/sf0.1"


def test_held_out_grades(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    graded = quality.grades_of(spark.read.parquet(f"{LARGER}/labels.parquet"))
    held = F.pmod(F.xxhash64("_id"), F.lit(5)) == 0
    model = quality.train(docs, graded.where(~held))
    assert model.thresholds[0] < model.thresholds[1]
    rated = quality.rate(docs, model, carry=["doc_id"]).join(graded.where(held).withColumnRenamed("_id", "doc_id"), "doc_id")
    kept = {r["grade"]: (r["kept"], r["grade_found"]) for r in rated.groupBy("grade").agg(
        F.avg(F.col("keep").cast("int")).alias("kept"), F.avg("expected_grade").alias("grade_found")).collect()}
    assert kept[2][0] > 0.95 and kept[0][0] < 0.4 and kept[1][0] < 0.5
    assert kept[0][1] < kept[1][1] < kept[2][1]


def test_rating_handles_every_row(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (8, 0, 0), (12, 1, 1), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    graded = quality.grades_of(labels)
    assert sorted(tuple(r) for r in graded.collect()) == [(0, 2), (8, 1), (12, 0)]
    model = quality.train(docs, graded)
    rated = quality.rate(docs, model)
    assert rated.count() == len(DOCS) and rated.columns.count("keep") == 1
    assert rated.where("expected_grade is null or good_probability not between 0 and 1").count() == 0
    assert quality.rate(no_docs, model).count() == 0
    unlabelled = quality.train(docs, graded.where("false"))
    assert quality.rate(docs, unlabelled).where("not keep").count() == 0


def test_sample_bound_of_the_fit(docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(13)], "doc_id long, quality int, toxic int")
    few = quality.train(docs, quality.grades_of(labels), most_rows=4)
    all_of_them = quality.train(docs, quality.grades_of(labels), most_rows=13)
    assert not np.array_equal(few.weights, all_of_them.weights)


def article(page: str) -> str:
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    inner = re.sub(r"</?(?:p|h1|br|div|ul|li)\b[^>]*>", " ", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def trees(pages):
    return html_extract.train(pages)


def test_articles_of_all_pages(pages, trees):
    found = html_extract.extract(pages, trees, carry=["page_id", "html"]).collect()
    right = sum(r["text"] == article(r["html"]) for r in found)
    assert right >= 0.99 * len(found)


def test_copies_do_not_empty_the_sample(spark, pages):
    """One page 10,000 times, few pages 300 times, and many pages without an article."""
    few = [r["html"] for r in pages.select("html").distinct().limit(12).collect()]
    rows = [(p,) for p in few for _ in range(300)] + [(few[0],)] * 10_000 + [(f"<div><p>Note {i}</p></div>",) for i in range(3000)]
    table = spark.createDataFrame(rows, "html string").repartition(8)
    trees = html_extract.train(table, most_pages=10)
    assert trees is not None
    once = html_extract.train(spark.createDataFrame([(p,) for p in few], "html string"), most_pages=10)
    assert np.array_equal(trees.leaves, once.leaves)
    same = spark.createDataFrame([("x",)], "html string").crossJoin(spark.range(5000))
    assert all(smallest_hashes(same.withColumn("html", F.lit(f"y{i}")), ["html"], 20).count() == 20 for i in range(4))


def test_other_frames(trees):
    prose = " ".join(f"Word{i} and more of it, said plainly." for i in range(12))
    page = (
        f'<html><head><title>T</title></head><body><header class="site-header"><h1>Site</h1></header>'
        f'<div class="cookie-notice"><p>We use cookies.</p></div><div class="sidebar"><ul><li><a href="/a">Link</a></li></ul></div>'
        f'<div class="post-content"><h1>Head&amp;line</h1><p>{prose}<script>x()</script></p><p>An<b>other</b>\n one &eacute;.</p>'
        f'<div class="advert">Buy now</div><p>{prose}</p></div><form><p>Your name</p><input type="text"></form>'
        f'<section class="comments"><h2>Comments</h2><div class="comment"><p>Nice read</p></div></section>'
        f'<div id="footer">Imprint</div></body></html>'
    )
    text = next(html_extract.main_texts([page], trees))
    assert text == f"Head&line {prose} Another one é. {prose}"


def test_decoding_is_hierarchical():
    page = html_extract.dom.read("<div><article><p>a</p><aside><p>b</p></aside></article><p>c</p></div>")
    odds = np.array([-3.0, -2.0, 4.0, 3.0, -4.0, 1.0, -1.0])
    assert html_extract.inside(page, odds).tolist() == [False, False, True, True, False, False, False]


def test_odd_pages(spark, trees):
    rows = [(1, None), (2, ""), (3, "no tags"), (4, "<p>" * 300), (5, "<div class='a" + "<" * 500), (6, "</b></p><!-- x"), (6, "</b></p><!-- x"),
            (7, "<article><p>" + "long text here, with words. " * 20000 + "</p></article>"), (8, "<script>" + "x<p>" * 50)]
    table = spark.createDataFrame([(i, h, "t", 1) for i, h in rows], "page_id long, html string, text string, n int")
    found = html_extract.extract(table, trees)
    assert found.count() == len(rows) and found.where("text is null").count() == 0
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    assert texts[1] == texts[2] == texts[8] == "" and len(texts[7]) == len("long text here, with words. ") * 20000 - 1
    assert html_extract.extract(table.where("false"), trees).count() == 0
    assert html_extract.train(table.where("page_id < 4")) is None
    assert html_extract.extract(table, None).where("text <> ''").count() == 0


URLS = [
    (1, "http://a.example.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    (2, "HTTPS://WWW.Example.ORG/en/14", "www.example.org", "/en/14", "example.org/en/1", "block"),
    (3, "http://example.org", "example.org", "", None, None), (4, "x://org/", "org", "/", "org/", "allow"),
    (5, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), (6, None, "", "", None, None),
    (7, "example.org/es/", "", "", None, None), (8, "http://b.com/FR/1", "b.com", "/FR/1", None, None),
    (9, "http://b.com/de/1", "b.com", "/de/1", "com/de/", "block"), (9, "http://b.com/de/1", "b.com", "/de/1", "com/de/", "block"),
    (10, "a://b://c.org/x", "b:", "//c.org/x", None, None), (11, "http://É.com/fr/é", "É.com", "/fr/é", "com/fr/", "allow"),
    (12, "", "", "", None, None), (13, "http://?q", "", "", None, None),
]


def test_rules_and_verdicts(spark):
    table = spark.createDataFrame([(i, u, "<p>some words</p>", 1) for i, u, *_ in URLS], "page_id long, url string, html string, tokens int")
    found = url_filter.judge(table)
    seen = sorted((tuple(r) for r in found.select("page_id", "host", "path", "rule").collect()), key=repr)
    assert seen == sorted(((i, h, p, r) for i, _, h, p, r, _ in URLS), key=repr)
    verdicts = {r["page_id"]: r["verdict"] for r in found.collect()}
    assert all(verdicts[i] == v if v else verdicts[i] in ("allow", "block") for i, _, _, _, _, v in URLS)
    assert url_filter.judge(table.where("false")).count() == 0


def test_longest_rule_wins_in_any_order(spark):
    rules = (("org/", "allow"), ("example.org/", "block"), ("a.example.org/x", "allow"))
    table = spark.createDataFrame([("a.example.org", "/xy"), ("b.example.org", "/x"), ("c.org", "/")], "h string, p string")
    for given in (rules, rules[::-1]):
        rule, verdict = url_filter.rule_of(F.col("h"), F.col("p"), given)
        assert [tuple(r) for r in table.select(rule, verdict).collect()] == [
            ("a.example.org/x", "allow"), ("example.org/", "block"), ("org/", "allow")]


def test_segmentation_and_bayes(spark):
    cutter = url_filter.Segmenter([("free", 50), ("bets", 40), ("news", 60), ("paper", 30), ("fr", 3), ("eebets", 1)])
    assert cutter.tokens("freebets.com", "/newspaper/2024") == ["h:free", "h:bets", "h:com", "p:news", "p:paper", "p#4"]
    assert cutter.words("x" * 200) and "".join(cutter.words("qfreeq")) == "qfreeq"
    part = url_filter.Segmenter([("free", 50), ("bets", 40)], 1000)  # words of a larger corpus
    assert {w: round(10 ** -c * 1001) for w, c in part.cost.items()} == {"free": 51, "bets": 41}
    pages_in = [(i, f"http://freebets{i}.com/de/", "<p>free bets news paper free bets news paper</p>") for i in range(6)]
    pages_in += [(10 + i, f"http://newspaper{i}.com/fr/", "") for i in range(6)] + [(20, "http://freebets.net/x", ""), (21, "http://newspaper.net/x", "")]
    found = url_filter.judge(spark.createDataFrame(pages_in, "page_id long, url string, html string"))
    assert {r["page_id"]: r["verdict"] for r in found.where("page_id >= 20").collect()} == {20: "block", 21: "allow"}


def test_recall_against_brute_force(spark):
    vectors = spark.read.parquet(f"{LARGER}/embeddings.parquet")
    rows = vectors.collect()
    ids = np.array([r["vec_id"] for r in rows])
    points = np.array([r["embedding"] for r in rows], dtype=float)
    found = {}
    for r in ann_tree.search(vectors, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hit = 0
    for query, answers in found.items():
        answers.sort()
        scores = points @ points[ids == query][0]
        best = [i for i in np.lexsort((ids, -scores)) if ids[i] != query][:20]
        hit += len({int(ids[i]) for i in best} & {v for _, v, _ in answers})
        assert [r for r, _, _ in answers] == list(range(1, 21))
        assert np.allclose([s for _, _, s in answers], [scores[ids == v][0] for _, v, _ in answers], rtol=1e-12)
    assert hit >= 0.9 * 20 * len(found)


def test_vectors_with_ties_and_gaps(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0], "x") for i in range(0, 60, 2)] + [
        (1, None, "x"), (3, [0.0, 0.0], "x"), (5, [nan, 1.0], "x"), (7, [None, 1.0], "x"), (9, [1.0, float("inf")], "x"),
        (11, [1.0], "x"), (13, [], "x"), (None, [1.0, 1.0], "x"), (15, [-1.0, 0.5], "x"), (20, [1.0, 0.0], "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string")
    found = ann_tree.search(table, F.col("vec_id") % 20 == 0).collect()
    asked = {r["query_id"] for r in found}
    assert asked == {0, 20, 40}
    for query in asked:
        answers = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query]
        # equal scores in the order of ids; of a repeated id both rows are candidates
        others = sorted(i for i, v, _ in rows if v == [1.0, 0.0] and i != query)
        assert answers == others[:20]
    few = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann_tree.search(few, F.col("vec_id") % 20 == 0).collect()) == [
        (0, 1, 20, 2.0), (0, 2, 1, -1.0), (20, 1, 0, 2.0), (20, 2, 1, -2.0)]
    assert ann_tree.search(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0
