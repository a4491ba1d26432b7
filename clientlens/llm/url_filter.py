"""URL filter: rules on host and path, else naive Bayes over segmented words.

A rule names a host, with all its subdomains, and the beginning of a path; the longest rule
that fits decides. URLs without a rule are judged by a multinomial naive Bayes model over
the words of host and path. Names written as one word are cut by the Viterbi path of a
unigram model of the words that the pages themselves contain. The model learns from the
URLs that rules decide, so every page of the corpus adds to it. Tokens are hashed to a fixed
number of buckets; that table and the bounded word list are all that is broadcast.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm.vocabulary import most_frequent, word_counts
from clientlens.session import stage

#: (host and beginning of the path, verdict).
RULES = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
BUCKETS = 1 << 18
#: Words of the segmentation model, and letters a word has at most.
WORDS = 50_000
LETTERS = 24
REMEMBERED = 200_000

_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKUP = re.compile(rb"<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>|&\w+;", re.S | re.I)
_SPELLED = re.compile(rb"[a-z\xc3-\xf4\x80-\xbf]+")
_RUN = re.compile(r"[0-9]+|[^\W\d_]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without ``://``."""
    safe = F.coalesce(url, F.lit(""))
    at = F.instr(safe, "://")
    rest = F.when(at > 0, F.substring(safe, at + 3, F.length(safe))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _ASCII, _ASCII.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does; of two rules of one
    length the first in code-point order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Most probable words of a run of letters under a unigram model.

    ``mass`` is what the words of the whole corpus weigh, each its count and one; by default
    ``counts`` are all of them."""

    def __init__(self, counts: list[tuple[str, int]], mass: int | None = None) -> None:
        self.total = (sum(n + 1 for _, n in counts) if mass is None else mass) + 1
        self.cost = {w: -math.log10((n + 1) / self.total) for w, n in counts if len(w) <= LETTERS}
        self.known: dict[str, list[str]] = {}

    def words(self, run: str) -> list[str]:
        if run not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[run] = self._cut(run)
        return self.known[run]

    def _cut(self, run: str) -> list[str]:
        unseen = math.log10(self.total)
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            choices = []
            for begin in range(max(0, end - LETTERS), end):
                price = self.cost.get(run[begin:end])
                choices.append((best[begin] + (unseen + end - begin if price is None else price), begin))
            least, begin = min(choices)
            best.append(least)
            back.append(begin)
        words, end = [], len(run)
        while end:
            words.append(run[back[end] : end])
            end = back[end]
        return words[::-1]

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host, marked as such, and of the path; a number stands for its length."""
        out = []
        for mark, text in (("h", host), ("p", path.lower())):
            for run in _RUN.findall(text):
                out += [f"{mark}#{len(run)}"] if run[0].isdigit() else [f"{mark}:{w}" for w in self.words(run)]
        return out


def spelled_words(html: bytes) -> list[bytes]:
    """Lower-case words of the visible text of a page."""
    return [w for w in _SPELLED.findall(_MARKUP.sub(b" ", html).lower()) if _whole(w)]


def _whole(word: bytes) -> bool:
    try:
        return len(word.decode()) <= LETTERS
    except UnicodeDecodeError:
        return False


def with_tokens(pages: DataFrame, words: list[tuple[str, int]], mass: int | None = None) -> DataFrame:
    """``pages`` (with host and path) and ``tokens``, and ``buckets``, the hashes of those."""
    held = pages.sparkSession.sparkContext.broadcast((words, mass))
    carried = pages.columns
    schema = T.StructType(pages.schema.fields + T.StructType.fromDDL("tokens array<string>, buckets array<int>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(*held.value)
        for batch in batches:
            found = [segmenter.tokens(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            buckets = [[zlib.crc32(t.encode("utf-8", "replace")) % BUCKETS for t in tokens] for tokens in found]
            fresh = [pa.array(found, pa.list_(pa.string())), pa.array(buckets, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + fresh, names=[*carried, "tokens", "buckets"])

    return pages.mapInArrow(run, schema)


def bayes(examples: DataFrame) -> tuple[float, np.ndarray]:
    """Log-odds of block against allow: of a page, and of each bucket. ``examples`` has
    ``verdict`` and ``buckets``. Without examples everything is even."""
    pages = {r["verdict"]: r["n"] for r in examples.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros((2, BUCKETS))
    rows = examples.select("verdict", F.explode("buckets").alias("bucket")).groupBy("verdict", "bucket").agg(
        F.count("*").alias("n")
    ).collect()  # two rows a bucket at most
    for r in rows:
        counts[int(r["verdict"] == "block"), r["bucket"]] += r["n"]
    seen = counts.any(axis=0)
    shares = np.log(counts + 1) - np.log(counts.sum(axis=1, keepdims=True) + seen.sum() + 1)
    odds = np.where(seen, shares[1] - shares[0], 0.0)  # a token no example has says nothing
    return math.log((pages.get("block", 0) + 1) / (pages.get("allow", 0) + 1)), odds


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url", html_col: str = "html",
          carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """``carry`` columns with host, path, rule, verdict, log_odds (of block) and tokens.

    A rule decides where one fits; elsewhere ``block`` if the log-odds are above zero, else
    ``allow``. Null urls and those without ``://`` have empty host and path, no tokens, and
    the verdict of the prior. Repeated rows are judged and counted each; an empty table
    gives an empty result.
    """
    counts = word_counts(pages.select(F.col(html_col).alias("text")), spelled_words)
    counts = stage(counts, "words")
    words, mass = most_frequent(counts, WORDS), counts.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    host, path = host_and_path(F.col(url_col))
    source = pages.select(*[F.col(c) for c in carry], host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    source = source.withColumn("rule", rule).withColumn("verdict", verdict)
    tokens = stage(with_tokens(source, words, mass), "tokens")
    held = pages.sparkSession.sparkContext.broadcast(bayes(tokens.where("rule is not null")))
    carried = [*carry, "host", "path", "rule", "verdict"]
    schema = T.StructType([tokens.schema[c] for c in carried] + T.StructType.fromDDL("log_odds double, tokens array<string>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, odds = held.value
        for batch in batches:
            lists = batch.column("buckets")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            sums = prior + np.bincount(row, weights=odds[lists.flatten().to_numpy()], minlength=batch.num_rows)
            decided = [
                v or ("block" if s > 0 else "allow") for v, s in zip(batch.column("verdict").to_pylist(), sums.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carried[:-1]] + [pa.array(decided, pa.string()), pa.array(sums), batch.column("tokens")],
                names=[*carried, "log_odds", "tokens"],
            )

    return tokens.mapInArrow(run, schema)


def op9_url_filter(spark, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    found = judge(spark.read.parquet(f"{folder}/pages.parquet"))
    return found.select("page_id", "host", "path", "rule", "verdict")
