"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every node is described by the density of its subtree, its depth, siblings, tag and the
tokens of its attributes (``dom.describe``). Boosted trees give the log-odds that a node
belongs to the article. Decoding is hierarchical: on the way down a page may enter the
article once and leave it once, and the labelling with the largest total log-odds under that
rule is taken, so no descendant contradicts its ancestors.

The trees are fitted on a bounded sample of the pages (``SAMPLE_PAGES``), whose article
elements are known by their tag. Rearranged copies of those pages, with other containers,
other names and pieces of other pages as menus, notices, comments and the like, teach the
trees to do without that tag.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clientlens.llm import dom
from clientlens.llm.text import smallest_hashes
from clientlens.session import stage

SAMPLE_PAGES = 360
COPIES = 3
#: Nodes whose log-odds are computed together.
NODES = 20_000
TREES = 60
DEPTH = 4
BINS = 32
RATE = 0.2
SEED = 1

_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)
_PARTS = re.compile(r"<(nav|footer|header|aside|form)\b[^>]*>.*?</\1\s*>|<div class=\"[^\"]*\">[^<]*</div>", re.S | re.I)
_BLOCK = re.compile(r"<(p|h[1-6]|ul|ol|table|blockquote|pre)\b[^>]*>.*?(?:</\1\s*>|(?=<p\b)|\Z)", re.S | re.I)


@dataclass(frozen=True)
class Trees:
    """Full binary trees of one depth, node 0 the root; log-odds add up over trees."""

    start: float
    columns: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        every = np.arange(len(rows))
        for columns, cuts, leaves in zip(self.columns, self.cuts, self.leaves):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[every, columns[at]] > cuts[at])
            out += leaves[at - (2**DEPTH - 1)]
        return out


def boost(rows: np.ndarray, labels: np.ndarray, trees: int = TREES) -> Trees | None:
    """Logistic gradient boosting on binned columns; None if there is only one kind of label."""
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in rows.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T)])
    width = rows.shape[1]
    cells = binned + np.arange(width) * BINS
    share = labels.mean()
    start = float(np.log(share / (1 - share)))
    odds = np.full(len(rows), start)
    inner, outer = 2**DEPTH - 1, 2**DEPTH
    all_columns, all_cuts, all_leaves = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-odds))
        slope, bend = labels - chance, chance * (1 - chance)
        columns, cuts = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf, dtype=np.float32)
        at = np.zeros(len(rows), dtype=np.int64)
        for level in range(DEPTH):
            first = 2**level - 1
            for node in range(first, 2 * first + 1):
                here = np.flatnonzero(at == node)
                if len(here) < 20:
                    at[here] = 2 * node + 1
                    continue
                flat = cells[here].ravel()
                g = np.bincount(flat, np.repeat(slope[here], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(flat, np.repeat(bend[here], width), width * BINS).reshape(width, BINS).cumsum(axis=1)
                whole_g, whole_h = g[0, -1], h[0, -1]
                gain = g**2 / (h + 1) + (whole_g - g) ** 2 / (whole_h - h + 1) - whole_g**2 / (whole_h + 1)
                gain[(h < 1) | (whole_h - h < 1)] = -1
                column, cut = np.unravel_index(gain.argmax(), gain.shape)
                if gain[column, cut] > 1e-3 and cut < len(edges[column]):
                    columns[node], cuts[node] = column, edges[column][cut]
                    at[here] = 2 * node + 1 + (binned[here, column] > cut)
                else:
                    at[here] = 2 * node + 1
        leaf = at - inner
        top, bottom = np.bincount(leaf, slope, outer), np.bincount(leaf, bend, outer)
        leaves = RATE * top / (bottom + 1)
        odds += leaves[leaf]
        all_columns.append(columns), all_cuts.append(cuts), all_leaves.append(leaves)
    return Trees(start, np.array(all_columns), np.array(all_cuts), np.array(all_leaves))


def inside(page: dom.Page, odds: np.ndarray) -> np.ndarray:
    """Which nodes are in the article, by the best labelling: outside, then inside, then left."""
    n = len(page.tags)
    odds = np.where(page.hidden, -50.0, odds)
    best_out, best_in, best_left = np.zeros(n), odds.copy(), np.zeros(n)
    # totals relative to leaving a whole subtree out
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        best_out[up] += max(best_out[i], best_in[i])
        best_in[up] += max(best_in[i], best_left[i])
    state = np.zeros(n, dtype=np.int8)  # 0 outside, 1 inside, 2 left
    state[0] = 1 if best_in[0] > best_out[0] else 0
    for i in range(1, n):
        above = state[page.parents[i]]
        if above == 0:
            state[i] = 1 if best_in[i] > best_out[i] else 0
        else:
            state[i] = 1 if above == 1 and best_in[i] > best_left[i] else 2
    return state == 1


def _strings(rng: random.Random, pieces: list[str], prose: list[str]) -> list[str]:
    """Pieces of a page that are not its article, under names such pieces have."""
    words = lambda k: " ".join(rng.choice(prose).split()[:k]) if prose else "more"
    links = lambda k: "".join(f'<li><a href="/{i}">{words(2)}</a></li>' for i in range(k))
    name = lambda *choices: rng.choice(choices)
    long = rng.choice(prose) if prose else ""
    made = [
        f'<header data-label="n" class="{name("site-header", "masthead", "top")}"><h1>{words(3)}</h1><p>{words(8)}</p></header>',
        f'<div data-label="n" id="{name("header", "topbar", "site-header")}"><h2>{words(3)}</h2><ul>{links(4)}</ul></div>',
        f'<div data-label="n" class="{name("menu", "navbar", "main-nav", "navigation")}"><ul>{links(6)}</ul></div>',
        f'<ul data-label="n" class="{name("menu", "nav", "breadcrumb", "breadcrumbs")}">{links(3)}</ul>',
        f'<aside data-label="n"{name("", " class=sidebar", " class=related")}><h3>{words(2)}</h3><p>{words(25)}</p><ul>{links(4)}</ul></aside>',
        f'<div data-label="n" class="{name("sidebar", "widget", "related-posts", "recommended")}"><h3>{words(2)}</h3><ul>{links(5)}</ul><p>{words(15)}</p></div>',
        f'<div data-label="n" class="{name("cookie-notice", "cookie-banner", "consent", "gdpr", "notice", "disclaimer")}"><p>{words(18)}</p><button>{words(1)}</button></div>',
        f'<div data-label="n" class="{name("ad", "ads", "advert", "banner", "promo", "sponsored")}">{name("", "<p>")}{words(12)}</div>',
        f'<form data-label="n" action="/s"><label>{words(2)}</label><input type="text"><p>{words(6)}</p><button>{words(1)}</button></form>',
        f'<div data-label="n" class="{name("newsletter", "subscribe", "signup", "login")}"><p>{words(12)}</p><form><input type="email"></form></div>',
        f'<section data-label="n" {name("class=comments", "id=comments", "class=discussion")}><h2>{words(2)}</h2>'
        + "".join(f'<{t} class="comment"><p>{words(rng.randint(5, 60))}</p></{t}>' for t in [name("div", "article", "li")] * rng.randint(1, 4)) + "</section>",
        f'<div data-label="n" class="{name("comments", "comment-list", "replies", "comments-area")}">' + "".join(
            f'<div class="{name("comment", "reply")}"><span class="author">{words(1)}</span><p>{words(rng.randint(4, 50))}</p></div>' for _ in range(rng.randint(1, 4))) + "</div>",
        f'<div data-label="n" class="{name("share", "social", "tags", "pagination", "pager")}"><a href="#">{words(1)}</a> <a href="#">{words(1)}</a></div>',
        f'<footer data-label="n"><p>{words(9)}</p></footer>', f'<div data-label="n" id="{name("footer", "page-footer")}"><p>{words(14)}</p>{long[:200] if rng.random() < 0.2 else ""}</div>',
        f'<nav data-label="n"><ul>{links(5)}</ul></nav>',
    ]
    return made + [re.sub(r"^<(\w+)", r'<\1 data-label="n"', p, count=1) for p in pieces]


def _short_heading(rng: random.Random, html: str) -> str:
    """The same html with a few words as its first heading."""
    cut = lambda m: m.group(1) + " ".join(m.group(2).split()[: rng.randint(1, 4)]) + m.group(3)
    return re.sub(r"(<h1\b[^>]*>)([^<]*)(</h1>)", cut, html, count=1)


def _copy(rng: random.Random, article: str, pieces: list[str], prose: list[str]) -> str:
    """A page with the same article in another frame."""
    asides = _strings(rng, pieces, prose)
    if rng.random() < 0.4:
        article = _short_heading(rng, article)
    blocks = [m.group(0) for m in _BLOCK.finditer(article)] or [article]
    around = rng.sample(asides, rng.randint(2, 7))
    if rng.random() < 0.6:  # such pieces also stand in the article itself
        for piece in rng.sample(asides, rng.randint(1, 3)):
            blocks.insert(rng.randint(1, len(blocks)), piece)
    body = "".join(blocks)
    kind = rng.random()
    if kind < 0.3:
        body = f'<article data-label="c">{body}</article>'
    elif kind < 0.45:
        body = f'<main data-label="c">{body}</main>'
    elif kind < 0.55:
        body = f'<main><article data-label="c" class="post">{body}</article></main>'
    elif kind < 0.85:
        names = rng.choice(["content", "post-content", "entry-content", "article-body", "story", "main-content", "post", "text"])
        body = f'<div data-label="c" {rng.choice(["class", "id"])}="{names}">{body}</div>'
    elif kind < 0.95:
        body = f'<{rng.choice(["div", "section"])} data-label="c">{body}</div></section>'
    else:
        body = "".join(b if "data-label" in b else re.sub(r"^<(\w+)", r'<\1 data-label="c"', b, count=1) for b in blocks)
    for _ in range(rng.randint(0, 2)):
        body = f'<div{rng.choice(["", " class=container", " class=wrapper", " id=page"])}>{body}</div>'
    cut = rng.randint(0, len(around))
    return f"<html><head><title>x</title></head><body>{''.join(around[:cut])}{body}{''.join(around[cut:])}</body></html>"


def examples(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(figures, labels) of the nodes of sample pages with an article, and of their copies."""
    rng = random.Random(SEED)
    parts = []
    for html in pages:
        found = _ARTICLE.search(html)
        if found:
            outside = html[: found.start()] + html[found.end() :]
            parts.append((html, found, [m.group(0) for m in _PARTS.finditer(outside)]))
    prose = [re.sub(r"<[^>]*>", " ", m.group(0)) for _, f, _ in parts for m in list(_BLOCK.finditer(f.group(2)))[:3]]
    figures, labels = [np.zeros((0, dom.COLUMNS), np.float32)], [np.zeros(0)]
    for html, found, pieces in parts:
        own = html[: found.start()] + f'<{found.group(1)} data-label="c"' + html[found.start() + 1 + len(found.group(1)) :]
        for copy in [own, _short_heading(rng, own)] + [_copy(rng, found.group(2), pieces, prose) for _ in range(COPIES)]:
            page = dom.read(copy)
            state = np.zeros(len(page.tags))
            for i, label in enumerate(page.labels):
                above = state[page.parents[i]] if i else 0
                state[i] = 1 if label == "c" else 0 if label == "n" else above
            figures.append(dom.describe(page))
            labels.append(state)
    return np.concatenate(figures), np.concatenate(labels)


def train(pages: DataFrame, html_col: str = "html", most_pages: int = SAMPLE_PAGES) -> Trees | None:
    """Trees fitted on ``most_pages`` distinct pages with an article or main tag, those with the
    smallest hash of their html. Copies of a page count once, so they cannot crowd out others."""
    html = F.col(html_col)
    draw = F.xxhash64(html)
    tagged = pages.where(html.rlike(r"(?i)<(article|main)\b[^>]*>"))
    hashes = stage(tagged.select(draw.alias("draw")).distinct(), "pages")
    chosen = [r["draw"] for r in smallest_hashes(hashes, ["draw"], most_pages).collect()]
    rows = tagged.where(draw.isin(chosen)).groupBy(draw.alias("draw")).agg(F.min(html).alias("html")).orderBy("draw").collect()
    return boost(*examples([r["html"] for r in rows]))


def main_texts(pages: list[str], trees: Trees | None) -> Iterator[str]:
    """Main text of every page, in order."""
    held: list[tuple[dom.Page, np.ndarray]] = []

    def told() -> Iterator[str]:
        odds = trees.log_odds(np.concatenate([rows for _, rows in held])) if held else np.zeros(0)
        at = 0
        for page, rows in held:
            yield dom.shown(page, inside(page, odds[at : at + len(rows)]))
            at += len(rows)
        held.clear()

    for html in pages:
        page = dom.read(html if trees is not None else "")
        held.append((page, dom.describe(page)))
        if trees is None:
            held.clear()
            yield ""
        elif sum(len(rows) for _, rows in held) > NODES:
            yield from told()
    yield from told()


def extract(pages: DataFrame, trees: Trees | None, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all of ``pages``) with ``text``, the main text of the whole html.

    A null or empty html, and a page without an article, have an empty text; so have all
    pages if the sample had no article to learn from (``trees`` is None). A column ``text``
    in ``pages`` is replaced; repeated rows get the same text; an empty table stays empty.
    """
    kept = [c for c in (carry or pages.columns) if c != "text"]
    held = pages.sparkSession.sparkContext.broadcast(trees)
    source = pages.select(*[F.col(c) for c in kept], F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    schema = T.StructType(source.schema.fields[:-1] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(main_texts(batch.column("_html").to_pylist(), held.value))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(texts, pa.string())], names=[*kept, "text"])

    return source.mapInArrow(run, schema)


def op1_html_extract(spark, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = extract(pages, train(pages), carry=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))
