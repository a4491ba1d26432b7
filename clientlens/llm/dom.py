"""A forgiving reader of web pages: nodes, their texts and what is known about each node."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import numpy as np

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|data-label)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown as text of the page.
UNSEEN = set("script style noscript template title textarea iframe svg select button object canvas audio video math".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split()
)
#: What an opening tag ends, and which ancestors hold that end back.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
TAGS = "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li table tr td blockquote figure pre nav footer header aside form dl span".split()
#: Name parts of containers that are not, or are, the article.
ASIDE_NAMES = set(
    """ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion
    footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promotion
    recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription
    tags toolbar topbar widget widgets""".split()
)
MAIN_NAMES = set("article body content entry main page post story text".split())
HASHED = 24


@dataclass
class Page:
    """Nodes in page order, parents before children, and texts in page order."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)  # of tags that are not nodes, and of links
    links: list[int] = field(default_factory=list)
    inputs: list[int] = field(default_factory=list)
    #: (node, text, within a link); a text of None ends a block.
    texts: list[tuple[int, str | None, bool]] = field(default_factory=list)


def read(html: str) -> Page:
    """Nodes are block elements, and inline elements with a class, an id or a role.

    End tags that fit no open element are skipped, an inline one never ends a block, and
    elements left open end with their container.
    """
    page = Page()

    def node(tag: str, parent: int, told: str) -> int:
        names, label, hidden = [], "", False
        if told:
            for key, *values in _ATTRIBUTE.findall(told):
                key, value = key.lower(), "".join(values)
                if key == "data-label":
                    label = value
                elif key == "hidden":
                    hidden = True
                elif key == "style":
                    hidden |= "display:none" in value.replace(" ", "").lower()
                else:
                    names += [t.lower() for t in _TOKEN.findall(value)]
        page.tags.append(tag)
        page.parents.append(parent)
        page.names.append(names)
        page.labels.append(label)
        page.hidden.append(hidden)
        for column in (page.counts, page.links, page.inputs):
            column.append(0)
        return len(page.tags) - 1

    stack: list[tuple[str, int]] = [("", node("html", -1, ""))]
    linked = 0
    place, end = 0, len(html)

    def text(raw: str) -> None:
        if raw:
            page.texts.append((stack[-1][1], unescape(raw) if "&" in raw else raw, linked > 0))

    def ended(depth: int) -> None:
        nonlocal linked
        while len(stack) > depth:
            tag, own = stack.pop()
            linked -= tag == "a"
            if tag not in INLINE:
                page.texts.append((own, None, False))

    while place < end:
        found = _TAG.search(html, place)
        if not found:
            text(html[place:])
            break
        text(html[place : found.start()])
        place = found.end()
        slash, name, told = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if slash:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    ended(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if tag in ("html", "head", "body") or tag in VOID:
            if tag == "body":
                ended(1)
                stack.append((tag, node(tag, 0, told)))
            elif tag == "head":
                stack.append((tag, node(tag, 0, told)))
            else:
                own = stack[-1][1]
                page.counts[own] += 1
                page.inputs[own] += tag == "input"
                if tag in ("br", "hr"):
                    page.texts.append((own, None, False))
            continue
        if tag in UNSEEN:
            page.inputs[stack[-1][1]] += tag in ("textarea", "select", "button")
            if not told.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, place)
                place = close.end() if close else end if tag in ("script", "style", "textarea", "title") else place
            continue
        if stack[-1][0] == "head" or any(t == "head" for t, _ in stack[:2]):
            ended(1)  # the first shown element ends the head
        if tag in _ENDS:
            these, stop = _ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in stop:
                    break
                if stack[depth][0] in these:
                    ended(depth)
                    if tag != "tr":
                        break
        elif tag in _ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    ended(depth)
                    break
                if stack[depth][0] not in INLINE:
                    break
        own = stack[-1][1]
        if tag in INLINE:
            linked += tag == "a"
            page.links[own] += tag == "a"
            if _ATTRIBUTE.search(told) and tag != "a":
                own = node(tag, own, told)
            else:
                page.counts[own] += 1
        else:
            page.texts.append((own, None, False))
            own = node(tag, own, told)
        stack.append((tag, own))
    return page


COLUMNS = 20 + 2 * len(TAGS) + 6 + HASHED


def describe(page: Page) -> np.ndarray:
    """One line of figures a node: densities of its subtree, depth, siblings, tag, names of it
    and of its ancestors."""
    n = len(page.tags)
    parents = page.parents
    own = np.zeros((n, 4))  # letters, letters in links, punctuation, words
    first = np.full(n, -1.0)
    total = 0
    for number, text, linked in page.texts:
        if text is None:
            continue
        words = text.split()
        if words:
            letters = sum(map(len, words))
            line = own[number]
            line[0] += letters
            line[1] += letters * linked
            line[2] += sum(map(text.count, ".,;:!?"))
            line[3] += len(words)
            if first[number] < 0:
                first[number] = total
            total += letters
    sums = np.column_stack([own, np.array(page.counts) + 1.0, page.links, page.inputs, [t == "p" for t in page.tags]])
    children = np.zeros(n)
    depth = np.zeros(n)
    for i in range(n - 1, 0, -1):
        up = parents[i]
        sums[up] += sums[i]
        children[up] += 1
        if first[i] >= 0 and (first[up] < 0 or first[i] < first[up]):
            first[up] = first[i]
    same: dict[tuple[int, str], int] = {}
    place = np.zeros(n)
    seen: dict[int, int] = {}
    side = np.zeros((n, 3))  # noise names above, main names above, noise tags above
    hits = np.zeros((n, 3))
    hashed = np.zeros((n, HASHED))
    for i in range(n):
        up = parents[i]
        names = set(page.names[i])
        hits[i] = len(names & ASIDE_NAMES), len(names & MAIN_NAMES), len(names)
        for name in names:
            hashed[i, sum(name.encode()) * 31 % HASHED] = 1
        if up >= 0:
            depth[i] = depth[up] + 1
            same[up, page.tags[i]] = same.get((up, page.tags[i]), 0) + 1
            place[i] = seen.get(up, 0)
            seen[up] = seen.get(up, 0) + 1
            side[i] = side[up] + [hits[up, 0] > 0, hits[up, 1] > 0, page.tags[up] in ("nav", "footer", "header", "aside", "form")]
    up = np.maximum(np.array(parents), 0)
    letters, sub = sums[:, 0], sums
    brothers = np.maximum(children[up], 1)
    beside = (letters[up] - letters) / np.maximum(brothers - 1, 1)
    figures = np.column_stack([
        depth, np.log1p(letters), np.log1p(own[:, 0]), sub[:, 1] / np.maximum(letters, 1), np.log1p(letters / sub[:, 4]),
        children, brothers, place / brothers, letters / max(total, 1), sub[:, 2] / np.maximum(sub[:, 3], 1),
        letters / np.maximum(sub[:, 3], 1), [same.get((p, t), 1) for p, t in zip(parents, page.tags)],
        np.log1p(np.maximum(beside, 0)), letters / np.maximum(beside, 1), sub[:, 7], np.log1p(sub[:, 5]), np.log1p(sub[:, 6]),
        np.maximum(first, 0) / max(total, 1), sub[:, 3] / np.maximum(sub[:, 4], 1), sub[:, 7] / np.maximum(sub[up, 7], 1),
    ])
    tag = np.array([[t == x for x in TAGS] for t in page.tags], dtype=float).reshape(n, -1)
    return np.column_stack([figures, tag, tag[up] * (np.array(parents) >= 0)[:, None], hits, side, hashed]).astype(np.float32)


def shown(page: Page, inside: np.ndarray) -> str:
    """Texts of the nodes that are inside, white space as one space, blocks parted by one."""
    return " ".join("".join(
        " " if text is None else text for node, text, _ in page.texts if text is None or inside[node]
    ).split())
