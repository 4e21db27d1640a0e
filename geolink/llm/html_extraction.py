"""Operator 7: main text of HTML pages by boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into a tree.  Gradient-boosted trees score every element from
subtree statistics (text, link and punctuation density, element counts), attribute
tokens, tag, depth, sibling statistics and its ancestors.  What a token of a class, id
or role speaks for is learned with the trees: its log odds, in a table of ``SLOTS``
hashed tokens.  Decoding chooses the
set of elements with the best total score in which every chosen element's parent
is chosen, so no ancestor and descendant contradict each other.  The text of the
chosen elements, block by block, is the result.

The trees are fitted in this process on ``PAGES`` generated pages of varied layout
(``sample_page``), whose main text is known; the driver ships only the fitted
arrays.

Defined results
    null or empty html  empty text
    no markup           the whole text, as one block
    white space inside a block  one space; a br counts as white space
    character references  decoded as HTML5 does
    unclosed, stray tags   closed at the next block or at the end; ignored
    very long pages     whole
    repeated rows       extracted alike
    empty table         no rows
    extra columns       those named in ``keep`` are carried along
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.llm.common import keeping, table

#: Fixed values of HTML: elements without content, with raw text, that end an open paragraph, that flow inside a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of the same family.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TAGS = "a article aside b blockquote body button code dd div dl dt em figcaption figure footer form h1 h2 h3 h4 header i input label li main nav ol p pre script section select span strong style table td th tr ul".split()
TAG_ID = {t: i + 1 for i, t in enumerate(TAGS)}
_SIDE = frozenset("nav footer header aside form script style button select label noscript head template iframe textarea title".split())

#: One step inside a tag: its end, or an attribute with its value.  A quote opens a string after "=" alone, and a string
#: that never closes ends the attribute, so no step reads a character twice but the first that looks for a missing quote.
_STEP = re.compile(r"""[\s/]*+(?:(>)|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+|=[^\s/>]*+)""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}


def _tag_end(html: str, at: int) -> int:
    """Where the tag whose attributes begin at ``at`` ends (after its '>'); -1 if it never does."""
    while True:
        m = _STEP.match(html, at)
        if m is None:
            return -1
        at = m.end()
        if m[1]:
            return at


def _markup(html: str):
    """Yield (start, end, closing, name, attributes) of all markup, in one pass; names of comments and declarations are None.

    A tag that never ends is text, and so is all that follows it.
    """
    at, size = 0, len(html)
    while True:
        start = html.find("<", at)
        if start < 0 or start + 1 >= size:
            return
        mark = html[start + 1]
        if mark in "!?":
            end = html.find("-->", start + 4) + 3 if html.startswith("<!--", start) else html.find(">", start) + 1
            at = end if end > 2 or end == 1 and html[0] == ">" else size
            yield start, at, False, None, ""
            continue
        closing = mark == "/"
        name = _NAME.match(html, start + 1 + closing)
        if name is None:
            at = start + 1
            continue
        end = _tag_end(html, name.end())
        if end < 0:
            return
        at = end
        raw = yield start, end, closing, name[0].lower(), html[name.end() : end - 1]
        if raw is not None:  # the consumer went on behind an element of raw text
            at = raw
            yield


@dataclass
class Page:
    """Elements in document order; ``texts`` are (element, text, block number) in document order."""

    tag: list[str] = field(default_factory=lambda: ["#root"])
    parent: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    texts: list[tuple[int, str, int]] = field(default_factory=list)


def parse(html: str) -> Page:
    """The element tree of a page, with HTML's implied end tags where blocks need them."""
    page, stack, at, run = Page(), [0], 0, 0
    tags, parents, names, texts = page.tag, page.parent, page.names, page.texts
    # where in the stack elements of each name, and blocks, are open: no tag looks through the stack
    places: dict[str, list[int]] = {}
    blocks_open: list[int] = []
    deepest = lambda several: max((places[t][-1] for t in several if places.get(t)), default=0)

    def cut(k: int) -> bool:
        """Close all elements from place ``k`` on; whether a block was among them."""
        for x in stack[k:]:
            places[tags[x]].pop()
        del stack[k:]
        before = len(blocks_open)
        while blocks_open and blocks_open[-1] >= k:
            blocks_open.pop()
        return len(blocks_open) < before

    scan = _markup(html)
    for start, end, closing, name, attributes in scan:
        if start > at:
            texts.append((stack[-1], unescape(html[at:start]), run))
        at = end
        if name is None:
            continue
        if closing:
            if places.get(name):
                run += cut(places[name][-1])
            continue
        if name in BLOCK:
            run += 1
            if blocks_open and tags[stack[blocks_open[-1]]] == "p":
                cut(blocks_open[-1])
        if name in SIBLINGS and (k := deepest(SIBLINGS[name])) > deepest(FENCE[name]):
            cut(k)
        node = len(tags)
        tags.append(name)
        parents.append(stack[-1])
        names.append(" ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower() if attributes and not attributes.isspace() else "")
        if name in RAW:
            stop = _RAW_END[name].search(html, at)
            texts.append((node, html[at : stop.start() if stop else len(html)], run))
            at = html.find(">", stop.start()) + 1 if stop else 0
            at = at or len(html)
            scan.send(at)
        elif name in VOID:
            if name == "br":
                texts.append((stack[-1], " ", run))
        elif not attributes.endswith("/"):
            places.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks_open.append(len(stack))
            stack.append(node)
    if at < len(html):
        texts.append((stack[-1], unescape(html[at:]), run))
    return page


FEATURES = 30


#: Slots of the table of attribute tokens.
SLOTS = 4096


def slots(names: str) -> list[int]:
    """The table's places of the tokens of an element's class, id and role."""
    return sorted({crc32(t.encode()) % SLOTS for t in _TOKEN.findall(names)}) if names else []


def token_odds(pages: list[Page], truths: list[list[bool]]) -> np.ndarray:
    """For each slot, how its tokens speak for main text (above 0) or against it, shrunk where they are few."""
    seen = np.ones((2, SLOTS))
    for page, truth in zip(pages, truths, strict=True):
        for names, main in zip(page.names, truth, strict=True):
            seen[int(main), slots(names)] += 1
    return np.log(seen[1] / seen[0])


def features(page: Page, odds: np.ndarray) -> np.ndarray:
    """One row per element: what the trees see of it."""
    n = len(page.tag)
    parent = np.array(page.parent)
    tag = np.array([TAG_ID.get(t, 0) for t in page.tag])
    own, words, stops, marks = (np.zeros(n) for _ in range(4))
    for node, text, _ in page.texts:
        if page.tag[node] in RAW:
            continue
        own[node] += len(text.strip())
        words[node] += text.count(" ") + 1
        stops[node] += text.count(".") + text.count(",")
        marks[node] += text.count("|") + text.count("©") + text.count("·") + text.count("»")
    is_ = {t: (tag == TAG_ID[t]).astype(float) for t in ("a", "p", "li", "input")}
    link = own * is_["a"]
    good, bad, side, art = (np.zeros(n) for _ in range(4))
    for i, (t, names) in enumerate(zip(page.tag, page.names, strict=True)):
        if names:
            known = odds[slots(names)]
            good[i], bad[i] = max(known.max(initial=0), 0), max(-known.min(initial=0), 0)
        side[i], art[i] = t in _SIDE, t in ("article", "main")
    # from the leaves up: sums over subtrees (children come after their parents)
    columns = np.stack([own, words, stops, marks, link, np.ones(n), is_["p"], is_["a"], is_["li"], is_["input"], bad > 1, art])
    total = columns.T.tolist()
    for i in range(n - 1, 0, -1):
        up, here = total[parent[i]], total[i]
        for k in range(len(here)):
            up[k] += here[k]
    total = np.array(total).reshape(n, len(columns))
    # from the root down: depth and ancestors
    depth, above_bad, above_side, above_art, place, same = (np.zeros(n) for _ in range(6))
    children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
    seen: dict[tuple[int, int], int] = {}
    counted = np.zeros(n)
    for i in range(1, n):
        u = page.parent[i]
        depth[i] = depth[u] + 1
        above_bad[i] = above_bad[u] + (bad[u] > 1 and good[u] <= 1)
        above_side[i] = above_side[u] + side[u]
        above_art[i] = above_art[u] or art[u]
        place[i] = counted[u]
        counted[u] += 1
        seen[u, tag[i]] = seen.get((u, tag[i]), 0) + 1
    for i in range(1, n):
        same[i] = seen[page.parent[i], tag[i]]
    up = np.maximum(parent, 0)
    text = np.maximum(1, total[:, 0])
    siblings = np.maximum(1, children[up])
    return np.column_stack([
        tag, tag[up], depth, np.log1p(own), np.log1p(total[:, 0]), np.log1p(total[:, 1]), total[:, 2] / np.maximum(1, total[:, 1]), total[:, 3] / np.maximum(1, total[:, 1]),
        total[:, 4] / text, total[:, 5] / text, np.log1p(total[:, 5]), np.log1p(total[:, 6]), total[:, 7] / np.maximum(1, total[:, 5]), total[:, 8], total[:, 9], total[:, 10], total[:, 11],
        good, bad, good[up], bad[up], side, above_bad, above_side, above_art, children, place / siblings, same / siblings, total[:, 0] / np.maximum(1, total[up, 0]), total[:, 0] / np.maximum(1, total[0, 0]),
    ])


@dataclass
class Trees:
    """Boosted regression trees of equal depth, as arrays: feature and threshold per inner node, value per leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


@dataclass
class Model:
    """The trees and the log odds of hashed attribute tokens."""

    trees: Trees
    odds: np.ndarray


def boost(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Second-order gradient boosting on the logistic loss with histogram splits."""
    n, k = x.shape
    # values of a kind (tags, counts) are told apart one by one, others by quantiles
    distinct = [np.unique(x[:, j]) for j in range(k)]
    cuts = [d[:-1] if len(d) <= 2 * bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j, d in enumerate(distinct)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)])
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.zeros(width)
            for j in range(k):
                m = len(cuts[j]) + 1
                if m < 2:
                    continue
                key = local * m + code[j]
                gs = np.bincount(key, g, width * m).reshape(width, m)
                hs = np.bincount(key, h, width * m).reshape(width, m)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 1e-3) | (ht - hl < 1e-3)] = 0
                b = gain.argmax(axis=1)
                better = gain[np.arange(width), b] > best + 1e-9
                best[better] = gain[np.arange(width), b][better]
                where = first + np.flatnonzero(better)
                out.feature[tree, where] = j
                out.threshold[tree, where] = cuts[j][b[better]]
            at = 2 * at + 1 + (x[np.arange(n), out.feature[tree, at]] > out.threshold[tree, at])
        leaf = at - inner
        out.value[tree] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        score += out.value[tree][leaf]
    return out


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The best set of elements closed under taking parents: True where chosen."""
    gain = odds.tolist()
    for i in range(len(gain) - 1, 0, -1):  # children come after their parents
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    chosen = np.zeros(len(gain), dtype=bool)
    chosen[0] = True
    for i in range(1, len(gain)):
        chosen[i] = chosen[parent[i]] and gain[i] > 0
    return chosen


def blocks(page: Page, chosen: np.ndarray) -> str:
    """The chosen elements' text, one line per block."""
    lines, held, last = [], [], -1
    for node, text, run in page.texts:
        if run != last:
            lines.append(" ".join("".join(held).split()))
            held, last = [], run
        if chosen[node] and page.tag[node] not in RAW:
            held.append(text)
    lines.append(" ".join("".join(held).split()))
    return "\n".join(x for x in lines if x)


class Extractor:
    def __init__(self, model: Model):
        self.trees, self.odds = model.trees, model.odds

    def texts(self, pages: list[str]) -> list[str]:
        parsed = [parse(x) for x in pages]
        if not parsed:
            return []
        odds = self.trees.predict(np.concatenate([features(p, self.odds) for p in parsed]))
        out, at = [], 0
        for p in parsed:
            out.append(blocks(p, decode(p.parent, odds[at : at + len(p.tag)])))
            at += len(p.tag)
        return out


#: Generated pages that the trees are fitted on.
PAGES = 500
SEED = 11


def sample_page(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A generated page and, for each of its elements in order, whether it holds main text."""
    html: list[str] = []
    truth: list[bool] = [True]
    # telling names, names of a layout that say nothing, or names in a language of the page's own
    style = str(rng.choice(["telling", "plain", "own"], p=[0.6, 0.25, 0.15]))
    own: dict[str, str] = {}

    def word():
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.integers(1, 4)))

    def sentence(n):
        return " ".join(word() for _ in range(n)).capitalize() + str(rng.choice([".", ".", ".", "!", "?", " |", "***"], p=[0.4, 0.2, 0.2, 0.05, 0.05, 0.05, 0.05]))

    def title():
        n = int(rng.integers(1, 7))
        return sentence(n) if rng.random() < 0.3 else " ".join(word() for _ in range(n)).capitalize()

    def prose(lo, hi):
        return " ".join(sentence(int(rng.integers(3, 15))) for _ in range(rng.integers(lo, hi)))

    def some(tokens):
        if style == "plain":
            return " ".join(str(rng.choice(_LAYOUT)) + str(rng.integers(1, 9)) for _ in range(rng.integers(1, 4)))
        if style == "own":
            return own.setdefault(tokens[0], "".join(rng.choice(_LETTERS) for _ in range(rng.integers(4, 11))))
        return str(rng.choice(tokens)) + ("-" + word() if rng.random() < 0.3 else "")

    def name(tokens, p=0.8):
        return f' {rng.choice(["class", "id", "class"])}="{some(tokens)}"' if rng.random() < p else ""

    def put(tag, keep, attributes="", inside=None, close=True):
        truth.append(keep)
        html.append(f"<{tag}{attributes}>")
        if isinstance(inside, str):
            html.append(inside)
        elif inside:
            inside()
        if close:
            html.append(f"</{tag}>")

    def links(n, keep=False, item="li"):
        for _ in range(n):
            text = " ".join(word() for _ in range(rng.integers(1, 4)))
            put(item, keep, "", lambda text=text: put("a", keep, f' href="/{word()}"', text))

    def bar(tag, n):
        """Links side by side or one below the other, without a list."""
        down = rng.random() < 0.5

        def inside():
            for _ in range(n):
                put("a", False, f' href="/{word()}"', " ".join(word() for _ in range(rng.integers(1, 3))).capitalize())
                put("br", False, close=False) if down else html.append(" | " if rng.random() < 0.3 else " ")

        put(tag, False, "", inside)

    def layout():
        """Everything in cells of a table."""

        def rows():
            if rng.random() < 0.8:
                put("tr", False, "", lambda: bar("td", int(rng.integers(2, 9))))

            def middle():
                if rng.random() < 0.7:
                    bar("td", int(rng.integers(2, 9)))
                put("td", True, "", article)
                if rng.random() < 0.3:
                    notice(["ad", "related", "sidebar"], "td")

            put("tr", True, "", middle)
            if rng.random() < 0.5:
                put("tr", False, "", lambda: put("td", False, "", "&copy; " + prose(1, 2)))

        put("table", True, "", rows)

    def menu(tag="nav", tokens=("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pager", "pagination", "toolbar", "skip")):
        put(tag, False, name(tokens, 0.4 if tag == "nav" else 1), lambda: put("ul", False, "", lambda: links(int(rng.integers(2, 12)))))

    def notice(tokens, tag="div", long=(1, 3)):
        if style != "telling" and tag == "div":
            return  # prose in a div without a telling name is text
        put(tag, False, name(tokens, 1), lambda: (put("p", False, "", prose(*long)) if rng.random() < 0.4 else html.append(prose(*long))))

    def form():
        def inside():
            put("label", False, "", word())
            put("input", False, ' type="text"', close=False)
            put("button", False, "", word())
        put("form", False, name(["search", "login", "newsletter", "subscribe", "signup", "form"], 0.5), inside)

    def comments():
        def listed():
            for _ in range(rng.integers(1, 7)):
                def entry():
                    put(str(rng.choice(["cite", "b", "strong", "span"])), False, "", word().capitalize())
                    put(str(rng.choice(["time", "small", "span"])), False, "", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1990, 2030)} {rng.integers(0, 24)}:{rng.integers(10, 60)}")
                    put("p", False, "", prose(1, 3))
                    if rng.random() < 0.5:
                        put("a", False, f' href="#{word()}"', word())
                put("li", False, name(["comment", "reply", "depth"], 0.5), entry)
        if rng.random() < 0.4 or style != "telling":
            if rng.random() < 0.5:
                put("h3", False, "", f"{rng.integers(1, 40)} {word()}")
            put("ol" if rng.random() < 0.6 else "ul", False, name(["commentlist", "comments", "comment-list", "children"], 0.7), listed)
            return

        def inside():
            put("h3", False, "", word())
            for _ in range(rng.integers(1, 6)):
                put("div" if rng.random() < 0.6 else "article", False, name(["comment", "reply"], 0.8), lambda: put("p", False, "", prose(1, 4)))
        put("section" if rng.random() < 0.5 else "div", False, name(["comments", "responses", "comment-list", "replies", "disqus", "discussion"], 1), inside)

    def paragraph():
        kind = rng.random()
        text = prose(1, int(rng.choice([2, 4, 9, 25])))
        if kind < 0.1:
            put("p", True, "", lambda: put("b", True, "", lambda: (html.append(text), put("br", True, "", close=False))), close=False)
        elif kind < 0.2:
            put("p", True, "", lambda: (html.append(text[: len(text) // 2]), put(str(rng.choice(["a", "em", "strong", "i"])), True, "", word()), html.append(text[len(text) // 2 :])))
        elif kind < 0.25:
            put("ul" if rng.random() < 0.5 else "ol", True, "", lambda: [put("li", True, "", prose(1, 3)) for _ in range(rng.integers(2, 6))])
        elif kind < 0.3:
            put("blockquote", True, "", lambda: put("p", True, "", text))
        elif kind < 0.34:
            put("h2", True, "", title())
        elif kind < 0.37:
            put("div", True, "", text)
        elif kind < 0.39:
            cells = lambda: (put("th", True, "", word().capitalize()), put("td", True, "", sentence(int(rng.integers(1, 5)))))
            put("table", True, name(["infobox", "data", "facts"], 0.5), lambda: [put("tr", True, "", cells) for _ in range(rng.integers(2, 6))])
        else:
            put("p", True, "", text if rng.random() < 0.8 else sentence(int(rng.integers(1, 4))))

    def article():
        if rng.random() < 0.25:
            put("header", False, "", lambda: put("p", False, name(["byline", "meta", "author"], 0.7), sentence(3)))
        if rng.random() < 0.92:
            put("h1", True, "", title())
        for _ in range(int(rng.choice([1, 1, 2, 4, 8, 20]))):
            paragraph()
            if rng.random() < 0.06:
                notice(["ad", "advert", "promo", "related", "share", "sponsored", "callout-ad", "newsletter"], str(rng.choice(["div", "aside"])))
        if rng.random() < 0.15:
            put("div", False, name(["share", "sharing", "social", "tags"], 1), lambda: links(int(rng.integers(2, 5)), item="span"))
        if style != "telling" and rng.random() < 0.3:
            bar("div", int(rng.integers(3, 8)))
        if rng.random() < 0.12:
            comments()
        if rng.random() < 0.1:
            put("footer", False, "", prose(1, 2))

    def last():
        mark = str(rng.choice(["&copy; ", "© ", "&copy; 20"])) + word()
        if style != "telling" and rng.random() < 0.7:
            inside = lambda: (html.append(f"{mark} {sentence(int(rng.integers(1, 6)))} "), [put("a", False, f' href="/{word()}"', word()) for _ in range(rng.integers(0, 5))])
            put("div", False, name(["footer"], 0.8), inside)
        elif rng.random() < 0.8:
            put("footer", False, name(["footer", "credits", "legal"], 0.5), f"{mark} {prose(1, 3)}")
        else:
            put("div", False, name(["footer", "disclaimer", "credits", "legal"], 1), prose(1, 3) if style == "telling" else f"{mark} {prose(1, 3)}")

    def body():
        if rng.random() < 0.3:
            notice(["cookie", "cookies", "consent", "notice", "alert", "banner", "gdpr", "overlay", "modal"])
        if rng.random() < 0.3:
            put("header", False, name(["header", "masthead", "logo"], 0.5), lambda: (put("h1", False, name(["logo"], 0.3), word()), menu() if rng.random() < 0.5 else None))
        if rng.random() < 0.8:
            menu(*([] if rng.random() < 0.7 else ["div"]))
        if rng.random() < 0.5:
            notice(["ad", "ads", "adv", "advert", "advertisement", "banner", "sponsor", "promo", "promoted", "tracking"])
        if rng.random() < 0.15:
            form()
        if rng.random() < 0.15:
            bar(str(rng.choice(["div", "p", "td", "center"])), int(rng.integers(2, 9)))
        wrap = rng.random()
        if wrap < 0.1:
            layout()
        elif wrap < 0.45:
            put("article", True, name(["post", "entry", "story", "article", "hentry"], 0.3), article)
        elif wrap < 0.6:
            put("main", True, "", lambda: put("article", True, "", article) if rng.random() < 0.5 else article())
        else:
            put("div", True, name(["content", "post-body", "entry-content", "main", "article-text", "story", "prose", "copy", "text", "body"], 0.9), article)
        if rng.random() < 0.3:
            put("aside", False, name(["sidebar", "related", "widget", "rss", "bar"], 0.7), lambda: (put("h3", False, "", word()), put("ul", False, "", lambda: links(int(rng.integers(2, 8))))) if rng.random() < 0.7 else html.append(prose(1, 3)))
        if rng.random() < 0.2:
            notice(["sidebar", "related", "widget", "popup", "newsletter", "social", "share"])
        if rng.random() < 0.25:
            comments()
        if rng.random() < 0.15:
            form()
        if rng.random() < 0.9:
            last()

    def head():
        put("meta", False, ' charset="utf-8"', close=False)
        put("title", False, "", word())
        if rng.random() < 0.5:
            put("style", False, "", f".{word()}{{{word()}:{rng.integers(0, 99)}px}}")
        if rng.random() < 0.5:
            put("script", False, "", f"var {word()} = {rng.integers(0, 99)}; {word()}();")

    put("html", True, "", lambda: (put("head", False, "", head), put("body", True, "", body)))
    return "<!DOCTYPE html>" + "".join(html), truth


#: Names that speak of looks only.
_LAYOUT = ("col-", "mt-", "px-", "w-", "flex-", "grid-", "row-", "text-", "css-", "sc-")
_LETTERS = list("abcdefghijklmnoprstuvwz")
_SYLLABLES = ["an", "be", "ca", "do", "el", "fi", "go", "hu", "in", "jo", "ka", "lu", "mi", "no", "ou", "pe", "qui", "re", "so", "tri", "un", "ve", "wa", "xi", "yo", "zu", "THE", "é", "ß", "ñ"]


@lru_cache(maxsize=1)
def fitted() -> Model:
    """The model, fitted once per driver process; the same arrays every time."""
    rng = np.random.default_rng(SEED)
    pages, truths = [], []
    for _ in range(PAGES):
        html, truth = sample_page(rng)
        page = parse(html)
        if len(page.tag) != len(truth):
            raise AssertionError("generated page and its truth differ in elements")
        pages.append(page)
        truths.append(truth)
    odds = token_odds(pages, truths)
    x = np.concatenate([features(p, odds) for p in pages])
    return Model(boost(x, np.concatenate(truths).astype(float)), odds)


@keeping
def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``page_id``, the columns in ``keep``, ``text`` and ``n_chars`` for every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), *keep, F.col(html_col).cast("string").alias("_html"))
    fields = [f for f in rows.schema.fields if f.name != "_html"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string"])
    model = fitted()

    def run(batches):
        extractor = Extractor(model)
        for batch in batches:
            html = batch.column("_html").fill_null("")
            texts: list[str] = []
            for at in range(0, len(html), 32):
                texts += extractor.texts(html[at : at + 32].to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(texts, pa.string())], names=[*(f.name for f in fields), "text"])

    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
