"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the trees are fitted on, by a hash of the id, and the bytes of html in all.
SAMPLE_PAGES, SAMPLE_BYTES = 160, 4 << 20
#: A node stands above the article, belongs to it, or is cut with all below it.
OUTER, INSIDE, CUT = 0, 1, 2
ROUNDS, LEVELS, BINS, RATE = 24, 4, 16, 0.3
_CHUNK = 2 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes xmp".split())
#: Left out from the mark to its own end mark; a mark without one is nothing, and the page goes on behind it.
ENCLOSED = frozenset("template svg math object audio video canvas".split())
_ENCLOSED = re.compile(r"<(/?)(template|svg|math|object|audio|video|canvas)\b((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var label wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME_LEVEL = {"li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr td th", "table"),
              "td": ("td th", "table tr"), "th": ("td th", "table tr"), "option": ("option", "select")}
SAME_LEVEL = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SAME_LEVEL.items()}
#: Tags with a feature of their own; every other tag shares the last one.
TAG_GROUPS = ("html", "body", "article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol menu dl li dt dd",
              "table tbody thead tfoot tr td th caption", "nav", "header", "footer", "aside", "form fieldset input select button label "
              "option", "blockquote pre figure figcaption", "head")
#: Words of class, id and role attributes, group by group.
WORD_GROUPS = (
    "article post entry story content main body text page",
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion promoted",
    "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc tabs",
    "header masthead branding topbar site logo", "footer copyright legal bottom colophon contentinfo",
    "sidebar side aside rail widget widgets complementary secondary",
    "comment comments reply replies disqus respond discussion thread reader readers feedback",
    "cookie cookies consent notice notices gdpr alert popup modal overlay privacy banner warning",
    "form newsletter subscribe signup login search register contact", "share sharing social follow buttons tools print",
    "related recommended more popular trending latest tags teaser links", "hidden skip print meta byline author")
_TAG = {t: k for k, group in enumerate(TAG_GROUPS) for t in group.split()}
_WORD_BITS: dict[str, int] = {}
for _k, _group in enumerate(WORD_GROUPS):
    for _w in _group.split():
        _WORD_BITS[_w] = _WORD_BITS.get(_w, 0) | 1 << _k
_MARK = re.compile(r"<(?:!--.*?(?:-->|\Z)|([!?/]?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|data-state)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOP = re.compile(r"[.,;:!?]")
_seen_attributes: dict[str, tuple[int, str]] = {}


def _attributes(raw: str) -> tuple[int, str]:
    """(word groups named by class, id and role; the label of a training page)."""
    found = _seen_attributes.get(raw)
    if found is None:
        bits, state = 0, ""
        for name, *values in _ATTRIBUTE.findall(raw):
            value = "".join(values)
            if name.lower() == "data-state":
                state = value
            else:
                for w in _WORDS.findall(value):
                    bits |= _WORD_BITS.get(w.lower(), 0)
        if len(_seen_attributes) > 20_000:
            _seen_attributes.clear()
        found = _seen_attributes[raw] = (bits, state)
    return found


def _enclosed(source: str) -> dict[int, int]:
    """Where each enclosed element that is closed begins and ends; elements may be nested."""
    ends, open_at = {}, {}
    for m in _ENCLOSED.finditer(source):
        at = open_at.setdefault(m[2].lower(), [])
        if m[1]:
            if at:
                ends[at.pop()] = m.end()
        elif not m[3].endswith("/"):
            at.append(m.start())
    return ends


@dataclass
class Nodes:
    """The nodes of many pages, parents before children, and the texts between the marks in page order."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    state: list[str] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)  # (node, text); node -1 is the edge of a block
    size: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    first_text: list[int] = field(default_factory=list)

    def _node(self, page: int, parent: int, tag: str, words: int, state: str) -> int:
        self.page.append(page)
        self.parent.append(parent)
        self.tag.append(_TAG.get(tag, len(TAG_GROUPS)))
        self.words.append(words)
        self.state.append(state)
        self.size.append(0)
        self.linked.append(0)
        self.stops.append(0)
        return len(self.page) - 1

    def add(self, page: int, source: str) -> None:
        """Parse one page. Tags may be unclosed or crossed; scripts, styles and other raw elements leave no text."""
        self.first_text.append(len(self.texts))
        root = self._node(page, -1, "html", 0, "")
        stack: list[tuple[str, int]] = [("", root)]  # (tag, node that its text belongs to)
        links, at, texts, ends = 0, 0, self.texts, None
        while True:
            mark = _MARK.search(source, at)
            stop = mark.start() if mark else len(source)
            if stop > at:
                text = source[at:stop]
                if "&" in text:
                    text = entities.unescape(text)
                if not text.isspace():
                    node = stack[-1][1]
                    self.size[node] += len(text)
                    self.stops[node] += len(_STOP.findall(text))
                    if links:
                        self.linked[node] += len(text)
                texts.append((stack[-1][1], text))
            if mark is None:
                return
            at = mark.end()
            kind, tag, raw = mark.groups()
            if tag is None or kind in ("!", "?"):
                if at == stop:
                    at += 1
                continue
            tag = tag.lower()
            inline = tag in INLINE
            if not inline:
                texts.append((-1, " "))
            if kind == "/":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        links -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                        break
                    if inline and stack[k][0] not in INLINE:
                        break
                continue
            if tag in RAW:
                if not raw.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if tag in ENCLOSED:
                if ends is None:
                    ends = _enclosed(source)
                at = ends.get(mark.start(), at)
                continue
            if tag in CLOSES_P:
                self._close(stack, frozenset(("p",)), frozenset(("table", "button")))
            elif tag in SAME_LEVEL:
                self._close(stack, *SAME_LEVEL[tag])
            words, state = _attributes(raw) if raw else (0, "")
            if tag in VOID:
                continue
            node = stack[-1][1]
            if tag == "html" or (tag == "a" and any(t == "a" for t, _ in stack)):
                continue
            if not inline or words or state:
                node = self._node(page, node, tag, words, state)
            links = sum(t == "a" for t, _ in stack) + (tag == "a")
            stack.append((tag, node))

    @staticmethod
    def _close(stack: list[tuple[str, int]], closing: frozenset, scope: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in closing:
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    def levels(self) -> list[np.ndarray]:
        """Node numbers by depth."""
        depth = []
        for p in self.parent:  # parents come first
            depth.append(depth[p] + 1 if p >= 0 else 0)
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if depth else []

    def features(self, levels: list[np.ndarray]) -> np.ndarray:
        """Tag, attribute words, those of the ancestors, depth, and text and sibling statistics of subtrees."""
        n, parent = len(self.page), np.array(self.parent)
        own = np.stack([self.size, self.linked, self.stops, np.ones(n)], axis=1).astype(np.float64)
        below = own.copy()
        depth = np.zeros(n)
        bits = np.left_shift(1, np.array(self.tag, dtype=np.int64)) | np.left_shift(np.array(self.words, dtype=np.int64), 20)
        above = np.zeros(n, dtype=np.int64)
        for k, rows in enumerate(levels[1:], 1):
            depth[rows] = k
            above[rows] = above[parent[rows]] | bits[parent[rows]]
        for rows in levels[:0:-1]:
            np.add.at(below, parent[rows], below[rows])
        up = np.maximum(parent, 0)
        children = np.bincount(parent[parent >= 0], minlength=n)
        nth = np.zeros(n)
        kids = np.nonzero(parent >= 0)[0]
        kids = kids[np.argsort(parent[kids], kind="stable")]
        if len(kids):
            starts = np.append(True, parent[kids][1:] != parent[kids][:-1])
            nth[kids] = np.arange(len(kids)) - np.maximum.accumulate(np.where(starts, np.arange(len(kids)), 0))
        largest = np.zeros(n)
        np.maximum.at(largest, up[kids], below[kids, 0])
        roots = np.zeros(max(self.page, default=0) + 1)
        roots[np.array(self.page)[parent < 0]] = below[parent < 0, 0]
        size, linked, stops, nodes = below.T
        numbers = [depth, np.log1p(own[:, 0]), np.log1p(size), linked / np.maximum(size, 1), stops / np.maximum(size, 1),
                   size / nodes, children, children[up], nth / np.maximum(children[up], 1), size / np.maximum(below[up, 0], 1),
                   size / np.maximum(roots[np.array(self.page)], 1), size / np.maximum(largest[up], 1)]
        every = len(TAG_GROUPS) + 1
        flags = [(b >> k) & 1 for b in (bits, above) for k in (*range(every), *range(20, 20 + len(WORD_GROUPS)))]
        return np.stack([*numbers, *flags], axis=1).astype(np.float32)

    def decoded(self, log_p: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """The most likely states that agree along the tree: outer nodes may hold anything, the article holds itself
        and cuts, a cut holds only cuts, and a root is outer."""
        parent = np.array(self.parent)
        best = log_p.copy()  # of each subtree, by the state of its top
        choices = []
        for rows in levels[:0:-1]:
            b = best[rows]
            outer = b.argmax(axis=1)
            inside = np.where(b[:, INSIDE] >= b[:, CUT], INSIDE, CUT)
            picked = np.stack([outer, inside, np.full(len(rows), CUT)], axis=1)
            choices.append(picked)
            np.add.at(best, parent[rows], np.take_along_axis(b, picked, axis=1))
        state = np.zeros(len(parent), dtype=np.int64)
        for rows, picked in zip(levels[1:], choices[::-1], strict=True):
            state[rows] = picked[np.arange(len(rows)), state[parent[rows]]]
        return state

    def main_texts(self, state: np.ndarray) -> list[str]:
        keep = (state == INSIDE).tolist()
        out = []
        for a, b in zip(self.first_text, [*self.first_text[1:], len(self.texts)], strict=True):
            out.append(" ".join("".join([t for node, t in self.texts[a:b] if node < 0 or keep[node]]).split()))
        return out


@dataclass
class Trees:
    """Boosted trees for three classes over binned features; a split sends bins above its cut to the right."""

    edges: list[np.ndarray]
    start: np.ndarray
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray
    leaf: np.ndarray  # (trees, leaves); tree k is of class k % 3

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        rows = np.arange(len(x))
        z = np.tile(self.start, (len(x), 1))
        for k in range(len(self.leaf)):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (bins[rows, self.feature[k, at]] > self.cut[k, at])
            z[:, k % 3] += self.leaf[k, at - (2 ** LEVELS - 1)]
        return z - np.logaddexp.reduce(z, axis=1, keepdims=True)


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of softmax loss, level by level over histograms."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(np.unique(c)) > 2 else np.array([0.5]) for c in x.T]
    share = (np.bincount(y, minlength=3) + 1) / (len(y) + 3)
    trees = Trees(edges, np.log(share), np.zeros((0, 2 ** LEVELS - 1), int), np.zeros((0, 2 ** LEVELS - 1), int), np.zeros((0, 2 ** LEVELS)))
    bins = trees.binned(x)
    n, many = bins.shape
    spot = bins + BINS * np.arange(many)
    z = np.tile(trees.start, (n, 1))
    found = []
    for _ in range(ROUNDS):
        p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        for k in range(3):
            g, h = p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            at = np.zeros(n, dtype=np.int64)
            feature, cut = np.zeros(2 ** LEVELS - 1, int), np.full(2 ** LEVELS - 1, BINS)
            for level in range(LEVELS):
                width = 2 ** level
                where = ((at - (width - 1))[:, None] * (many * BINS) + spot).ravel()
                shape = (width, many, BINS)
                gs = np.bincount(where, np.repeat(g, many), width * many * BINS).reshape(shape).cumsum(axis=2)
                hs = np.bincount(where, np.repeat(h, many), width * many * BINS).reshape(shape).cumsum(axis=2)
                ga, ha = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs ** 2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga ** 2 / (ha + 1)
                flat = gain.reshape(width, -1)
                pick = flat.argmax(axis=1)
                for node in range(width):
                    if flat[node, pick[node]] > 1e-6:
                        feature[width - 1 + node], cut[width - 1 + node] = divmod(int(pick[node]), BINS)
                at = 2 * at + 1 + (bins[np.arange(n), feature[at]] > cut[at])
            last = at - (2 ** LEVELS - 1)
            leaf = -RATE * np.bincount(last, g, 2 ** LEVELS) / (np.bincount(last, h, 2 ** LEVELS) + 1)
            z[:, k] += leaf[last]
            found.append((feature, cut, leaf))
    trees.feature, trees.cut, trees.leaf = (np.array(c) for c in zip(*found, strict=True))
    return trees


_OWN_LABELS = {"article": INSIDE, "main": INSIDE, "nav": CUT, "header": CUT, "footer": CUT, "aside": CUT, "form": CUT}


def _labels(nodes: Nodes) -> np.ndarray:
    """States of training nodes: written ones, else those of semantic tags and of advert or comment attributes, else
    the parent's."""
    names = {_TAG[t]: s for t, s in _OWN_LABELS.items()}
    bad = sum(1 << k for k in (1, 6, 7))
    out = []
    for parent, tag, words, state in zip(nodes.parent, nodes.tag, nodes.words, nodes.state, strict=True):
        above = out[parent] if parent >= 0 else OUTER
        if above == CUT:
            out.append(CUT)
        elif state:
            out.append({"out": OUTER, "in": INSIDE, "cut": CUT}[state])
        elif names.get(tag) == CUT or (words & bad and not words & 1):
            out.append(CUT)
        elif names.get(tag) == INSIDE and above == OUTER:
            out.append(INSIDE)
        else:
            out.append(above)
    return np.array(out, dtype=np.int64)


def _decorated(rng: np.random.Generator, blocks: list[str]) -> str:
    """A training page of other build: sampled text in layouts with every kind of clutter, each part labelled."""

    def some(lo: int, hi: int) -> list[str]:
        return [blocks[i] for i in rng.integers(0, len(blocks), rng.integers(lo, hi))]

    def pick(*names: str) -> str:
        return names[rng.integers(len(names))]

    def short(text: str) -> str:
        return " ".join(text.split()[:int(rng.integers(2, 12))])

    def part(tag: str, attr: str, state: str, body: str) -> str:
        return f'<{tag} {attr} data-state="{state}">{body}</{tag}>'

    def clutter() -> str:
        kind = rng.integers(11)
        links = "".join(f"<li><a href=/x>{short(t)}</a></li>" for t in some(3, 9))
        prose = "".join(f"<p>{t}</p>" for t in some(1, 4))
        if kind == 0:
            return part(pick("div", "aside", "section"), f'class="{pick("ad", "ads", "advert", "ad-slot", "banner-ad", "sponsored", "promo")}"', "cut", pick(prose, short(prose)))
        if kind == 1:
            return part(pick("nav", "div", "ul"), f'class="{pick("menu", "navbar", "breadcrumb", "nav", "pagination")}"', "cut", f"<ul>{links}</ul>")
        if kind == 2:
            return part(pick("header", "div"), f'id="{pick("header", "masthead", "top-header", "site-header")}"', "cut", f"<h2>{short(prose)}</h2><p>{short(prose)}</p>")
        if kind == 3:
            return part(pick("footer", "div"), f'class="{pick("footer", "site-footer", "copyright")}"', "cut", f"<p>&copy; {short(prose)}</p>{pick('', links)}")
        if kind == 4:
            return part(pick("aside", "div"), f'class="{pick("sidebar", "side", "widget", "right-rail")}"', "cut", f"<h3>{short(prose)}</h3>{pick(prose, links)}")
        if kind == 5:
            each = "".join(f'<{pick("div", "li", "article")} class="{pick("comment", "reply", "comment-body")}"><p>{t}</p></div>' for t in some(1, 6))
            return part(pick("section", "div", "ol"), f'{pick("id", "class")}="{pick("comments", "comment-list", "disqus_thread", "reader-comments", "discussion")}"', "cut", f"<h3>{short(prose)}</h3>{each}")
        if kind == 6:
            return part(pick("div", "section", "aside"), f'class="{pick("cookie-notice", "notice", "consent", "gdpr", "alert", "popup")}"', "cut", f"<p>{pick(short(prose), prose)}</p><button>{short(prose)}</button>")
        if kind == 7:
            return part("form", f'class="{pick("newsletter", "signup", "search-form", "f")}"', "cut", f"<p>{short(prose)}</p><label>{short(prose)}</label><input name=q><button>{short(prose)}</button>")
        if kind == 8:
            return part(pick("div", "ul"), f'class="{pick("share", "social", "share-buttons", "follow")}"', "cut", links)
        if kind == 9:
            return part(pick("div", "section"), f'class="{pick("related", "recommended", "more-stories", "popular", "trending")}"', "cut", f"<h3>{short(prose)}</h3>{links}")
        return part(pick("nav", "header", "footer", "aside"), "", "cut", pick(links, prose))

    inner = [pick(f"<h1>{short(blocks[0])}</h1>", f"<h2>{short(blocks[0])}</h2>", "")]
    for t in some(2, 14):
        inner.append(pick(*[f"<p>{t}</p>"] * 6, f"<h2>{short(t)}</h2>", f"<ul><li>{short(t)}</li><li>{t}</li></ul>", f"<blockquote><p>{t}</p></blockquote>",
                          f"<div>{t}</div>", f"<p><a href=/y>{short(t)}</a> {t}</p>", f"<table><tr><td>{short(t)}</td><td>{short(t)}</td></tr></table>",
                          f"<figure><figcaption>{short(t)}</figcaption></figure>", f"<pre>{t}</pre>", f"<section><h3>{short(t)}</h3><p>{t}</p></section>", f"<p>{short(t)}</p>"))
        if rng.random() < 0.12:
            inner.append(clutter())
    tag, attr = pick(*[("article", "")] * 3, ("article", 'class="post"'), ("div", 'class="post-content"'), ("div", 'id="content"'), ("main", ""),
                     ("div", 'class="article-body"'), ("section", 'class="story"'), ("div", 'class="entry-content"'), ("div", 'role="main"'))
    body = part(tag, attr, "in", "".join(inner))
    if rng.random() < 0.3:
        body = part("div", f'class="{pick("wrapper", "container", "page", "layout", "main-column")}"', "out", "".join(clutter() for _ in range(rng.integers(0, 3))) + body + "".join(clutter() for _ in range(rng.integers(0, 3))))
    return (f"<html><body>{''.join(clutter() for _ in range(rng.integers(1, 5)))}{body}"
            f"{''.join(clutter() for _ in range(rng.integers(1, 5)))}</body></html>")


def fit(pages: list[str], seed: int = 10) -> Trees:
    """Trees over the sampled pages, whose semantic tags label them, and twice as many rebuilt from their text."""
    rng = np.random.default_rng(seed)
    nodes = Nodes()
    blocks = []
    for p in pages:
        nodes.add(len(nodes.first_text), p)
        blocks += [" ".join(t.split()) for _, t in nodes.texts[nodes.first_text[-1]:] if len(t) > 40]
    blocks = [entities.escape(t) for t in blocks[:20_000]] or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    for _ in range(2 * len(pages) or 100):
        nodes.add(len(nodes.first_text), _decorated(rng, [blocks[i] for i in rng.integers(0, len(blocks), 40)]))
    return boosted(nodes.features(nodes.levels()), _labels(nodes))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Trees:
    """Trees fitted on SAMPLE_PAGES pages by a hash of their id, less those that do not fit into SAMPLE_BYTES with the
    ones before them. Of the rows of one id, the least html counts."""
    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).where("html is not null")
    drawn = (narrow.groupBy("id").agg(F.max(F.octet_length("html")).alias("size")).where("id is not null")
             .orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PAGES).collect())
    ids, room = [], SAMPLE_BYTES
    for row in drawn:
        if row["size"] <= room:
            ids.append(row["id"])
            room -= row["size"]
    rows = narrow.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("html").alias("html")).orderBy(F.xxhash64("id"), "id").collect() if ids else []
    return fit([row["html"] for row in rows])


def extract(sources: list[str | None], trees: Trees) -> list[str]:
    out: list[str] = []
    nodes, held = Nodes(), 0
    for k, source in enumerate(sources):
        nodes.add(len(nodes.first_text), source or "")
        held += len(source or "")
        if held > _CHUNK or k + 1 == len(sources):
            levels = nodes.levels()
            out += nodes.main_texts(nodes.decoded(trees.log_odds(nodes.features(levels)), levels))
            nodes, held = Nodes(), 0
    return out


def main_texts(pages: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars. Null and empty html give an empty text; pages without any node that
    reads like an article, too. Rows without an id and repeated rows are read like others; nothing is shuffled. A very
    long page is read whole in its task; an empty table gives no rows. Unclosed elements hide nothing but what HTML lets
    them hide (scripts, styles, frames, titles, text areas)."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                texts = extract(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                          F.col(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
