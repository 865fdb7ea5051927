"""Text fragments of HTML pages, picked by per-source selectors.

Only what needs the document tree happens here, in one Arrow function. Pages of plain markup are cut
into tags by one pattern; a page with anything else is read by the standard library's parser, with the
same elements and texts. It hands back named lists of text; all further parsing is Spark expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser
from operator import attrgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset(("script", "style", "template"))
# An opening tag of the key ends an open element of the value.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",),
        "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}
LISTS = frozenset(("ul", "ol", "dl", "table"))
CELLS = frozenset(("tr", "td", "th"))

FRAGMENTS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

# Markup that leaves nothing to tolerate. A "<" outside of it sends the page to the tolerant parser.
_BLANK = r"[ \t\n\r\f]"
_VALUE = rf"""(?:"([^"<>]*)"|'([^'<>]*)'|([-\w.:\#%]+)(?={_BLANK}|>|\Z))"""
_ATTRIBUTE = re.compile(rf"{_BLANK}([a-z][-\w.:]*)(?:={_VALUE})?", re.A | re.I)
_ATTRIBUTES = "((?:" + rf"{_BLANK}+[a-z][-\w.:]*(?:={_VALUE})?".replace("(", "(?:").replace("(?:?", "(?") + f")*){_BLANK}*"
_COMMENT = r"!--(?!-?>)[^-]*(?:-(?!-)[^-]*)*-->"
_UNSEEN = r"[^<]*(?:<(?!/?\s*(?:script|style)|!--)[^<]*)*"  # what an element that hides its text may hold
_TAG = re.compile(
    rf"<(?:(script|style){_ATTRIBUTES}>{_UNSEEN}</\1{_BLANK}*>"
    rf"|(/?)([a-z][-\w:]*){_ATTRIBUTES}(/?)>"
    rf"|{_COMMENT}|!doctype[^<>]*>)", re.A | re.I)
#: Cuts a page before and after every mark; whether a mark is plain is asked of _TAG, once per different mark.
_CUT = re.compile(rf"(<(?:(?![!s])[^<>]*>|{_COMMENT}|script[^<>]*>{_UNSEEN}</script{_BLANK}*>|style[^<>]*>{_UNSEEN}</style{_BLANK}*>|[^<>]*>))", re.A | re.I)
_CLASS = re.compile(rf"""{_BLANK}*class="([^"<>&]*)"{_BLANK}*""")
#: Marks kept per batch of pages; beyond that their list starts anew.
MARKS = 20_000
#: Elements whose content parsers take for text in different ways; plain if it is text up to their own end.
RAW = frozenset("script style title textarea xmp iframe noembed noframes plaintext".split())


@dataclass(frozen=True)
class Pick:
    """Which elements feed a slot, and how.

    selectors: "tag.class.class" steps separated by blanks (a class may be negated with "!", an
    id is written "#id"). take: "first" element of the first selector that hits, "any" to skip
    empty hits as well, "all" elements of every selector, "each" the first element of every
    selector, "all_first" of the first that hits.
    text: "tight", "spaced" or "raw"; "@name" for an attribute; "price" for the first
    piece of text with a dollar amount, from the element on.
    """

    selectors: tuple[str, ...]
    take: str = "first"
    text: str = "spaced"


class _Mark:
    """What a tag says, shared by all elements that it opens: name, classes, attributes, and the wanted steps it fits."""

    __slots__ = ("tag", "classes", "given", "keys", "asked", "ends", "bars", "stays", "unread")

    def __init__(self, tag, given, rules):
        self.tag, self.given, self.classes = tag, given, ()
        if given:
            alone = _CLASS.fullmatch(given) if isinstance(given, str) else None
            if alone is not None:
                self.classes = alone[1].split()
            elif not isinstance(given, str) or "class" in given.lower():
                self.classes = (self.attrs.get("class") or "").split()
        # tags that differ in other attributes only fit the same steps
        same = (tag, *self.classes, None, self.attrs.get("id") if rules.ids and given else None)
        known = rules.fits.get(same)
        if known is None:
            keys = tuple(key for step, key in rules.wanted.items() if _fits(self, step))
            known = keys, bool(keys) or any(_fits(self, step) for step in rules.above)
            if len(rules.fits) < MARKS:
                rules.fits[same] = known
        #: The steps it fits, and whether any rule can ask for such an element, be it as an ancestor of another.
        self.keys, self.asked = known
        self.ends, self.bars = ENDS.get(tag, ()), () if tag in CELLS else LISTS
        self.stays, self.unread = tag not in VOID, tag in UNREAD

    @property
    def attrs(self) -> dict[str, str]:
        """The attributes, read from their text when first asked for."""
        if isinstance(self.given, str):
            self.given = {
                name.lower(): unescape(one + two + bare) for name, one, two, bare in _ATTRIBUTE.findall(self.given)}
        return self.given


class _Element:
    # start/end bound the text pieces, first/last the numbers of the elements inside, of those asked for; so is the parent
    __slots__ = ("mark", "parent", "start", "end", "first", "last")


class _Marks(dict):
    """What every different tag of plain markup means: its name and its mark, None for an end tag; whether it closes
    itself, whether its content is text, and whether it just opens an element that no rule asks for and that ends no
    other. The name is empty where nothing begins or ends, the whole None where the markup is not plain."""

    def __init__(self, rules):
        super().__init__()
        self.rules = rules

    def __missing__(self, text):
        if len(self) >= MARKS:
            self.clear()
        self[text] = meant = self._meant(_TAG.fullmatch(text))
        return meant

    def _meant(self, found):
        if found is None:
            return None
        hidden, kept, slash, name, attrs, closed = found.groups()
        if hidden:
            return hidden.lower(), _Mark(hidden.lower(), kept, self.rules), True, False, False
        if name is None:
            return "", None, False, False, False
        tag = name.lower()
        if slash:
            return tag, None, False, False, False
        if tag in RAW and (closed or tag in ("script", "style", "plaintext")):
            return None
        mark = _Mark(tag, attrs, self.rules)
        simple = not (mark.asked or mark.ends or mark.unread or closed or tag in RAW) and mark.stays
        return tag, mark, bool(closed), tag in RAW, simple


class _Tolerant(HTMLParser):
    """Hands the events of any markup to a page."""

    def __init__(self, page: _Page):
        super().__init__(convert_charrefs=True)
        self.handle_endtag, self.handle_data, self.page = page.end, page.data, page

    def handle_starttag(self, tag, attrs):
        self.page.begin(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.page.end(tag)


class _Page:
    """Elements in document order; the text of one is a slice of the page's text pieces. Only elements that some rule
    asks for are listed, by the steps that they fit."""

    def __init__(self, html: str, rules: _Rules | None = None):
        self.rules = rules or _Rules({"slots": {}})
        self._clear()
        if not self._read_plain(html):
            self._clear()
            parser = _Tolerant(self)
            parser.feed(html)
            parser.close()
        if self.open:
            self._shut(0)

    def _clear(self):
        # the names of the open elements, the elements as far as asked for, and those alone
        self.open, self.held, self.asked = [], [], []
        self.count, self.pieces, self.fitting = 0, [], [[] for _ in self.rules.wanted]
        self.unread = False  # whether any element has begun whose text is not read

    def _read_plain(self, html: str) -> bool:
        """Whether the page was plain markup and has been read."""
        parts = _CUT.split(html)
        texts = parts[::2]
        if "<" in "".join(texts):
            return False
        marks, pieces, opened, held, asked = self.rules.marks, self.pieces, self.open, self.held, self.asked
        raw = None
        for text, tag in zip(texts, parts[1::2], strict=False):
            if text:
                if "&" in text:
                    if raw is not None and raw not in ("title", "textarea"):
                        return False
                    text = unescape(text)
                if not self.unread or not (opened and opened[-1] in UNREAD):
                    pieces.append(text)
            meant = marks[tag]
            if meant is None:
                return False
            tag, mark, closed, textual, simple = meant
            if raw is not None:
                if mark is not None or tag != raw:
                    return False
                raw = None
            if simple:
                opened.append(tag)
                held.append(None)
            elif mark is None:
                if opened and opened[-1] == tag:
                    opened.pop()
                    top = held.pop()
                    if top is not None:
                        asked.pop()
                        top.end, top.last = len(pieces), self.count
                elif tag:
                    self.end(tag)
            else:
                self._open(mark)
                if closed and mark.stays:
                    self.end(tag)
                if textual:
                    raw = tag
        if texts[-1] and not (opened and opened[-1] in UNREAD):
            pieces.append(unescape(texts[-1]))
        return raw is None

    def _shut(self, at):
        """Ends the open elements from a place on."""
        for top in self.held[at:]:
            if top is not None:
                self.asked.pop()
                top.end, top.last = len(self.pieces), self.count
        del self.open[at:], self.held[at:]

    def _open(self, mark):
        opened = self.open
        for name in mark.ends:
            if name in opened:
                self._close_for(mark)
                break
        element = None
        if mark.asked:
            self.count += 1
            element = _Element()
            element.mark, element.parent = mark, self.asked[-1] if self.asked else None
            element.start = element.end = len(self.pieces)
            element.first = element.last = self.count
            for key in mark.keys:
                self.fitting[key].append(element)
        if mark.stays:
            opened.append(mark.tag)
            self.held.append(element)
            if element is not None:
                self.asked.append(element)
            if mark.unread:
                self.unread = True

    def _close_for(self, mark):
        """Ends the element that an opening tag ends, if it is open in the same list or row."""
        at = len(self.open)
        while at:
            at -= 1
            own = self.open[at]
            if own in mark.bars:
                break
            if own in mark.ends:
                self._shut(at)
                break

    def begin(self, tag, given):
        self._open(_Mark(tag, given, self.rules))

    def end(self, tag):
        if tag in self.open:
            at = len(self.open) - 1
            while self.open[at] != tag:
                at -= 1
            self._shut(at)

    def data(self, text):
        if not (self.open and self.open[-1] in UNREAD):
            self.pieces.append(text)

    def text(self, element, how: str) -> str:
        if how[0] == "@":
            return element.mark.attrs.get(how[1:], "")
        if how == "price":  # the first amount from the element's own text on
            return next((p for p in self.pieces[element.start:] if "$" in p and any(map(str.isdigit, p))), "")
        pieces = self.pieces[element.start:element.end]
        if how == "raw":
            return "".join(pieces)
        if len(pieces) == 1:
            return pieces[0].strip()
        stripped = [s for s in (p.strip() for p in pieces) if s]
        return ("" if how == "tight" else " ").join(stripped)

    def select(self, chain: _Chain) -> list[_Element]:
        near = self.fitting[chain.key]
        return [e for e in near if _inside(e, chain.above)] if near and chain.above else near

    def within(self, ancestor, chain: _Chain) -> list[_Element]:
        """The same, inside of an element."""
        near = self.select(chain)
        low = bisect_right(near, ancestor.first, key=_number)
        return near[low:bisect_right(near, ancestor.last, low, key=_number)]


_number = attrgetter("first")


class _Step(NamedTuple):
    tags: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    id: str | None = None


class _Chain(NamedTuple):
    """A selector: the number of its last step among those that pages list their elements by, and the steps above."""

    key: int
    above: tuple[_Step, ...] = ()


def _steps(selector: str) -> tuple[_Step, ...]:
    steps = []
    for step in selector.split():
        if step.startswith("#"):
            steps.append(_Step(id=step[1:]))
            continue
        tag, *names = step.split(".")
        has, without = (tuple(c.removeprefix("!") for c in names if c.startswith("!") == no) for no in (False, True))
        steps.append(_Step((tag,) if tag else (), has, without))
    return tuple(steps)


def _fits(mark: _Mark, step: _Step) -> bool:
    if step.id is not None:
        return bool(mark.given) and mark.attrs.get("id") == step.id
    if step.tags and mark.tag not in step.tags:
        return False
    return all(c in mark.classes for c in step.classes) and not any(c in mark.classes for c in step.without)


def _inside(element: _Element, steps: tuple[_Step, ...]) -> bool:
    at = element.parent
    for step in reversed(steps):
        while at is not None and not _fits(at.mark, step):
            at = at.parent
        if at is None:
            return False
        at = at.parent
    return True


class _Rules:
    """A spec with its selectors cut into steps, and the tags met so far. "wanted" in a spec names the slots that are read
    at all; without it all are."""

    def __init__(self, spec: dict):
        asked = spec.get("wanted")

        def wanted(*slots):
            return asked is None or any(slot in asked for slot in slots)

        self.wanted: dict[_Step, int] = {}
        self.above: set[_Step] = set()
        self.slots = [(slot, pick.take, pick.text, [self._chain(_steps(s)) for s in pick.selectors])
                      for slot, pick in spec["slots"].items() if wanted(slot)]
        self.pairs, self.page_text = wanted("labels", "values"), wanted("page_text")
        self.rows_and_items = self.pairs and bool(spec.get("rows_and_items"))
        if self.pairs:
            self.lists = [self._chain(_steps(f"{container} dl")) for container in (*spec.get("pairs_in", ()), "")]
            self.term, self.value = self._chain((_Step(("dt",)),)), self._chain((_Step(("dd",)),))
        if self.rows_and_items:
            self.row, self.cell, self.item = (self._chain((_Step(tags),)) for tags in (("tr",), ("td", "th"), ("li",)))
        self.attributes = [(slot, names, self._chain(_steps(tag)), key, attr)
                           for slot, (names, tag, key, attr) in spec.get("attributes", {}).items() if wanted(slot)]
        self.ids = any(step.id is not None for step in (*self.wanted, *self.above))
        self.marks, self.fits = _Marks(self), {}

    def _chain(self, steps: tuple[_Step, ...]) -> _Chain:
        self.above.update(steps[:-1])
        return _Chain(self.wanted.setdefault(steps[-1], len(self.wanted)), steps[:-1])


def _picked(page: _Page, take: str, how: str, selectors: list[_Chain]) -> list[str]:
    out: list[str] = []
    for chain in selectors:
        hits = page.select(chain)
        if not hits:
            continue
        if how[0] == "@":
            hits = [e for e in hits if e.mark.given and how[1:] in e.mark.attrs]
        if take in ("each", "first"):
            hits = hits[:1]
        texts = [page.text(e, how) for e in hits]
        if take == "all":
            out += texts
        elif take == "each":
            out += texts[:1]
        elif texts and take == "first":
            return texts[:1]
        elif take == "any" and texts and texts[0]:
            return texts[:1]
        elif take == "all_first" and any(texts):
            return texts
    return out


def _pairs(page: _Page, rules: _Rules) -> tuple[list[str], list[str]]:
    """Label and value lists: dt/dd pairs (within the preferred container when it has any), and
    where wanted also table rows and "Label: Value" items, in this order of precedence."""
    found: list[tuple[str, str]] = []
    for chain in rules.lists:
        for dl in page.select(chain):
            terms = [page.text(e, "tight") for e in page.within(dl, rules.term)]
            values = [page.text(e, "tight") for e in page.within(dl, rules.value)]
            found += zip(terms, values)
        if found:
            break
    if rules.rows_and_items:
        for row in page.select(rules.row):
            cells = page.within(row, rules.cell)
            if len(cells) > 1:
                found.append((page.text(cells[0], "tight"), page.text(cells[1], "tight")))
        for item in page.select(rules.item):
            label, colon, value = page.text(item, "tight").partition(":")
            if colon:
                found.append((label, value.strip()))
    found = [(k.strip().lower().rstrip(":"), v) for k, v in found]
    return [k for k, _ in found], [v for _, v in found]


def read_fragments(html: str, spec: dict | _Rules) -> dict[str, list[str]] | None:
    """Slots of one page; None when it cannot be read."""
    try:
        rules = spec if isinstance(spec, _Rules) else _Rules(spec)
        page = _Page(html, rules)
        out = {slot: _picked(page, take, how, selectors) for slot, take, how, selectors in rules.slots}
        if rules.pairs:
            out["labels"], out["values"] = _pairs(page, rules)
        for slot, names, chain, key, attr in rules.attributes:
            near = [e.mark.attrs for e in page.select(chain) if e.mark.given]
            out[slot] = [own.get(attr, "") for n in names for own in near if own.get(key) == n]
        if rules.page_text:
            out["page_text"] = [" ".join(page.pieces)]
        return out
    except Exception:  # noqa: BLE001 - one bad page must not fail the job
        return None


def _as_maps(found: Iterable[dict[str, list[str]] | None]) -> pa.Array:
    """The slots of a batch of pages as one map column."""
    starts, keys, ends, texts = [], [], [0], []
    for slots in found:
        starts.append(None if slots is None else len(keys))
        for slot, values in (slots or {}).items():
            keys.append(slot)
            texts += values
            ends.append(len(texts))
    items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(texts, pa.string()))
    return pa.MapArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), pa.array(keys, pa.string()), items)


def fragments(html: Column, spec: dict) -> Column:
    """Map of slot name to texts for each page."""

    @F.arrow_udf(FRAGMENTS)
    def run(pages: pa.Array) -> pa.Array:
        rules = _Rules(spec)
        return _as_maps(None if h is None else read_fragments(h, rules) for h in pages.to_pylist())

    # Declared non-deterministic so that the optimizer keeps one evaluation per page instead of
    # copying the call into every filter and field above it.
    return run.asNondeterministic()(html)


def fragments_by_source(source: Column, html: Column, specs: dict[str, dict]) -> Column:
    """The same for pages of several sources: each takes the spec of its own."""

    @F.arrow_udf(FRAGMENTS)
    def run(sources: pa.Array, pages: pa.Array) -> pa.Array:
        rules = {s: _Rules(spec) for s, spec in specs.items()}
        return _as_maps(None if h is None or s not in rules else read_fragments(h, rules[s])
                        for s, h in zip(sources.to_pylist(), pages.to_pylist(), strict=True))

    return run.asNondeterministic()(source, html)
