"""Main text of web pages: the maximum-scoring run of words against tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship
from tessera.llm.html_pages import CONTENT, REST, labelled_pages

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)(?:>|\Z)", re.S)
#: A tag whose quotes don't close is read again without minding quotes.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page; it ends at their end tag only.
RAW = frozenset("script style title textarea noscript template iframe svg math select option object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body button caption head html tbody td tfoot th thead tr".split())
#: Open elements that a start tag ends, if no other block lies between.
ENDS = {"li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("tr", "td", "th", "p")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: What elements, and names in class, id and role, hint at. Hints are features that weights are learned for.
HINT_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "label": "form", "legend": "form", "menu": "nav", "dialog": "notice", "fieldset": "form", "search": "form"}
HINT_NAMES = {
    **dict.fromkeys("nav navbar navigation navlinks topnav sidenav subnav mainnav leftnav rightnav menu menubar submenu breadcrumb breadcrumbs pagination pager toolbar toc skip".split(), "nav"),
    **dict.fromkeys("header masthead topbar".split(), "header"),
    **dict.fromkeys("footer copyright contentinfo imprint legal".split(), "footer"),
    **dict.fromkeys("sidebar aside related widget widgets share sharing social complementary recommended trending promo teaser".split(), "aside"),
    **dict.fromkeys("ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot adunit adbanner banner sponsor sponsored sponsors".split(), "ad"),
    **dict.fromkeys("cookie cookies consent gdpr notice notices notification notifications popup modal overlay alert alerts disclaimer newsletter subscribe subscription paywall".split(), "notice"),
    **dict.fromkeys("comment comments commentlist commentform reply replies disqus respond responses discussion".split(), "comment"),
    **dict.fromkeys("form login signin signup search".split(), "form"),
}
#: Names that say so whatever follows them, as in ad-slot-7 or cookie-law; others only beside parts that say nothing, so that legal-history is no hint.
LEADING = frozenset("ad ads adv advert advertisement advertising sponsor sponsored cookie cookies nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments newsletter popup".split())
NEUTRAL = frozenset(
    "a area article articles bar block body bottom box btn button center class col column container content desktop div entry fixed full global group holder home icon inner item items js left link links "
    "list main message mini mobile module of outer page pages panel part policy post posts primary region right row section secondary site small sticky stories story sub text the title top ul unit view web wide wrap wrapper".split()
)
ZONES = ("", *sorted({*HINT_TAGS.values(), *HINT_NAMES.values()}))
KINDS = ("text", "p", "h", "li", "td", "pre")
#: Features of words: zone with place (in an article or main element, outside of the page's, in a page without), the nearest kind of element, link or not, and the block's size.
PLACES, SIZES = ("in", "out", "none"), (4, 10, 25)


@dataclass
class Item:
    """A tag, or the words between two tags. parent: the innermost open element, -1 for none; block: which block its words belong to."""

    at: int
    tag: str = ""
    text: str = ""
    words: int = 0
    parent: int = -1
    block: int = 0


@dataclass
class Element:
    name: str
    zone: str
    first: int
    parent: int
    last: int = -1
    holds_main: bool = False
    comments: bool = False


@dataclass
class Page:
    items: list[Item] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    marks: list[tuple[str, int]] = field(default_factory=list)


def _zone(name: str, attributes: str) -> str:
    """What an element's own name and attributes hint at."""
    if name in HINT_TAGS:
        return HINT_TAGS[name]
    if not attributes or name in ("html", "body"):
        return ""
    for m in _ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            parts = [x.lower() for x in _NAME_PARTS.findall(token)]
            hints = [HINT_NAMES[x] for x in parts if x in HINT_NAMES]
            if not hints or not (parts[0] in LEADING or all(x in HINT_NAMES or x in NEUTRAL or x.isdigit() for x in parts)):
                continue
            if name in MAIN and not (hints[0] == "comment" and parts[0] in HINT_NAMES):  # an article of its own unless it is a reader's comment
                continue
            return hints[0]
    return ""


def parse(source: str) -> Page:
    """Tags and texts in page order with their innermost element, in linear time; broken markup never fails."""
    page, stack, at, end, block = Page(), [], 0, len(source), 0
    items, elements, opened = page.items, page.elements, Counter()

    def text(raw: str, start: int) -> None:
        if raw:
            t = html.unescape(raw)
            items.append(Item(start, text=t, words=len(t.split()), parent=stack[-1] if stack else -1, block=block))

    def close(depth: int) -> None:
        for i in stack[depth:]:
            elements[i].last = len(items)
            opened[elements[i].name] -= 1
        del stack[depth:]

    while at < end:
        found = source.find("<", at)
        if found < 0:
            text(source[at:], at)
            break
        m = _TOKEN.match(source, found)
        if not m or m[2] and m.end() == end and not source.endswith(">"):
            m = _PLAIN.match(source, found)
        if not m:
            after = source.find("<", found + 1)
            after = end if after < 0 else after
            text(source[at:after], at)
            at = after
            continue
        text(source[at:found], at)
        at = m.end()
        if m.lastindex is None or not m[2]:
            if m[0] in (CONTENT, REST):
                page.marks.append((m[0], len(items)))
            continue
        name = m[2].lower()
        if name in BLOCK:
            block += 1
        if m[1]:
            items.append(Item(found, tag="/" + name, parent=stack[-1] if stack else -1))
            if opened[name] > 0:
                depth = len(stack) - 1
                while elements[stack[depth]].name != name:
                    depth -= 1
                close(depth)
            continue
        ends = ENDS.get(name, ("p",) if name in CLOSES_P else ())
        if any(opened[x] > 0 for x in ends):
            for i in reversed(range(len(stack))):
                if (n := elements[stack[i]].name) in ends:
                    close(i)
                    if not any(opened[x] > 0 for x in ends):
                        break
                elif n in BLOCK:
                    break
        parent = stack[-1] if stack else -1
        items.append(Item(found, tag=name, parent=parent))
        if name in RAW:
            if not m[3].rstrip().endswith("/") or name in ("script", "style", "title", "textarea"):
                stop = _raw_end(name).search(source, at)
                at = stop.end() if stop else end
            continue
        if name in VOID:
            continue
        zone = _zone(name, m[3])
        comments = zone == "comment" or parent >= 0 and elements[parent].comments
        elements.append(Element(name, zone, len(items) - 1, parent, comments=comments))
        if name in MAIN and not comments:
            i = parent
            while i >= 0 and not elements[i].holds_main:
                elements[i].holds_main = True
                i = elements[i].parent
        opened[name] += 1
        stack.append(len(elements) - 1)
    close(0)
    return page


@lru_cache(maxsize=64)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I)


def features(page: Page) -> list[tuple[str, str, str, bool, int] | None]:
    """For each item with words: (zone, place, kind, link, size); None for the others.

    The outermost hint counts. A container is no aside, whatever its hints, if it holds most of the page's words in articles, or a first heading (a form: also
    three paragraphs) with most of all words. A heading in an article's header is not the header's.
    """
    items, elements = page.items, page.elements
    n = len(elements)
    words, tops, paragraphs = ([0, *accumulate(x)] for x in ([x.words for x in items], [x.tag == "h1" for x in items], [x.tag == "p" for x in items]))
    outer = [False] * n  # outermost articles that are no comments
    inside = [False] * n
    for k, e in enumerate(elements):
        up = e.parent >= 0 and inside[e.parent]
        outer[k] = e.name in MAIN and not e.comments and not up
        inside[k] = up or outer[k]
    of_main = [0] * (len(items) + 1)
    for k, e in enumerate(elements):
        if outer[k]:
            of_main[e.first] += words[e.last] - words[e.first]
    of_main = [0, *accumulate(of_main)]
    zones, plain_zones, in_main = [""] * n, [""] * n, [False] * n
    kinds, links, heads = ["text"] * n, [False] * n, [False] * n
    for k, e in enumerate(elements):
        zone, p = e.zone, e.parent
        if zone:
            held = words[e.last] - words[e.first]
            most = 2 * held > words[-1]
            whole = most and (tops[e.last] - tops[e.first] > 0 and (e.name not in HINT_TAGS or zone == "form") or zone == "form" and paragraphs[e.last] - paragraphs[e.first] >= 3)
            if whole or e.holds_main and zone != "comment" and 2 * (of_main[e.last] - of_main[e.first]) > of_main[-1]:
                zone = ""
        over, plain_over = (zones[p], plain_zones[p]) if p >= 0 else ("", "")
        in_main[k] = p >= 0 and in_main[p] or e.name in MAIN and not (over or zone or e.comments)
        zones[k] = over or zone
        plain_zones[k] = plain_over or ("" if zone == "header" and in_main[k] else zone)
        kind = "h" if e.name in HEADINGS else {"p": "p", "blockquote": "p", "li": "li", "dd": "li", "dt": "li", "td": "td", "th": "td", "pre": "pre"}.get(e.name)
        kinds[k] = kind or (kinds[p] if p >= 0 and e.name not in BLOCK else "text")
        heads[k] = e.name in HEADINGS or p >= 0 and heads[p]
        links[k] = e.name == "a" or p >= 0 and links[p] and kinds[k] != "p"
        if links[k] and kinds[k] == "p":
            links[k] = False  # a link in a paragraph is words like others
    has_main = any(x.words and x.parent >= 0 and in_main[x.parent] for x in items)
    sizes: Counter = Counter()
    for x in items:
        sizes[x.block] += x.words
    out: list[tuple[str, str, str, bool, int] | None] = []
    for x in items:
        k = x.parent
        if not x.text:
            out.append(None)
        elif k < 0:
            out.append(("", "out" if has_main else "none", "text", False, sum(sizes[x.block] >= s for s in SIZES)))
        else:
            zone = plain_zones[k] if heads[k] else zones[k]
            out.append((zone, "in" if in_main[k] else "out" if has_main else "none", kinds[k], links[k], sum(sizes[x.block] >= s for s in SIZES)))
    return out


def _columns(f: tuple[str, str, str, bool, int]) -> list[int]:
    """Which features of the linear scores hold: one zone and place, one kind, link, one size, and the constant."""
    zone, place, kind, link, size = f
    at = ZONES.index(zone) * len(PLACES) + PLACES.index(place)
    n = len(ZONES) * len(PLACES)
    out = [at, n + KINDS.index(kind), n + len(KINDS) + size, n + len(KINDS) + len(SIZES) + 2]
    return [*out, n + len(KINDS) + len(SIZES) + 1] if link else out


WIDTH = len(ZONES) * len(PLACES) + len(KINDS) + len(SIZES) + 3
#: Penalty of squared weights, Newton steps, and the bound of a word's score.
RIDGE, STEPS, MOST = 1.0, 30, 4.0


def _logistic(rows: dict[tuple[str, str, str, bool, int], list[float]]) -> np.ndarray:
    """Weights of features by logistic regression; rows: words inside and outside by features."""
    x = np.zeros((len(rows), WIDTH))
    for k, f in enumerate(rows):
        x[k, _columns(f)] = 1
    yes, no = np.sqrt(np.array(list(rows.values()), float)).T  # words of a block say the same
    w = np.zeros(WIDTH)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (yes - (yes + no) * p) - RIDGE * w
        curve = (x * ((yes + no) * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(WIDTH)
        w += np.linalg.solve(curve, slope)
    return w


@dataclass
class Weights:
    """Scores learned from labelled pages: a word's for lying in the region (`region`) and for being text of the page (`text`), by features; a tag's."""

    region: np.ndarray
    text: np.ndarray
    tags: dict[str, float]
    known: dict = field(default_factory=dict)

    def words(self, f: tuple[str, str, str, bool, int]) -> tuple[float, bool]:
        """The score of a word, and whether it is text if the region holds it."""
        if f not in self.known:  # few hundred kinds
            at = _columns(f)
            self.known[f] = (max(-MOST, min(MOST, float(self.region[at].sum()))), bool(self.text[at].sum() > 0))
        return self.known[f]

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.1)


def fit(pages: Iterable[str]) -> Weights:
    """Learns from pages whose content is marked: words by their features, tags by how often they lie inside and outside; a tag costs at least a little."""
    region: dict = {}
    text: dict = {}
    inside, outside = Counter(), Counter()
    for source in pages:
        page = parse(source)
        first, last = min(i for m, i in page.marks if m == CONTENT), max(i for m, i in page.marks if m == REST)
        steps = Counter(dict.fromkeys(range(len(page.items) + 1), 0))
        for m, i in page.marks:
            steps[i] += 1 if m == CONTENT else -1
        own = list(accumulate(steps[i] for i in range(len(page.items))))
        for i, (item, f) in enumerate(zip(page.items, features(page), strict=True)):
            if item.tag:
                (inside if first <= i < last else outside)[item.tag] += 1
            elif f:
                region.setdefault(f, [0.0, 0.0])[0 if first <= i < last else 1] += item.words
                if first <= i < last:
                    text.setdefault(f, [0.0, 0.0])[0 if own[i] > 0 else 1] += item.words
    tags = {*inside, *outside}
    a, b = (sum(c.values()) + len(tags) for c in (inside, outside))
    cost = {k: min(0.0, math.log((inside[k] + 1) / a) - math.log((outside[k] + 1) / b)) / 4 - 0.05 for k in tags}
    return Weights(_logistic(region), _logistic(text), cost)


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return fit(labelled_pages())


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first of the longest contiguous runs with the largest sum, by one linear scan; (0, 0) if no sum is positive."""
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, best_at = run, (start, i + 1)
    return best_at


def main_text(source: str | None, weights: Weights | None = None) -> tuple[str, int, int]:
    """The main text, and where its region begins and ends in the source (characters)."""
    if not source:
        return "", 0, 0
    weights, page = weights or default_weights(), parse(source)
    judged = [weights.words(f) if f else (0.0, False) for f in features(page)]
    first, last = best_run([weights.tag(x.tag) if x.tag else x.words * s for x, (s, _) in zip(page.items, judged, strict=True)])
    if first == last:
        return "", 0, 0
    blocks: list[list[str]] = [[]]
    for item, (_, is_text) in zip(page.items[first:last], judged[first:last], strict=True):
        if item.tag:
            if item.tag.lstrip("/") in BLOCK:
                blocks.append([])
            elif item.tag == "br":
                blocks[-1].append(" ")
        elif is_text:
            blocks[-1].append(item.text)
    texts = [" ".join("".join(b).split()) for b in blocks]
    start, stop = page.items[first].at, page.items[last].at if last < len(page.items) else len(source)
    return "\n\n".join(t for t in texts if t), start, stop


def extract(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url", weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, region_start, region_end) for every row of pages.

    A null or empty page, and one without a run of positive score, has an empty text. Pages are read whole; repeated rows come
    back repeated; null ids and urls stay null; an empty table gives an empty result; extra columns don't matter.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(x, weights) for x in b.column(2).to_pylist()]
            texts = [x[0] for x in got]
            rest = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], [x[1] for x in got], [x[2] for x in got])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), *rest], names=["page_id", "url", "text", "n_chars", "region_start", "region_end"])

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long, region_start long, region_end long")
