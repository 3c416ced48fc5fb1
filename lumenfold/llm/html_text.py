"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, a threshold, and content regions.

The standard library's parser streams events. Text between two block tags is a line; its ratio is its characters over the
tags met in it. Tags and classes are a prior: the ratio of a line in a menu, header, footer, sidebar, notice, advert, form or
reader comment is multiplied by ``DAMPED``. Logarithms of ratios are smoothed over neighbouring lines by a Gaussian, and the
threshold that best parts them in two (Otsu's) forms clusters; there is one cluster if the two parts' ratios differ by less
than ``APART`` times. Clusters choose the region: the articles and ``main`` parts that hold clusters, if they hold at least a
quarter of the clusters' text; else the innermost part of the page that holds nine tenths of it, in that from the first
cluster to the last, and the paragraphs and headings next to them that aren't links. All lines of the region count, short ones
too, but for damped ones below the threshold or ``LEAST``.

A part whose class or id names noise is none if it holds an article, ``main`` or ``h1``: then it wraps the page. Scripts,
styles, titles and other content that is never shown count nowhere.

Defined results: null html and pages without content have an empty text; unclosed and stray tags are borne, an open
paragraph or item ends where the next begins; very long pages are read whole; repeated rows are pages of their own;
other columns are not looked at, whatever their names; null ids and urls stay null; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spread of the smoothing in lines; factor of noise; least damped ratio that can count; how far two clusters' ratios lie apart.
SIGMA, DAMPED, LEAST, APART = 1.0, 0.01, 2.0, 4.0

#: Tags whose content is never shown as text.
HIDDEN = frozenset("head title script style noscript template select textarea option iframe object svg canvas audio video".split())
#: Tags of parts that aren't main text.
PARTS = frozenset("nav header footer aside form menu dialog button".split())
#: Tags that end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that can be a region, and tags of paragraphs, items and headings.
BOXES = frozenset("article body center details div html main section table td".split())
PROSE = frozenset("blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre".split())
#: What an open element of a kind ends at, and what that doesn't reach through.
ENDS = {"li": (("li",), ("ol", "ul", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",))}
#: Words in classes and ids, and roles, of parts that aren't main text; words that turn them round.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification paywall popup promo promoted related replies reply respond share sharing sidebar sidebars skip social sponsor sponsored subscribe toolbar widget".split()
)
NOT = frozenset("free no non has with without".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())


def named_noise(value: str) -> bool:
    """Whether one of the names in a class or id speaks of noise, as ``ad-top`` does and ``ad-free`` doesn't."""
    for name in value.lower().split():
        words = set(re.split(r"[^a-z]+", name))
        if words & NOISE and not words & NOT:
            return True
    return False


class _Element:
    """An open or closed element: its tag, parent, and whether it is (or lies in) a hidden part, an article, noise."""

    __slots__ = ("depth", "hidden", "named", "noise", "parent", "region", "tag")

    def __init__(self, tag: str, parent: _Element | None) -> None:
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.hidden = bool(parent and parent.hidden)
        self.region = parent.region if parent else None
        self.noise = bool(parent and parent.noise)
        self.named = parent.named if parent else ()  # elements of noisy names, innermost last, that may turn out to wrap the page


class _Line:
    __slots__ = ("box", "element", "link", "tags", "text")

    def __init__(self, text: str, tags: int, element: _Element, link: int) -> None:
        self.text, self.tags, self.element, self.link = text, tags, element, link
        while element.tag not in BOXES and element.parent:
            element = element.parent
        self.box = element


class _Lines(HTMLParser):
    """Collects the lines that are shown, each with the element it lies in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.text: list[str] = []
        self.tags = self.link = 0
        self.stack = [_Element("html", None)]
        self.open: dict[str, int] = {}
        self.wraps: set[_Element] = set()

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(_Line(text, self.tags, self.stack[-1], self.link))
        self.text.clear()
        self.tags = self.link = 0

    def close_open(self, tags: tuple[str, ...], through: tuple[str, ...]) -> None:
        """End the innermost open element of ``tags``, unless one of ``through`` is open within it."""
        if any(self.open.get(t) for t in tags):
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].tag in through:
                    return
                if self.stack[at].tag in tags:
                    self.pop(at)
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag != "br":
                self.close_open(("p",), ("button", "table", "object"))
        if tag in ENDS:
            self.close_open(*ENDS[tag])
        self.tags += 1
        if tag in VOID or tag == "html":
            return
        e = _Element(tag, self.stack[-1])
        e.hidden = e.hidden or tag in HIDDEN
        e.noise = e.noise or tag in PARTS
        for name, value in attrs:
            if not value:
                continue
            if name == "role":
                e.noise = e.noise or value.lower() in ROLES
                if value.lower() == "main" and not e.region:
                    e.region = e
            elif name in ("class", "id") and tag not in ("body", "main") and named_noise(value):
                e.named = (*e.named, e) if e not in e.named else e.named
        if tag in ("article", "main") and not e.region and not (e.named and e.named[-1] is e):
            e.region = e
        if tag in ("article", "main", "h1"):  # what holds one is no noise, whatever its name
            self.wraps.update(x for x in e.named if x is not e)
        self.stack.append(e)
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop(self, at: int) -> None:
        for e in self.stack[at:]:
            self.open[e.tag] -= 1
        del self.stack[at:]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.open.get(tag):
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            if tag in BLOCKS or tag in HIDDEN or not any(e.tag in BLOCKS for e in self.stack[at + 1 :]):
                self.pop(at)
            else:  # the end of an inline tag ends no block
                self.open[tag] -= 1
                del self.stack[at]

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].hidden:
            self.text.append(data)
            if self.open.get("a"):
                self.link += len(data.strip())

    def noisy(self, line: _Line) -> bool:
        return line.element.noise or any(e not in self.wraps for e in line.element.named)


def parsed(html: str) -> _Lines:
    # after the last ">" no tag ends: what looks like one is text, and is not looked through again and again
    end = html.rfind(">") + 1
    html = html[:end] + re.sub(r"<(?=[A-Za-z/])", "&lt;", html[end:])
    for source in (html, html.replace("<!", "&lt;!")):
        parser = _Lines()
        try:
            parser.feed(source)
            parser.close()
        except AssertionError:  # a declaration that the parser can't read; then it is taken as text
            continue
        parser.flush()
        return parser
    return _Lines()


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the ends, over what there is."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k, w in zip(range(i - reach, i + reach + 1), kernel, strict=True):
            if 0 <= k < len(values):
                total, weight = total + w * values[k], weight + w
        out.append(total / weight)
    return out


def parting(values: list[float]) -> float:
    """The least value of the upper of two clusters of logarithms, by Otsu's rule; the least of all where they aren't ``APART``."""
    ordered = sorted(values)
    total, below, best, at = sum(ordered), 0.0, -1.0, 0
    for k in range(1, len(ordered)):
        below += ordered[k - 1]
        low, high = below / k, (total - below) / (len(ordered) - k)
        between = k * (len(ordered) - k) * (high - low) ** 2
        if ordered[k] > ordered[k - 1] and between > best:
            best, at = between, k if high - low >= math.log(APART) else 0
    return ordered[at]


def clusters(lines: list[_Line], noise: list[bool]) -> list[bool]:
    """Whether each line is of a cluster: its smoothed ratio reaches the threshold, and its own, if damped, ``LEAST``."""
    ratios = [len(x.text) / max(1, x.tags) * (DAMPED if odd else 1.0) for x, odd in zip(lines, noise, strict=True)]
    level = smoothed([math.log1p(r) for r in ratios])
    least = parting(level)
    return [v >= least and (not odd or r >= LEAST) for v, r, odd in zip(level, ratios, noise, strict=True)]


def content(html: str | None) -> str:
    """The main text of one page."""
    page = parsed(html or "")
    lines = page.lines
    noise = [page.noisy(x) for x in lines]
    chosen = clusters(lines, noise) if lines else []
    mass = sum(len(x.text) for x, c in zip(lines, chosen, strict=True) if c)
    if not mass:
        return ""
    kept = [c or not odd for c, odd in zip(chosen, noise, strict=True)]
    regions = {x.element.region for x, c in zip(lines, chosen, strict=True) if c and x.element.region}
    if 4 * sum(len(x.text) for x, c in zip(lines, chosen, strict=True) if c and x.element.region) >= mass:
        return " ".join(x.text for x, k in zip(lines, kept, strict=True) if k and x.element.region in regions)
    # the innermost box with nine tenths of the clusters' text
    held: dict[_Element, int] = {}
    for x, c in zip(lines, chosen, strict=True):
        box = x.box if c else None
        while box:
            held[box] = held.get(box, 0) + len(x.text)
            box = box.parent
    box = max((b for b, n in held.items() if 10 * n >= 9 * mass), key=lambda b: b.depth)
    inside = [i for i, x in enumerate(lines) if _within(x.box, box)]
    mine = [i for i in inside if chosen[i]]
    first, last = inside.index(mine[0]), inside.index(mine[-1])

    def beside(i: int) -> bool:
        return not noise[i] and lines[i].element.tag in PROSE and 2 * lines[i].link < len(lines[i].text)

    while first and beside(inside[first - 1]):
        first -= 1
    while last + 1 < len(inside) and beside(inside[last + 1]):
        last += 1
    return " ".join(lines[i].text for i in inside[first : last + 1] if kept[i])


def _within(e: _Element | None, box: _Element) -> bool:
    while e and e.depth > box.depth:
        e = e.parent
    return e is box


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                texts = [content(h) for h in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    named = pages.select(F.col(page_id).cast("long").cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return named.mapInPandas(run, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))
