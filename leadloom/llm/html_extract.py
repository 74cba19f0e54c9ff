"""Main text of web pages: parser events, text-to-tag ratios of lines, smoothing and clusters.

A line is what one block of the page shows.  Each line gets the ratio of its text to its tags, text
inside links counting as tag.  The ratios are smoothed by a Gaussian over neighbouring lines, and
two clusters of the smoothed values give a threshold.  Lines are then judged by region: an article
with all its lines, or outside of articles a stretch of lines not broken by a menu, notice or other
part that is never content.  A region with a line above the threshold is content with all its lines,
so short paragraphs between long ones stay; so do short regions that belong to it.

Which parts are never content is settled when the whole page is known: names only bar a part that
does not hold most of the page's text, in an article or without.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Lines to each side that weigh in, in standard deviations of SIGMA lines.
SIGMA = 1.0
REACH = 3

# Element names of HTML.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
HIDDEN = frozenset(
    "script style noscript template head title svg math iframe object canvas audio video "
    "select textarea button".split()
)
NEVER = frozenset("nav header footer aside form dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
MAIN = frozenset(("article", "main"))
# Roles that make any element the same as one of these tags.
ROLES = {
    "main": "main", "article": "article", "complementary": "aside", "navigation": "nav",
    "banner": "header", "contentinfo": "footer", "search": "form", "form": "form",
    "dialog": "dialog", "alertdialog": "dialog", "menu": "menu", "menubar": "menu",
}
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
# Names in class, id and role that mark parts which are never the article.
SIGNS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice "
    "notices notification pagination popup promo promoted related replies reply share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget complementary contentinfo "
    "search alert foot colophon copyright".split()
)
# What may stand beside such a name in one token.
BESIDE = frozenset("bar box button buttons form item items link links list section".split())
# Parts written by others: never the article, however long, unless the article lies within.
REPLIES = frozenset("comment comments disqus related replies reply".split())
HEADINGS = frozenset(("h1", "h2"))
# An open element of the first kind ends where one of the second begins.
ENDS = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 "
        "h5 h6 header hr main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr",)),
    "td": frozenset(("td", "th", "tr")),
    "th": frozenset(("td", "th", "tr")),
    "head": frozenset(("body",)),
}
SPACES = re.compile("[ \t\n\r\f]+")


def signs(attributes: list) -> set[str]:
    """Names in SIGNS among the class, id and role: whole tokens, or tokens of nothing but them and
    words beside them (cookie-notice, share-buttons; not no-sidebar or post-header)."""
    found = set()
    for token in " ".join(v for k, v in attributes if v and k in ("class", "id", "role")).split():
        parts = set(re.split("[-_]+", token.lower())) - {""}
        if parts <= SIGNS | BESIDE:
            found |= parts & SIGNS
    return found


def is_unseen(given: dict) -> bool:
    """Whether attributes hide an element; one that is shown only when found counts as seen."""
    hidden = "hidden" in given and (given["hidden"] or "").strip().lower() != "until-found"
    return hidden or bool(UNSEEN.search(given.get("style") or ""))


class Line(NamedTuple):
    """What a block shows, and the parts it lies in: numbers of barred elements and of articles, from
    the outside in.  Without text: where a barred element begins or ends."""

    text: str
    tags: int
    linked: int
    bars: tuple[int, ...]
    mains: tuple[int, ...]
    heading: bool

    @property
    def weight(self) -> int:
        return max(len(self.text) - self.linked, 0)


class Lines(HTMLParser):
    """Collects lines from the events of the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, hides its text, barred, main
        self.hidden = self.links = self.headings = self.count = 0
        self.bars: list[int] = []
        self.mains: list[int] = []
        self.lifts: dict[int, bool] = {}  # whether the weight of its own text can lift a bar
        self.outside: dict[int, tuple[int, ...]] = {}  # bars around an article
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.rows: list[Line] = []

    def add(self, text: str) -> None:
        self.rows.append(Line(
            text, self.tags, self.linked, tuple(self.bars), tuple(self.mains), self.headings > 0
        ))

    def line(self) -> None:
        text = SPACES.sub(" ", "".join(self.text)).strip(" ")
        if text:
            self.add(text)
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        while self.open and tag in ENDS.get(self.open[-1][0], ()):
            self.close_last()
        if self.open and self.open[-1][0] in INLINE and tag not in INLINE:
            # an inline element left open ends with the paragraph around it
            depth = len(self.open) - 1
            while depth and self.open[depth][0] in INLINE:
                depth -= 1
            if tag in ENDS.get(self.open[depth][0], ()):
                while len(self.open) > depth:
                    self.close_last()
        self.tags += 1
        if tag not in INLINE:
            self.line()
        if tag in VOID:
            return
        # the header of an article holds its title
        given = dict(attrs)
        role = ROLES.get((given.get("role") or "").strip().lower(), tag)
        never = role in NEVER and not (role == "header" and self.mains)
        exempt = role in MAIN or tag in ("html", "body") or role == "header"
        names = set() if exempt else signs(attrs)
        bars = never or bool(names)
        hides = tag in HIDDEN or (tag not in ("html", "body") and is_unseen(given))
        self.open.append((tag, hides, bars, role in MAIN))
        self.hidden += hides
        self.links += tag == "a"
        self.headings += tag in HEADINGS
        self.count += 1
        if role in MAIN:
            self.mains.append(self.count)
            self.outside[self.count] = tuple(self.bars)
        if bars:
            self.bars.append(self.count)
            self.lifts[self.count] = not never and REPLIES.isdisjoint(names)
            self.add("")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in HIDDEN:
            self.handle_endtag(tag)

    def close_last(self) -> None:
        tag, hides, bars, main = self.open[-1]
        if tag not in INLINE:
            self.line()
        self.open.pop()
        self.hidden -= hides
        self.links -= tag == "a"
        self.headings -= tag in HEADINGS
        if bars:
            self.add("")
            self.bars.pop()
        if main:
            self.mains.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if any(entry[0] == tag for entry in self.open):
            while self.open[-1][0] != tag:
                self.close_last()
            self.close_last()

    def parse_marked_section(self, i, report=1):
        """A marked section is a comment up to the next bracket, whatever it says."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def lifted(self) -> set[int]:
        """Bars that are none: what they hold outweighs all that lies outside of any."""
        free, of_bar, of_main = 0, dict.fromkeys(self.lifts, 0), dict.fromkeys(self.outside, 0)
        for row in self.rows:
            if not row.bars:
                free += row.weight
            if len(row.bars) == 1 and not row.mains:
                of_bar[row.bars[0]] += row.weight
            for main in row.mains:
                if self.outside[main] == row.bars:
                    of_main[main] += row.weight
        first = max(of_main, key=of_main.get, default=None)
        if first and of_main[first] > free:
            return set(self.outside[first])
        if any(of_main[main] for main, bars in self.outside.items() if not bars):
            return set()
        return {bar for bar, weight in of_bar.items() if self.lifts[bar] and weight > free}

    def finish(self) -> tuple[list[Line], list[tuple]]:
        """Lines outside of barred parts, and the region of each."""
        self.close()
        self.line()
        lifted = self.lifted()
        rows, regions, stretch = [], [], 0
        for row in self.rows:
            barred = not lifted.issuperset(row.bars)
            stretch += barred
            if row.text and not barred:
                rows.append(row)
                # an article is one region whatever is barred in it
                regions.append((row.mains, 0 if row.mains else stretch))
        return rows, regions


def threshold(values: np.ndarray) -> float:
    """Half way between the centres of two clusters of `values`."""
    low, high = float(values.min()), float(values.max())
    while True:
        middle = (low + high) / 2
        upper = values > middle
        if not upper.any() or upper.all():
            return middle
        centres = float(values[~upper].mean()), float(values[upper].mean())
        if math.isclose(centres[0], low) and math.isclose(centres[1], high):
            return middle
        low, high = centres


def smoothed(values: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    full = np.convolve(values, kernel)[REACH : REACH + len(values)]
    weight = np.convolve(np.ones(len(values)), kernel)[REACH : REACH + len(values)]
    return full / weight


def above(rows: list[Line]) -> list[bool]:
    """Which lines are in the upper cluster; a page of even lines has one cluster, all of it."""
    near = smoothed(np.array([row.weight / (row.tags + 1) for row in rows]))
    return (near >= threshold(near)).tolist()


def main_text(html: str | None) -> str:
    """The article of a page; the empty text if the page has none."""
    parser = Lines()
    parser.feed(html or "")
    rows, regions = parser.finish()
    if not rows:
        return ""
    high = above(rows)
    inside = [bool(row.mains) for row in rows]
    weights = [row.weight if is_high else 0 for row, is_high in zip(rows, high, strict=True)]
    # articles that hold less than the rest of the page are teasers
    if any(inside) and 2 * sum(
        w for w, is_in in zip(weights, inside, strict=True) if is_in
    ) >= sum(weights):
        regions = [r for r, is_in in zip(regions, inside, strict=True) if is_in]
        rows = [r for r, is_in in zip(rows, inside, strict=True) if is_in]
        high = above(rows)
    chosen = {region for region, is_high in zip(regions, high, strict=True) if is_high}
    # lines around an article within the main part, low stretches between content, its headline
    around = {mains[:i] for mains, _ in chosen for i in range(1, len(mains))}
    loose = sorted(stretch for mains, stretch in chosen if not mains)
    order = sorted({stretch for mains, stretch in regions if not mains})
    titled = {region for row, region in zip(rows, regions, strict=True) if row.heading}
    ahead = {after: before for before, after in zip(order, order[1:], strict=False)}

    def belongs(row: Line, region: tuple) -> bool:
        if region in chosen:
            return True
        mains, stretch = region
        if 2 * row.weight < len(row.text):
            return False
        if mains:
            return mains in around
        if not loose:
            return False
        return loose[0] < stretch < loose[-1] or (
            region in titled and ahead.get(loose[0]) == stretch
        )

    return " ".join(
        row.text for row, region in zip(rows, regions, strict=True) if belongs(row, region)
    )


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `text`, the main text, in place of any column of that name.  A null or empty html
    gives the empty text; equal rows give equal texts; nothing is cut off.  No shuffle."""
    pages = pages.drop("text")
    names = [*pages.columns, "text"]
    place = names.index(html)
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(value) for value in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string())], names
            )

    return pages.mapInArrow(run, schema)
