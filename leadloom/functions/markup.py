"""Reading HTML: a native pattern form for columns, and a small parser used inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate, chain
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.constants import HIDDEN_TEXT_TAGS
from leadloom.functions.text import col, filled, strip
from leadloom.functions.urls import absolute_url

_LINK = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
_META = r'(?is)<meta\s+name="description"\s+content="([^"]*)"'
_OG = r'(?is)<meta\s+property="og:description"\s+content="([^"]*)"'
# The opening bracket is factored out: text without one is skipped at once.
_HIDDEN = "(?is)<(?:" + "|".join(rf"{tag}\b.*?</{tag}" for tag in HIDDEN_TEXT_TAGS) + r")\s*>"


# --- native form ---------------------------------------------------------------------------------
def native_title(html: Column | str) -> Column:
    return filled(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def native_description(html: Column | str) -> Column:
    """Meta description, else the one for sharing."""
    html = col(html)
    return F.coalesce(
        filled(F.regexp_extract(html, _META, 1)), filled(F.regexp_extract(html, _OG, 1))
    )


def native_links(html: Column | str, base: Column) -> Column:
    """`array<struct<pos, href, url, text>>` of followable links, in page order; `base` comes from
    `link_base`."""
    html = col(html)
    pairs = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(_LINK), F.lit(2)).alias("text"),
    )
    found = F.transform(
        pairs,
        lambda p, i: F.struct(
            i.alias("pos"), strip(p["href"]).alias("href"), p["text"].alias("text")
        ),
    )
    return F.transform(
        F.filter(found, lambda x: is_followable(x["href"])),
        lambda x: F.struct(
            x["pos"].alias("pos"),
            x["href"].alias("href"),
            absolute_url(base, x["href"]).alias("url"),
            native_text(x["text"]).alias("text"),
        ),
    )


def is_followable(href: Column) -> Column:
    return (href != "") & ~href.startswith("#") & ~href.startswith("javascript:")


def native_text(html: Column | str) -> Column:
    """Text without tags and without the content of hidden tags, whitespace collapsed."""
    shown = F.regexp_replace(F.regexp_replace(col(html), _HIDDEN, " "), "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(shown, r"\s+", " "))


def decode_body(content: Column | str, max_bytes: int | None = None) -> Column:
    """Bytes to text, broken sequences replaced; a byte cap only where the caller asks for one."""
    body = col(content) if max_bytes is None else F.substring(col(content), 1, max_bytes)
    return F.make_valid_utf8(body.cast("string"))


# --- parser form ---------------------------------------------------------------------------------
class PageEvents(HTMLParser):
    """A page as a flat list of (kind, tag or text, attributes)."""

    def parse_marked_section(self, i, report=1):
        """A marked section is skipped up to the next bracket, whatever it says; the page goes on."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, dict]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, {name: (value or "").strip() for name, value in attrs}))

    def handle_endtag(self, tag):
        self.events.append(("close", tag, {}))

    def handle_data(self, data):
        if data.strip():
            self.events.append(("text", data.strip(), {}))


def _close_heads(events: list) -> Iterator[tuple[str, str, dict]]:
    """The events with every head closed, at the latest where the body begins."""
    inside = False
    for event in events:
        match event[:2]:
            case "open", "body" if inside:
                yield "close", "head", {}
                inside = False
            case ("open", "head") | ("close", "head"):
                if inside == (event[0] == "open"):
                    continue
                inside = not inside
        yield event


def _in_title(events: list) -> list[bool]:
    """Per event: is a title open after it?"""
    return list(accumulate(
        events, lambda state, e: e[0] == "open" if e[:2] in _TITLE_MARKS else state, initial=False
    ))[1:]


def _depth(events: list) -> list[int]:
    """Per event: how many hidden elements are open after it?"""
    steps = {"open": 1, "close": -1, "text": 0}
    return list(accumulate(
        (steps[kind] if tag in HIDDEN_TEXT_TAGS else 0 for kind, tag, _ in events),
        lambda depth, step: max(depth + step, 0), initial=0,
    ))[1:]


def _descriptions(events: list, key: str, name: str) -> Iterator[str]:
    for kind, tag, values in events:
        if (kind, tag) == ("open", "meta") and values.get(key, "").lower() == name:
            yield values.get("content", "")


def _anchors(events: list, shown: list[str]) -> Iterator[tuple[str, str]]:
    """Target and text of each closed link: what is shown since the last opening that can be
    followed."""
    start = None
    for place, (kind, tag, values) in enumerate(events):
        href = values.get("href", "")
        if (kind, tag) == ("open", "a") and href and not href.startswith(("#", "javascript:")):
            start = place
        elif (kind, tag) == ("close", "a") and start is not None:
            yield events[start][2]["href"], " ".join(filter(None, shown[start:place]))
            start = None


_TITLE_MARKS = (("open", "title"), ("close", "title"))


def read_page(html: str | None, base: str | None, max_chars: int | None) -> dict:
    """One page as a row: title, description, text and links with absolute targets."""
    reader = PageEvents()
    try:
        reader.feed(html or "")
    except (AssertionError, ValueError):
        pass  # a page the parser gives up on keeps what was read so far
    events = list(_close_heads(reader.events))
    titled, depth = _in_title(events), _depth(events)
    shown = [
        e[1] if e[0] == "text" and not t and not d else "" for e, t, d in zip(events, titled, depth)
    ]
    title = "".join(e[1] for e, inside in zip(events, titled) if inside and e[0] == "text")
    descriptions = chain(
        _descriptions(events, "name", "description"),
        _descriptions(events, "property", "og:description"),
    )
    text = re.sub(r"\s+", " ", " ".join(filter(None, shown))).strip()
    return {
        "title": title.strip() or None,
        "description": next(filter(None, descriptions), None),
        "text": text if max_chars is None else text[:max_chars],
        "links": [
            {"pos": i, "href": href, "url": _join(base, href), "text": anchor}
            for i, (href, anchor) in enumerate(_anchors(events, shown))
        ],
    }


def _join(base: str | None, href: str) -> str:
    try:
        return urljoin(base or "", href)
    except ValueError:
        return href
