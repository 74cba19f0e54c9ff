"""Fetched pages to site records: parsing, social profiles, about page, join to leads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.constants import (
    ABOUT_ANCHOR_TEXTS,
    ABOUT_PATH_PATTERNS,
    DESCRIPTION_FROM_TEXT_CHARS,
    SOCIAL_PATTERNS,
)
from leadloom.functions import markup
from leadloom.functions.text import any_match, col
from leadloom.functions.urls import canonical_url, link_base, url_host, url_path
from leadloom.operators.dedup import first_rows
from leadloom.operators.joins import lookup_join
from leadloom.sources.tables import write_snapshot

# Pages, and bytes, of one Arrow batch on their way to Python while a table of parsed pages is written
BATCH_PAGES = 256
BATCH_BYTES = 4 << 20
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
# Bytes of HTML that a task parses before it passes the rows on
PARSED_BYTES = 1 << 20
LINKS_TYPE = "array<struct<pos:int,href:string,url:string,text:string>>"


def _parts(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """The batch cut behind every `PARSED_BYTES` of the texts in a column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    sizes = sizes.astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // PARSED_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def parse_pages(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
    max_chars: int | None = None,
) -> DataFrame:
    """Full parser form: `key, url, title, description, text, links`.

    Pages go to Python in Arrow batches and come back without their HTML, part by part, so that a task
    holds the objects of about `PARSED_BYTES` of HTML; nothing is shuffled.
    """
    source = pages.select(key, url, html)
    key_type = source.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {key_type}, `{url}` string, title string, description string, text string, "
        f"links {LINKS_TYPE}"
    )
    links_type = pa.list_(pa.struct([
        ("pos", pa.int32()), ("href", pa.string()), ("url", pa.string()), ("text", pa.string()),
    ]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole, 2)):
            urls, bodies = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = [markup.read_page(b, u, max_chars) for u, b in zip(urls, bodies)]

            def texts(name):
                return pa.array([r[name] for r in rows], pa.string())

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), texts("title"), texts("description"),
                    texts("text"), pa.array([r["links"] for r in rows], links_type),
                ],
                names=[key, url, "title", "description", "text", "links"],
            )

    return source.mapInArrow(read, schema)


def write_parsed(pages: DataFrame, path: str) -> None:
    """Pages of `parse_pages` as a new table.  A worker holds whole batches, two at a time, so a batch
    ends here behind `BATCH_PAGES` pages, not the 10,000 rows of Spark's default, or behind the page
    that reaches `BATCH_BYTES`, however large pages are.  A session's own limit of bytes is kept."""
    conf = pages.sparkSession.conf
    rows, size = conf.get(_BATCH_ROWS), conf.get(_BATCH_SIZE, None)
    conf.set(_BATCH_ROWS, str(min(int(rows), BATCH_PAGES) if int(rows) > 0 else BATCH_PAGES))
    if size is None:
        conf.set(_BATCH_SIZE, str(BATCH_BYTES))
    try:
        write_snapshot(pages, path)
    finally:
        conf.set(_BATCH_ROWS, rows)
        if size is None:
            conf.unset(_BATCH_SIZE)


def native_pages(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Same columns from patterns only; entities stay encoded."""
    return pages.withColumn("_base", link_base(url)).select(
        key, url,
        markup.native_title(html).alias("title"),
        markup.native_description(html).alias("description"),
        markup.native_text(html).alias("text"),
        markup.native_links(html, F.col("_base")).cast(LINKS_TYPE).alias("links"),
    )


def page_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per link."""
    return pages.select(key, F.explode("links").alias("link")).select(
        key, "link.pos", "link.href", "link.url", "link.text"
    )


def social_platform(url: Column | str) -> Column:
    """Name of the social platform an address belongs to, or null."""
    out = F.lit(None).cast("string")
    for platform, pattern in reversed(SOCIAL_PATTERNS.items()):
        out = F.when(col(url).rlike("(?i)" + pattern), platform).otherwise(out)
    return out


def social_links(links: Column | str) -> Column:
    """Map platform -> first link to it, in the order of these links.  The links of a page are one
    array on its row, so the first one is found in place: no explode, no shuffle."""
    links = col(links)

    def first(platform: str, pattern: str) -> Column:
        hit = F.get(F.filter(links, lambda x: x["url"].rlike("(?i)" + pattern)), F.lit(0))
        return F.struct(
            hit["pos"].alias("pos"), F.lit(platform).alias("key"), hit["url"].alias("value")
        )

    found = F.array(*[first(name, pattern) for name, pattern in SOCIAL_PATTERNS.items()])
    ordered = F.array_sort(F.filter(found, lambda x: x["value"].isNotNull()))
    return F.map_from_entries(
        F.transform(ordered, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    )


def about_link(links: Column | str, base: Column | str) -> Column:
    """First link on the same host whose path or anchor text looks like an about page."""
    host = F.lower(url_host(base))

    def looks_right(link: Column) -> Column:
        path = F.coalesce(F.nullif(url_path(link["url"]), F.lit("")), F.lit("/"))
        return (F.lower(url_host(link["url"])) == host) & (
            any_match(path, ABOUT_PATH_PATTERNS)
            | F.lower(link["text"]).isin(*ABOUT_ANCHOR_TEXTS)
        )

    return F.get(F.filter(col(links), looks_right), F.lit(0))["url"]


def fetch_status(
    url: Column | str, status_code: Column | str, content_type: Column | str, error: Column | str,
    robots_allowed: Column | str,
) -> Column:
    """Outcome of one fetch, first applicable reason first."""
    kind = F.lower(F.coalesce(col(content_type), F.lit("")))
    return (
        F.when(canonical_url(url).isNull(), "skipped")
        .when(~F.coalesce(col(robots_allowed), F.lit(True)), "blocked_by_robots")
        .when(col(error) == "timeout", "timeout")
        .when(col(error).isNotNull(), "network_error")
        .when(col(status_code) >= 400, "http_error")
        .when((kind != "") & ~kind.contains("html") & ~kind.contains("xml"), "not_html")
        .otherwise("ok")
    )


def merge_first_wins(first: Column | str, second: Column | str) -> Column:
    """Map union in which the first map's entries win."""
    first, second = col(first), col(second)
    return F.map_concat(
        first, F.map_filter(second, lambda k, _: ~F.array_contains(F.map_keys(first), k))
    )


def merge_last_wins(first: Column | str, second: Column | str) -> Column:
    """Map union in which the second map's entries win."""
    return merge_first_wins(second, first)


def fetched_pages(fetches: DataFrame, html: str = "html") -> DataFrame:
    """Fetches (`url, status_code, content_type, error, robots_allowed`, `html`) with their outcome as
    `status` and `error`, the body only of those that are `ok`."""
    status = fetch_status("url", "status_code", "content_type", "error", "robots_allowed")
    told = fetches.withColumn("status", status)
    return told.withColumns({
        html: F.when(F.col("status") == "ok", F.col(html)),
        "error": F.when(~F.col("status").isin("ok", "blocked_by_robots"), F.col("status")),
    })


def site_records(
    pages: DataFrame, key: str = "page_id", url: str = "url", texts: bool = True
) -> DataFrame:
    """One record per distinct page address, from parsed pages, of the first page of an address.

    Pages that carry a `status` and `error` keep them; what could not be fetched has no content.
    Without `texts` the record holds the start of the text only: joins then move narrow rows, and
    `with_texts` gets the rest by `page_id` when all joins are done.
    """
    known = "status" in pages.columns
    status = F.col("status") if known else F.lit("ok")
    ok = status == "ok"

    def if_ok(value: Column) -> Column:
        return F.when(ok, value) if known else value

    text = F.col("text") if texts else F.substring("text", 1, DESCRIPTION_FROM_TEXT_CHARS)
    empty = F.expr("cast(map() as map<string,string>)")
    socials = social_links("links")
    sites = pages.select(
        key,
        canonical_url(url).alias("url_norm"),
        status.alias("status"),
        F.when(status != "blocked_by_robots", F.col(url)).alias("final_url") if known
        else F.col(url).alias("final_url"),
        if_ok(F.col("title")).alias("title"),
        if_ok(F.col("description")).alias("description"),
        if_ok(text).alias("text" if texts else "text_start"),
        (F.when(ok, socials).otherwise(empty) if known else socials).alias("social_links"),
        if_ok(about_link("links", url)).alias("about_url"),
        *(["error"] if known else []),
    )
    return first_rows(sites, "url_norm", [key])


def add_about_pages(
    sites: DataFrame, key: str = "page_id", counts: DataFrame | None = None
) -> DataFrame:
    """Add the text of each site's about page, or of records without texts its key as `about_id`, and
    the profiles only found there.

    The about page is looked up among the fetched pages by address; many sites may share one.
    """
    whole = "text" in sites.columns
    about = sites.where(F.col("status") == "ok").select(
        F.col("url_norm").alias("about_norm"),
        F.col("text").alias("about_text") if whole else F.col(key).alias("about_id"),
        F.col("social_links").alias("_about_social"),
    )
    joined = lookup_join(
        sites.withColumn("about_norm", canonical_url("about_url")), about, "about_norm",
        spread_by=[key], counts=counts,
    )
    empty = F.expr("cast(map() as map<string,string>)")
    added = {"about_text": F.coalesce("about_text", F.lit(""))} if whole else {}
    return joined.withColumns({
        **added,
        "social_links": merge_first_wins(
            "social_links", F.coalesce("_about_social", empty)
        ),
    }).drop("_about_social", "about_norm")


# The record of a site in full, in the order in which it is written out.
SITE_FIELDS = (
    "status", "final_url", "title", "description", "text", "social_links", "about_url",
    "about_text", "error",
)


def with_texts(
    rows: DataFrame, pages: DataFrame, site: str = "site", key: str = "page_id"
) -> DataFrame:
    """`rows` whose `site` record has no texts, with the whole record: the texts of `pages` (`key`,
    `text`) are joined by key, the last step, so each text passes one exchange."""
    field_names = rows.schema[site].dataType.fieldNames()
    texts = pages.select(F.col(key).alias("_text_key"), F.col("text").alias("_text"))
    joined = rows.join(texts, F.col(f"{site}.{key}") == F.col("_text_key"), "left")
    ok = F.col(f"{site}.status") == "ok"
    known = {"text": F.when(ok, F.col("_text"))}
    if "about_id" in field_names:
        abouts = texts.toDF("_about_key", "_about")
        joined = joined.join(abouts, F.col(f"{site}.about_id") == F.col("_about_key"), "left")
        known["about_text"] = F.when(ok, F.coalesce("_about", F.lit("")))

    def value(name: str) -> Column:
        if name in known:
            return known[name]
        return F.col(f"{site}.{name}") if name in field_names else F.lit(None).cast("string")

    record = F.struct(
        F.col(f"{site}.{key}").alias(key), *[value(name).alias(name) for name in SITE_FIELDS]
    )
    return joined.withColumn(site, F.when(F.col(site).isNotNull(), record)).drop(
        "_text_key", "_text", "_about_key", "_about"
    )


def website_counts(leads: DataFrame, website: str = "website_csv") -> DataFrame:
    """Leads per website address (`url_norm, n`): one narrow scan, combined map-side."""
    return (
        leads.select(canonical_url(website).alias("url_norm"))
        .where(F.col("url_norm").isNotNull())
        .groupBy("url_norm")
        .agg(F.count("*").alias("n"))
    )


def join_sites(
    leads: DataFrame, sites: DataFrame, website: str = "website_csv",
    spread_by: list[str] | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """Leads with the site record of their own website as struct `site`, and `has_scraped_data`.

    Many leads may share one website: see `lookup_join` for how such an address is split.
    """
    record = F.struct(*[c for c in sites.columns if c != "url_norm"])
    right = sites.select("url_norm", record.alias("site"))
    keyed = leads.withColumn("url_norm", canonical_url(website))
    joined = lookup_join(
        keyed, right, "url_norm", spread_by=spread_by or ["email"], counts=counts
    )
    return joined.withColumn(
        "has_scraped_data", F.coalesce(F.col("site.status") == "ok", F.lit(False))
    )
