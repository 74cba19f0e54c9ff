"""Links, profiles, about pages, site join, robots rules."""

from __future__ import annotations

import itertools
from urllib.robotparser import RobotFileParser

import pytest
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from leadloom.functions.markup import read_page
from leadloom.operators.pages import (
    about_link,
    add_about_pages,
    join_sites,
    merge_first_wins,
    merge_last_wins,
    native_pages,
    parse_pages,
    site_records,
    social_links,
    write_parsed,
)
from leadloom.operators.robots import robots_rules, with_robots_verdict

LINK_TYPE = "links array<struct<pos:int,href:string,url:string,text:string>>, base string"


def _links(spark, *pairs, base="https://example.com"):
    rows = [(i, url, url, text) for i, (url, text) in enumerate(pairs)]
    return spark.createDataFrame([(rows, base)], LINK_TYPE)


def test_social_links(spark):
    rows = _links(
        spark,
        ("https://example.com/contact", ""),
        ("https://fr.linkedin.com/in/jean", ""),
        ("https://www.linkedin.com/company/second", ""),
        ("https://x.com/acme", ""),
        ("https://twitter.com/acme/status/1", ""),
        ("https://M.facebook.com/acme/about", ""),
        ("https://www.instagram.com/acme", ""),
        ("https://www.youtube.com/watch?v=1", ""),
        ("https://www.youtube.com/@acme", ""),
    )
    assert rows.select(social_links("links")).first()[0] == {
        "linkedin": "https://fr.linkedin.com/in/jean",
        "twitter": "https://x.com/acme",
        "facebook": "https://M.facebook.com/acme/about",
        "instagram": "https://www.instagram.com/acme",
        "youtube": "https://www.youtube.com/@acme",
    }


@pytest.mark.parametrize("path,expected", [
    ("/about", True), ("/about-us", True), ("/about/", True), ("/company", True),
    ("/who-we-are", True), ("/qui-sommes-nous", True), ("/a-propos", True), ("/uber-uns", True),
    ("/contact", False), ("/products/widgets", False),
])
def test_about_paths(spark, path, expected):
    rows = _links(spark, ("https://example.com" + path, ""))
    assert (rows.select(about_link("links", "base")).first()[0] is not None) is expected


def test_about_text_and_host(spark):
    rows = _links(
        spark, ("https://wikipedia.org/about", "About"), ("https://EXAMPLE.com/p-1", "À propos"),
        ("https://example.com/about", ""),
    )
    assert rows.select(about_link("links", "base")).first()[0] == "https://EXAMPLE.com/p-1"


def test_map_unions(spark):
    rows = spark.sql("select map('a', '1', 'b', '2') x, map('b', '9', 'c', '3') y")
    both = rows.select(merge_first_wins("x", "y").alias("f"), merge_last_wins("x", "y").alias("l"))
    assert both.first().f == {"a": "1", "b": "2", "c": "3"}
    assert both.first().l == {"a": "1", "b": "9", "c": "3"}


HOME = (
    "<html><head><title>Home</title><meta name='description' content='D'></head><body>"
    "<a href='/about-us'>About</a><a href='https://www.linkedin.com/company/h'>L</a></body></html>"
)
ABOUT = (
    "<html><head><title>A</title></head><body>We are 200."
    "<a href='https://www.linkedin.com/company/late'>L</a>"
    "<a href='https://www.instagram.com/h'>I</a></body></html>"
)


def test_site_with_about_page(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://a.com/", HOME), (2, "https://a.com/about-us/", ABOUT),
            (3, "https://b.com", HOME), (4, "https://a.com", ABOUT),
        ],
        "page_id long, url string, html string",
    )
    sites = add_about_pages(site_records(parse_pages(pages)))
    found = {r.url_norm: r for r in sites.collect()}
    assert len(found) == 3
    home = found["https://a.com"]
    assert (home.page_id, home.title, home.description) == (1, "Home", "D")
    assert home.about_text == "We are 200. L I"
    assert home.social_links == {
        "linkedin": "https://www.linkedin.com/company/h",
        "instagram": "https://www.instagram.com/h",
    }
    assert found["https://b.com"].about_url == "https://b.com/about-us"
    assert found["https://b.com"].about_text == ""

    leads = spark.createDataFrame(
        [("1@x.com", "a.com/"), ("2@x.com", "https://A.com"), ("3@x.com", None)],
        "email string, website_csv string",
    )
    joined = {r.email: r for r in join_sites(leads, sites).collect()}
    assert joined["1@x.com"].has_scraped_data and joined["1@x.com"].site.title == "Home"
    assert not joined["2@x.com"].has_scraped_data and joined["3@x.com"].site is None
    counts = spark.sql("select 'https://a.com' url_norm, 5000000L n")
    split = {r.email: r.site for r in join_sites(leads, sites, counts=counts).collect()}
    assert split == {e: r.site for e, r in joined.items()}


def test_parser_and_native_form_agree_without_entities(spark):
    html = HOME.replace("'", '"')
    pages = spark.createDataFrame([(1, "https://a.com/x", html)], "page_id long, url string, html string")
    parsed, native = parse_pages(pages).first(), native_pages(pages).first()
    assert parsed.title == native.title and parsed.description == native.description
    assert [(x.url, x.text) for x in parsed.links] == [(x.url, x.text) for x in native.links]
    assert parsed.text == native.text == "About L"


BODIES = [
    "User-agent: *\nDisallow: /en/\nAllow: /",
    "# note\nUser-agent: other\nUser-agent: LoomBot\nAllow: /en/6\nDisallow: /en\nCrawl-delay: 5\n"
    "User-agent: *\nDisallow: /",
    "User-agent: loombot\n\nDisallow: /\nUser-agent: *\nDisallow:",
    "Disallow: /\nUser-agent: some # x\nDisallow: /\nUser-agent: *\nAllow: /fr\nDisallow: /f",
    "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b\nUser-agent: loom\nDisallow: /c?x",
    "user-agent : LOOMBOT/2.0\ndisallow : /\nuser-agent: bot\nallow: /",
    "User-agent: *\nUser-agent: loombot\nDisallow: /a\nnonsense\nSitemap: x\nUser-agent: z\nAllow: /",
    "",
    "User-agent: *\r\nDisallow: *\r\n",
]
PATHS = ["", "/", "/en/6", "/en/7", "/en", "/fr/1", "/f", "/a", "/b/c", "/c?x=1", "/c", "/x?"]


def test_robots_rules_agree_with_the_standard_parser(spark):
    hosts = [(f"h{i}.com", body) for i, body in enumerate(BODIES)]
    rules = robots_rules(spark.createDataFrame(hosts, "host string, body string"), "LoomBot/1.0")
    pages = spark.createDataFrame(
        [(f"https://{h}{p}",) for (h, _), p in itertools.product([*hosts, ("none.com", "")], PATHS)],
        "url string",
    )
    expected = {}
    for host, body in [*hosts, ("none.com", "")]:
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        for path in PATHS:
            url = f"https://{host}{path}"
            expected[url] = parser.can_fetch("LoomBot/1.0", url)
    found = {r.url: r.robots_allowed for r in with_robots_verdict(pages, rules).collect()}
    assert found == expected


def test_robots_hosts_match_in_any_case(spark):
    rules = robots_rules(spark.sql("select 'a.com' host, 'User-agent: *\nDisallow: /' body"), "x")
    pages = spark.sql("select 'https://A.com/b' url")
    assert with_robots_verdict(pages, rules).select(F.col("robots_allowed")).first()[0] is False


@pytest.mark.parametrize("section", ["<![foo[ bar ]]>", "<![if !IE]>", "<![CDATA[ x ]]>"])
def test_pages_go_on_behind_marked_sections(section):
    page = read_page(f"<p>x</p>{section}<p>rest <a href='/y'>of page</a></p>", "https://a.in", None)
    assert page["text"].startswith("x") and page["text"].endswith("rest of page")
    assert [link["url"] for link in page["links"]] == ["https://a.in/y"]


def test_parsed_pages_go_back_part_by_part(spark, monkeypatch):
    """A task holds the objects of few pages, however many an Arrow batch has."""
    body = "<title>T</title><p>" + "<a href='/x'>word</a> " * 10_000
    rows = [(i, "https://a.b/", None if i % 7 == 3 else f"{i}{body}") for i in range(40)]
    rows.insert(5, (40, "https://a.b/", "<p>" + "long " * 500_000))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = parse_pages(pages).select("page_id", "title", "text", F.size("links").alias("n"))
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, function, schema: function)
    batch = pa.record_batch(list(zip(*rows)), names=["page_id", "url", "html"])
    sizes = dict(zip(batch.column(0).to_pylist(), pc.binary_length(batch.column(2)).to_pylist()))
    parts = list(parse_pages(pages)(iter([batch, batch.slice(0, 0)])))
    got = [r for part in parts for r in part.to_pylist()]
    assert [r["page_id"] for r in got] == [r[0] for r in rows]
    for part in parts:
        own = [sizes[i] or 0 for i in part.column(0).to_pylist()]
        assert sum(own[:-1]) <= 1 << 20
    assert {(r["page_id"], r["title"], r["text"], len(r["links"])) for r in got} == {
        tuple(r) for r in whole.collect()
    }


def test_pages_are_parsed_and_written_in_small_batches(spark, tmp_path):
    """A worker gets few pages at once, and the session keeps its own batches."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    rows = spark.range(0, 3000, 1, 1)
    write_parsed(rows.mapInArrow(sizes, "n long"), str(tmp_path / "parsed"))
    found = [r.n for r in spark.read.parquet(str(tmp_path / "parsed")).collect()]
    assert sum(found) == 3000 and max(found) <= 256
    assert spark.conf.get(setting) == before


def test_large_pages_are_parsed_and_written_in_batches_of_few_bytes(spark, tmp_path):
    """A batch ends at some MB, however large its pages are, and the session keeps its own limit."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    pages = spark.range(0, 600, 1, 1).selectExpr("id", "repeat('<p>text</p>', 10000) as html")
    write_parsed(pages.mapInArrow(sizes, "n long, size long"), str(tmp_path / "parsed"))
    found = spark.read.parquet(str(tmp_path / "parsed")).collect()
    assert sum(r.n for r in found) == 600 and max(r.size for r in found) <= 5 << 20
    assert spark.conf.get(setting, None) == before
