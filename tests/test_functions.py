"""Column functions against known values."""

from __future__ import annotations

import sys

import pytest
from pyspark.sql import functions as F

from leadloom.constants import CONSOLE_SECRET_KEYS
from leadloom.functions import geo
from leadloom.functions.contacts import (
    clean_website,
    email_domain,
    email_tld,
    full_name,
    normalise_email,
    normalise_phone,
    quality_score,
)
from leadloom.functions.markup import decode_body, read_page
from leadloom.functions.rates import parse_rate
from leadloom.functions.redact import mask_nested_text, mask_scalars, mask_text
from leadloom.functions.text import WHITESPACE, filled, json_string, percent, strip
from leadloom.functions.urls import absolute_url, canonical_url, link_base, url_host, url_path
from leadloom.sources.runlogs import log_lines


def test_strip_takes_all_whitespace(values):
    texts = [f" \t a b{WHITESPACE}", "   ", "", None, " x　"]
    assert values(strip, texts) == ["a b", "", "", None, "x"]
    assert values(filled, texts) == ["a b", None, None, None, "x"]


EMAILS = {
    " Raj@Example.IN ": "raj@example.in",
    "a.b+c@sub.domain.co.uk": "a.b+c@sub.domain.co.uk",
    "": None,
    "   ": None,
    "not-an-email": None,
    "a@b": None,
    "a@@b.com": None,
    ".a@b.com": None,
    "a..b@c.com": None,
    "a@-b.com": None,
    "a@b-.com": None,
    "a@b.c1": None,
    "a@host.test": None,
    "a@x.localhost": None,
    "a@test.com": "a@test.com",
    "two@a.com, three@b.com": None,
    "x" * 64 + "@a.com": "x" * 64 + "@a.com",
    "x" * 65 + "@a.com": None,
    "a@" + "b" * 63 + ".com": "a@" + "b" * 63 + ".com",
    "a@" + "b" * 64 + ".com": None,
    "a@" + "b23456789." * 25 + "com": None,
    "a\nb@c.com": None,
}


def test_emails(values):
    assert dict(zip(EMAILS, values(normalise_email, EMAILS))) == EMAILS


PHONES = {
    "9876543210": "+919876543210",
    "+91 98765-43210": "+919876543210",
    "09876543210": "+919876543210",
    "0033 123456789": "+33123456789",
    "+1 (212) 555-1234": "+12125551234",
    "---": None,
    "": None,
    "123456": None,
    "1234567": "+1234567",
    "1234567890123456": None,
    "00": None,
}


def test_phones(values):
    assert dict(zip(PHONES, values(normalise_phone, PHONES))) == PHONES
    assert values(lambda c: normalise_phone(c, "213"), ["0555123456", "555 123 4567", None]) == [
        "+555123456", "+2135551234567", None,
    ]


def test_websites(values):
    assert values(clean_website, ["  a.com/ ", "a.com//", "/", "", None, "a.com"]) == [
        "a.com", "a.com/", "/", None, None, "a.com",
    ]


URLS = {
    "www.example.com": "https://www.example.com",
    "https://www.example.com/": "https://www.example.com",
    "https://www.example.com/about/": "https://www.example.com/about",
    "http://example.com": "http://example.com",
    "https://example.com/path?q=1": "https://example.com/path?q=1",
    "  https://example.com  ": "https://example.com",
    "": None,
    "   ": None,
    "not a url": "https://not a url",
    "http://": None,
    "https:///path": None,
    "HTTP://Example.COM/A//": "http://Example.COM/A",
    "hTTpS://a.b": "https://a.b",
    "a.com/x;p=1;q?z#f": "https://a.com/x?z",
    "a.com/x;y/z/": "https://a.com/x;y/z",
    "a.com/a/;p": "https://a.com/a",
    "a.com?": "https://a.com",
    "a.com/#top": "https://a.com",
    "a.com?x=http://b/": "https://a.com?x=http://b/",
}


def test_canonical_urls(values):
    assert dict(zip(URLS, values(canonical_url, URLS))) == URLS
    assert values(canonical_url, [None]) == [None]
    assert values(url_host, ["https://a.b:80/c?d"]) == ["a.b:80"]
    assert values(url_path, ["https://a.b:80/c?d"]) == ["/c"]


def test_absolute_urls_agree_with_urljoin(spark):
    from urllib.parse import urljoin

    bases = ["https://a.b", "https://a.b/", "http://a.b/c/d?q=1#f", "https://a.b/c/"]
    hrefs = ["/x", "x", "x/y?z", "?k=1", "#t", "//c.d/e", "mailto:u@v", "https://o.p/q", ""]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    found = rows.select(
        "base", "href", absolute_url(link_base("base"), F.col("href")).alias("url")
    ).collect()
    assert [(r.base, r.href, r.url) for r in found] == [
        (r.base, r.href, urljoin(r.base, r.href)) for r in found
    ]


def test_email_parts(values):
    emails = ["a@sub.Domain.DZ", "x@y", "no-at", "a@b@c.fr", None]
    assert values(email_domain, emails) == ["sub.domain.dz", "y", None, "c.fr", None]
    assert values(email_tld, emails) == ["dz", None, None, "fr", None]


def test_country_keys(values):
    assert values(geo.country_name_key, [" Algérie ", "ESPAÑA", "Straße"]) == [
        "algerie", "espana", "strasse",
    ]
    assert values(geo.country_from_iso, ["in", " FR ", "xx", "India", ""]) == [
        "IN", "FR", None, None, None,
    ]
    assert values(geo.calling_key, ["+21321", "0033 1", "(00)1 2", "+1 212", "98765", "++447"]) == [
        "213", "33", "1", "1", "", "44",
    ]
    tlds = ["dz", "uk", "gb", "co", "com", "xx"]
    assert values(lambda c: geo.country_from_tld(F.col(c)), tlds) == [
        "DZ", "GB", "GB", None, None, None,
    ]


def test_calling_codes_are_prefix_free():
    codes = [code for code, _ in geo.calling_code_rows()]
    assert len(codes) == len(set(codes)) == 62
    assert not [(a, b) for a in codes for b in codes if a != b and b.startswith(a)]


def test_names_and_quality(spark):
    rows = spark.sql(
        "select * from values ('Full', 'F', 'L'), (' ', 'F', 'L'), (null, 'F', ''), "
        "('', null, ' L '), ('', '', null) as t(n, f, l)"
    )
    names = [r[0] for r in rows.select(full_name("n", "f", "l")).collect()]
    assert names == ["Full", "F L", "F", "L", None]
    full = spark.sql(
        "select 'R' name, 'e' email, '+9' phone, 'X' company_name, 'P' city, 'M' state, '4' pincode"
    )
    assert full.select(quality_score()).first()[0] == 1.0
    bare = spark.sql(
        "select ' ' name, 'e' email, '' phone, null company_name, null city, null state, '' pincode"
    )
    assert bare.select(quality_score()).first()[0] == 0.3


def test_small_helpers(spark):
    assert parse_rate("5/minute") == (5, 60)
    assert parse_rate(" 2 / Hour ") == (2, 3600)
    with pytest.raises(ValueError):
        parse_rate("5/week")
    row = spark.sql("select 1 n, 0 t, 'a\"b\\\\c\né' s").select(
        percent(F.col("n"), F.lit(3)), percent(F.lit(0), F.col("t")), json_string(F.col("s")),
        json_string(F.lit(None).cast("string")),
    ).first()
    assert tuple(row) == (33.3, 0.0, '"a\\"b\\\\c\\né"', "null")


def test_masking(values):
    text = '{"API_KEY" : "a\\"b", "token":12, "note":"token", "x":{"secret":null}}'
    assert values(mask_scalars, [text]) == [
        '{"API_KEY" : "***REDACTED***", "token":"***REDACTED***", "note":"token", '
        '"x":{"secret":"***REDACTED***"}}'
    ]
    cookie = '{"Set-Cookie": "a", "password_hash": 1, "Name": "b"}'
    assert values(lambda c: mask_scalars(c, CONSOLE_SECRET_KEYS), [cookie]) == [
        '{"Set-Cookie": "***REDACTED***", "password_hash": "***REDACTED***", "Name": "b"}'
    ]
    keys = frozenset({"token"})
    assert mask_text('{"a": [{"Token": {"k": [1]}}], "t": 1}', keys) == (
        '{"a": [{"Token": "***REDACTED***"}], "t": 1}'
    )
    deep = '{"d": ' * 12 + '{"token": 1}' + "}" * 12
    assert mask_text(deep, keys) == deep.replace("1", '"***REDACTED***"')
    assert mask_text("no json", keys) == "no json" and mask_text(None, keys) is None


PAGE = """<html><head><title>Acme &amp; Co</title><meta name="Description" content=" Makers ">
<meta property="og:description" content="Other"><style>.x{}</style></head><body>
<p>Hello\n  world.</p><script>var x = "<p>no</p>";</script><svg><title>!</title>no</svg>
<a href="https://www.linkedin.com/company/acme">LinkedIn</a><a href="about">About <b>Us</b></a>
<a href="#top">Skip</a><a href="javascript:void(0)">JS</a><a>none</a></body></html>"""


def test_page_parser():
    page = read_page(PAGE, "https://a.com/x/y", None)
    assert page["title"] == "Acme & Co!"
    assert page["description"] == "Makers"
    assert page["text"] == "Hello world. LinkedIn About Us Skip JS none"
    assert [(x["pos"], x["url"], x["text"]) for x in page["links"]] == [
        (0, "https://www.linkedin.com/company/acme", "LinkedIn"),
        (1, "https://a.com/x/about", "About Us"),
    ]
    assert read_page(PAGE, "https://a.com", 11)["text"] == "Hello world"


def test_page_parser_odd_pages():
    open_head = "<head><title>T</title><body><p>seen</p>"
    assert read_page(open_head, "https://a.com", None)["text"] == "seen"
    og = '<meta property="og:description" content="OG"><p>x</p>'
    assert read_page(og, None, None)["description"] == "OG"
    twice = '<a href="/1">one<a href="/2">two</a>'
    assert [x["href"] for x in read_page(twice, "https://a.com", None)["links"]] == ["/2"]
    assert read_page(None, None, None)["text"] == ""


def test_body_decoding(spark):
    row = spark.sql("select cast('héé' as binary) a, X'68FFC3' b").select(
        decode_body("a", 2).alias("cut"), decode_body("a").alias("whole"), decode_body("b").alias("b")
    ).first()
    assert row.whole == "héé" and row.cut == "h�" and row.b.startswith("h�")


def test_reserved_and_hyphenated_domains_are_refused(values):
    texts = ["x@foo.-bar", "a@ab--cd.com", "a@b.xn--p1", "a.xx--b@mail.com", "a@b-c.com"]
    found = values(normalise_email, texts)
    assert found == [None, None, None, "a.xx--b@mail.com", "a@b-c.com"]


def test_secrets_are_masked_at_any_depth(spark):
    events = spark.sql("""
        select 1 as run_id, 'x' as event,
         named_struct('access', 's3cr3t') as token, array('k1') as api_key,
         named_struct('inner', array(named_struct('secret', 'p1', 'kept', 'v1'))) as deep,
         map('Secret', 'p2', 'other', 'v2') as texts,
         map('secret', array(1), 'other', array(2)) as lists,
         repeat('m', 3000) as message
    """)
    line = log_lines(events).first().value
    for hidden in ("s3cr3t", "k1", "p1", "p2", "[1]"):
        assert hidden not in line
    for shown in ("v1", "v2", "[2]", "m" * 3000):
        assert shown in line


def test_international_emails(values):
    """Answers written by hand."""
    cases = {
        "ü@exämple.de": "ü@exämple.de", "a@xn--exmple-cua.de": "a@exämple.de",
        "A@EXÄMPLE.DE": "a@exämple.de", "u\u0308@exa\u0308mple.de": "ü@exämple.de",
        "用户@例子。公司": "用户@例子.公司", "a@ab.xn--p1ai": "a@ab.рф", "a@faß.de": "a@faß.de",
        "a@xn--80ak6aa92e.com": "a@аррӏе.com", "é" * 64 + "@x.de": "é" * 64 + "@x.de",
        "é" * 65 + "@x.de": None, "a@" + "ä" * 60 + ".de": None, "é@x": None, "é..a@x.de": None,
        ".é@x.de": None, "é@x-.de": None, "a\u00a0b@x.de": None, "\u0301a@x.de": None,
        "a\u200b@x.de": None, "a@❤.ws": None, "a@xn--.de": None, "é@x.test": None, "é@@x.de": None,
        "é": None, "@é.de": None, "": None,
    }
    assert dict(zip(cases, values(normalise_email, list(cases)), strict=True)) == cases


def test_masking_of_deep_broken_and_repeated_json():
    keys = frozenset(("token", "api_key"))
    deep = 20_000
    cases = {
        "[" * deep + "]" * deep: "[" * deep + "]" * deep,
        '{"a":' * deep + '{"Token": {"x": [1]}}' + "}" * deep:
            '{"a": ' * deep + '{"Token": "***REDACTED***"}' + "}" * deep,
        "[" * deep: "[" * deep, "[" * deep + "}" * deep: "[" * deep + "}" * deep,
    }
    for text, want in cases.items():
        assert mask_text(text, keys) == want
    # the form with a stack of its own says the same as the parser on all that this one can read
    texts = [
        '{"a": 1, "token": [1, {"b": 2}], "a": {"API_KEY": null}}', "[]", "{}", "[[], {}, [{}]]",
        ' { "k" : [ 1.50 , -2e3 , true , null , "é\\u00e9\\n" ] } ', '"text"', "17", "null",
        "[1,]", "[1 2]", "{1: 2}", '{"a"}', '{"a":}', '{"a":1,}', "[1]]", "]", "{]", "", "  ", "nul",
        '{"a":1 "b":2}', '"open', "[1}", "NaN", "[,1]", '{"a" 1}', "[:]", "1 2", '{"a":[1,{"b":"]"}]}',
    ]
    for text in texts:
        assert mask_nested_text(text, keys) == mask_text(text, keys), text


def test_deep_json_is_masked_part_by_part():
    """Not token by token: the calls of a text grow with its parts."""
    keys = frozenset(("token",))
    deep = 5000
    text = '{"a":[' * deep + '{"token":[1]}' + "]}" * deep
    calls = 0

    def count(*_):
        nonlocal calls
        calls += 1

    sys.setprofile(count)
    try:
        masked = mask_nested_text(text, keys)
    finally:
        sys.setprofile(None)
    assert masked == '{"a": [' * deep + '{"token": "***REDACTED***"}' + "]}" * deep
    assert calls < 2 * deep
    # texts that hold what parts are marked with, keys written with escapes, parts that are dropped
    inner = '["0.1", 0.1, 0.11, "-", "--", "]\\"[", {"t\\u006fken": 1}]'
    shown = '["0.1", 0.1, 0.11, "-", "--", "]\\"[", {"token": "***REDACTED***"}]'
    for opened, closed in (("[", "]"), ('{"-": ', "}"), ("[0.1, ", ', "-"]')):
        assert mask_nested_text(opened * deep + inner + closed * deep, keys) == (
            opened * deep + shown + closed * deep
        )
    dropped = "[" * deep + "1" + "]" * deep
    assert mask_nested_text(f'{{"token": {dropped}, "a": {dropped}, "a": 2}}', keys) == (
        '{"token": "***REDACTED***", "a": 2}'
    )
    broken = dropped.replace("1", "1 [2]")
    assert mask_nested_text(broken, keys) == broken
