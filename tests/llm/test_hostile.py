"""Rows that once made an operator crash or lose data: clashing names, broken markup, cut characters,
short items, empty tables, repeated ids, ties."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

from leadloom.llm import (  # noqa: E402
    collision_dedup,
    decontaminate,
    html_extract,
    langid,
    queries,
    sentencepiece_codec,
    simhash,
    suffix_dedup,
)

PASSAGE = "the quick brown fox jumps over the lazy dog and runs far away from all of it "
CLASHING = (
    "_block string, block int, bucket int, removed int, kept string, bits string, _t0 string, "
    "_p0 string, _host string, _suffix string, _declared string, _letters string, _top string, "
    "hash int, shingle string, place int, ids string, decoded string, c0 string, key string"
)


def clashing(spark, rows):
    """(doc_id, text) among columns named like those that operators use."""
    filler = ["x" if "string" in c else 1 for c in CLASHING.split(", ")]
    return spark.createDataFrame(
        [(i, t, "en", "s", *filler) for i, t in rows],
        f"doc_id long, text string, lang string, source string, {CLASHING}",
    )


ROWS = [(1, "x�y " + PASSAGE), (2, "z�y " + PASSAGE + "end �"), (3, None), (4, ""),
        (2, "z�y " + PASSAGE + "end �"), (None, PASSAGE), (5, "é" * 60), (6, "aé" + "é" * 60)]


def test_suffix_dedup_of_clashing_names_and_repeated_ids(spark):
    docs = clashing(spark, ROWS)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    found = sorted(((r.doc_id or 0), r.text or "") for r in out.collect())
    # the rows of id 2 lose what row 1 holds and nothing to each other
    left = "zend �"
    assert found == sorted(
        [(1, ROWS[0][1]), (2, left), (2, left), (3, ""), (4, ""), (0, PASSAGE), (5, "é" * 60),
         (6, "a")]
    )
    digests = suffix_dedup.digests(suffix_dedup.removed_bytes(docs))
    assert digests.count() == len(ROWS)


def test_suffix_dedup_cuts_no_character(spark):
    """Runs that begin or end inside a character take the whole character and no other."""
    draw = random.Random(2)
    shared = "".join(draw.choices("aé日😀", k=60))
    rows = [(0, "x" + shared)] + [(i, draw.choice("éü日") + "�" + shared[i:] + "�é")
                                  for i in range(1, 8)]
    seen, want = {}, {}
    for i, text in rows:
        raw = text.encode()
        gone = {p + k for p in range(len(raw) - 49) if seen.setdefault(raw[p : p + 50], i) < i
                for k in range(50)}
        at, kept = 0, ""
        for ch in text:
            size = len(ch.encode())
            kept += "" if gone & set(range(at, at + size)) else ch
            at += size
        want[i] = kept
    found = suffix_dedup.without_repeats(clashing(spark, rows)).collect()
    assert {r.doc_id: r.text for r in found} == want
    assert sum("�" in t for t in want.values()) > 5 and sum(map(len, want.values())) < 400


def test_language_of_clashing_names_ties_and_repeats(spark):
    rows = [(i, text) for i, text in enumerate(
        ["the house and the tree"] * 5 + ["la maison et le jardin"] * 5 + [None, "", "123 !"]
    )]
    docs = clashing(spark, rows + rows[:3]).withColumn(
        "lang", F.when(F.col("doc_id") < 5, "en").when(F.col("doc_id") < 10, "fr")
    ).withColumn("confidence", F.lit("old"))
    out = langid.identify(docs, langid.fit(docs), host=F.col("source"), declared=F.col("lang"))
    assert set(out.columns) == {*docs.columns, "language", "confidence", "accepted"}
    found = out.collect()
    assert len(found) == len(rows) + 3
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add((r.language, r.accepted, r._t0, r._host))
    assert all(len(v) == 1 for v in by_id.values())  # repeated rows get the same answer
    assert [min(by_id[i])[:2] for i in (0, 7, 10, 11, 12)] == [
        ("en", True), ("fr", True), (None, False), (None, False), (None, False)
    ] and min(by_id[0])[2:] == ("x", "x")


def test_language_ties_go_to_the_first(spark):
    """The same texts under two labels: nothing tells the languages apart."""
    docs = spark.createDataFrame(
        [(i, "same words here", lang) for i, lang in enumerate(["b", "a"] * 4)],
        "doc_id long, text string, lang string",
    )
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert {r.language for r in found} == {"a"}


def test_short_items(spark):
    """Items of fewer words than a shingle stand in long texts too, in a row and whole."""
    docs = clashing(spark, [
        (1, "everyone says that Paris is nice, in the spring"), (2, "Paris is always nice"),
        (3, "paris is nice"), (4, None), (5, ""), (1, "again: Paris! is? nice."),
        (6, "nice"), (7, "paris is nicer"), (None, "paris is nice"),
    ])
    items = spark.createDataFrame(
        [(10, "paris is nice"), (11, "Nice"), (12, None), (13, "-"), (None, "nice"),
         (14, "everyone says that paris is nice in")], "item_id long, text string"
    )
    found = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles, r.containment)
             for r in decontaminate.contained_items(docs, items).collect()}
    assert found == {
        **{(d, 10): (1, 1, 1.0) for d in (1, 3)}, **{(d, 11): (1, 1, 1.0) for d in (1, 2, 3, 6)},
        (1, 14): (3, 3, 1.0),
    }
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in decontaminate.without_items(docs, items).collect()) == [
        0, 4, 5, 7
    ]


LINES = [f"This is line number {i} of the article, long enough to be read as such." for i in range(6)]
BODY = "".join(f"<p>{line}</p>" for line in LINES)
TEXT = " ".join(LINES)

# Pages marked by hand: what a reader would call the main text.
PAGES = {
    "marked section": (f"<article><![foo[ bar ]]>{BODY}</article>", TEXT),
    "marked section at the end": (f"<article>{BODY}</article><![if", TEXT),
    "cdata": (f"<article>{BODY}<![CDATA[x]]></article>", TEXT),
    "conditional": (f"<![if !IE]><article>{BODY}</article><![endif]>", TEXT),
    "broken declaration": (f"<!doctype html [<article>{BODY}</article>", None),
    "foot": (f"<div>{BODY}</div><div class=foot>Copyright 2020 All of us</div>", TEXT),
    "copyright": (f"<div>{BODY}</div><p class='copyright'>(c) 2020</p>", TEXT),
    "main role": (f"<div role=main>{BODY}</div><p>Beside it</p>", TEXT),
    "article role": (f"<p>Beside</p><div role=article><h1>T</h1>{BODY}</div>", f"T {TEXT}"),
    "complementary": (f"<div role=main>{BODY}</div><div role=complementary>{BODY * 3}</div>", TEXT),
    "navigation": (f"<article>{BODY}<div role='navigation'><a href=/>Next page</a></div></article>",
                   TEXT),
    "contentinfo": (f"<div>{BODY}</div><div role=ContentInfo>All rights reserved</div>", TEXT),
    "banner": (f"<div role=banner><p>Our site</p></div><div>{BODY}</div>", TEXT),
    "hidden": (f"<article><p hidden>Not shown</p>{BODY}</article>", TEXT),
    "hidden until found": (f"<article><p hidden=until-found>Shown</p>{BODY}</article>",
                           f"Shown {TEXT}"),
    "display none": (f"<article>{BODY}<div style='color:red; display : NONE'><p>No</p></div></article>",
                     TEXT),
    "visibility": (f"<article>{BODY}<span style=visibility:hidden>No</span></article>", TEXT),
    "hidden inside": (f"<article>{BODY}<p>A<b hidden>B</b>C and more of it.</p></article>",
                      f"{TEXT} AC and more of it."),
    "header role in article": (f"<article><div role=banner><h1>Title</h1></div>{BODY}</article>",
                               f"Title {TEXT}"),
    "dialog role": (f"<div role=dialog>Accept all of our cookies now</div><main>{BODY}</main>", TEXT),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_marked_by_hand(name):
    page, text = PAGES[name]
    found = html_extract.main_text(page)
    assert found == text if text is not None else isinstance(found, str)


def test_html_of_empty_tables_repeats_and_long_pages(spark):
    long = "<article>" + BODY * 3000 + "</article>"
    rows = [(1, long, "t"), (1, long, "t"), (2, None, "t"), (3, PAGES["marked section"][0], "t")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = html_extract.extract(pages)
    assert html_extract.extract(pages.limit(0)).count() == 0
    assert [r.text for r in found.orderBy("page_id").collect()] == [
        *[" ".join([TEXT] * 3000)] * 2, "", TEXT
    ]


def test_empty_tables(spark):
    docs = clashing(spark, [])
    assert suffix_dedup.without_repeats(docs).count() == 0
    assert suffix_dedup.digests(suffix_dedup.removed_bytes(docs)).count() == 0
    assert sentencepiece_codec.encode_texts(docs, queries.PIECE_MODEL).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert langid.identify(docs, langid.fit(docs)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert collision_dedup.near_duplicates(vectors).count() == 0


def test_repeated_ids(spark):
    docs = clashing(spark, [(1, PASSAGE), (1, PASSAGE), (1, "other words"), (2, PASSAGE), (3, None)])
    found = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found) == [(1, 1)] * 3 + [(2, 1), (3, 3)]
    vectors = spark.createDataFrame(
        [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])],
        "vec_id long, embedding array<float>",
    )
    found = [(r.vec_id, r.component_id) for r in collision_dedup.near_duplicates(vectors).collect()]
    assert sorted(found) == [(1, 1), (1, 1), (2, 1), (3, 3)]
