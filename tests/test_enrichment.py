"""Search plans, results, prompts, coercion, evidence, the enrichment run."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from leadloom.constants import DEFAULT_TAXONOMY
from leadloom.operators.extraction import (
    add_coerced_answer,
    add_extraction,
    add_stand_in_extraction,
)
from leadloom.operators.pages import (
    SITE_FIELDS,
    add_about_pages,
    fetched_pages,
    parse_pages,
    site_records,
    with_texts,
)
from leadloom.operators.search import (
    add_prompt,
    add_search_plan,
    join_results,
    quoted_term,
    stand_in_results,
)
from leadloom.plans.catalogue import QUERIES
from leadloom.plans.enrichment import enrich_leads, enrichment_record

TAXONOMY = list(DEFAULT_TAXONOMY)
PLAN_INPUT = (
    "i int, name string, company_name string, country string, city string, search_locale string, "
    "language string, has_scraped_data boolean"
)
# inputs -> company query, person query, params
PLANS = [
    (("Karim Belaid", "GROUPE RYMM", "Algeria", None, "dz", "fr", None),
     '"GROUPE RYMM" Algeria', 'site:linkedin.com "Karim Belaid" "GROUPE RYMM"',
     {"gl": "dz", "hl": "fr"}),
    (("Alice", "Acme", None, "Pune", None, None, None),
     '"Acme" Pune', 'site:linkedin.com "Alice" "Acme"', {}),
    (("X", "Foo Co", None, None, None, None, False),
     '"Foo Co"', 'site:linkedin.com "X" "Foo Co"', {}),
    (("Karim", "GROUPE RYMM", "Algeria", None, "dz", "fr", True),
     None, 'site:linkedin.com "Karim" "GROUPE RYMM"', {"gl": "dz", "hl": "fr"}),
    ((None, "GROUPE RYMM", "Algeria", None, None, None, None), '"GROUPE RYMM" Algeria', None, {}),
    (("Alice", None, None, None, None, None, None), None, 'site:linkedin.com "Alice"', {}),
    ((None, 'ACME "International" Ltd', "FR", None, None, None, None),
     '"ACME International Ltd" FR', None, {}),
    (("  ", "", "  ", "Pune", " ", None, None), "Pune", None, {}),
    (("N", "Acme", "France", "Paris", "DZ", " FR ", None),
     '"Acme" France', 'site:linkedin.com "N" "Acme"', {"gl": "dz", "hl": "fr"}),
]


def test_search_plans(spark):
    rows = spark.createDataFrame([(i, *p[0]) for i, p in enumerate(PLANS)], PLAN_INPUT)
    found = add_search_plan(rows).orderBy("i").select("plan.*").collect()
    assert [tuple(r) for r in found] == [p[1:] for p in PLANS]


def test_quoted_terms(values):
    assert values(quoted_term, ['a "b" c', ' "" ', "", None, "x$1"]) == [
        '"a b c"', None, None, None, '"x$1"',
    ]


def test_stand_in_results(spark):
    rows = spark.createDataFrame([(i, *p[0]) for i, p in enumerate(PLANS)], PLAN_INPUT)
    found = stand_in_results(add_search_plan(rows)).orderBy("i").collect()
    first = found[0]
    assert [r.link for r in first.company_results] == [
        "https://www.grouperymm.example", "https://www.linkedin.com/company/groupe-rymm",
    ]
    assert first.company_results[0].snippet == (
        "GROUPE RYMM is a B2B supplier based in Algeria, serving industrial customers."
    )
    assert first.person_results[0].link == "https://www.linkedin.com/in/karim-belaid"
    assert found[3].company_results == [] and len(found[3].person_results) == 1
    assert found[4].person_results == [] and found[5].company_results == []


def test_results_join_keeps_all_and_fills(spark):
    leads = spark.sql("select 'a' email union all select 'b'")
    results = spark.sql(
        "select 'a' email, transform(sequence(1, 8), i -> named_struct('title', 't' || i, 'link', "
        "'l', 'snippet', 's')) company_results, cast(null as array<struct<title:string,"
        "link:string,snippet:string>>) person_results"
    )
    found = {r.email: r for r in join_results(leads, results).collect()}
    assert [x.title for x in found["a"].company_results] == [f"t{i}" for i in range(1, 9)]
    assert found["a"].person_results == found["b"].company_results == []


SITE = (
    "struct<status:string,error:string,final_url:string,title:string,description:string,"
    "text:string,about_url:string,about_text:string,social_links:map<string,string>>"
)
RESULTS = "array<struct<title:string,link:string,snippet:string>>"
GOOD_SITE = (
    "ok", None, "https://www.rymm.com", "RYMM | Emballage", "Leader algérien", "Fondé en 1995",
    "https://www.rymm.com/about", "200 employés",
    {"linkedin": "https://www.linkedin.com/company/rymm", "facebook": "https://facebook.com/rymm"},
)
SNIPPETS = (
    [("D", "https://www.directory.dz/rymm", 'Plastics "maker"'),
     ("L", "https://www.linkedin.com/company/wrong", "x")],
    [("K", "https://www.linkedin.com/in/karim", "Head")],
)


@pytest.fixture(scope="module")
def leads(spark):
    failed = ("http_error", "404", None, None, None, "", None, "", None)
    rows = [
        ("k@itp.dz", "Karim", "RYMM", "Algiers", None, "Algeria", "DZ", "fr", "http://rymm.com",
         " Met at expo ", GOOD_SITE, *SNIPPETS),
        ("x@y.com", None, "Acme", None, None, None, None, None, None, None, None, [], []),
        ("f@y.com", "F", None, None, None, None, None, None, None, "", failed, *SNIPPETS),
    ]
    return spark.createDataFrame(
        rows,
        "email string, name string, company_name string, city string, state string, country string,"
        "detected_country_code string, language string, website_csv string, notes string, "
        f"site {SITE}, company_results {RESULTS}, person_results {RESULTS}",
    )


def test_prompts(leads):
    prompts = {r.email: r.prompt for r in add_prompt(leads, TAXONOMY).collect()}
    full = prompts["k@itp.dz"]
    expected_start = """PROSPECT CONTEXT (from CSV + Phase 2 data profiler):
  Contact: Karim
  Email: k@itp.dz (domain: itp.dz)
  Company: RYMM
  Location: Algiers, ?, Algeria [DZ]
  Likely working language: fr
  CSV-supplied website: http://rymm.com
  CSV notes: Met at expo

PRIMARY SOURCE — Company website (scraped from https://www.rymm.com):
  Title: RYMM | Emballage
  Meta description: Leader algérien
  Homepage text:
Fondé en 1995
  About page (https://www.rymm.com/about):
200 employés
  Social links found on site: """
    assert full.startswith(expected_start)
    socials = full[len(expected_start):].split("\n")[0]
    assert json.loads(socials) == GOOD_SITE[-1]
    names = ("title", "link", "snippet")
    for results in SNIPPETS:
        indented = json.dumps([dict(zip(names, r)) for r in results], ensure_ascii=False, indent=2)
        assert indented in full
    assert f"one of {TAXONOMY}," in full and full.endswith("}")
    bare = prompts["x@y.com"]
    assert "Location: ?, ?, ?\n" in bare and "NOT PROVIDED" in bare and "CSV notes" not in bare
    assert "(none — website data is the only source)" in bare and "None" not in bare
    assert "NOT AVAILABLE (status=http_error 404)" in prompts["f@y.com"]


def test_evidence_priority(leads):
    found = {r.email: r.extracted for r in add_stand_in_extraction(leads, TAXONOMY).collect()}
    own = found["k@itp.dz"]
    assert own.company_website == "https://www.rymm.com"
    assert own.company_description == "Leader algérien"
    assert own.company_linkedin == "https://www.linkedin.com/company/rymm"
    assert own.person_linkedin == "https://www.linkedin.com/in/karim"
    assert 0.7 <= own.industry_confidence <= 0.95
    failed = found["f@y.com"]
    assert failed.company_website == "https://www.directory.dz/rymm"
    assert failed.company_description == 'Plastics "maker"'
    assert failed.company_linkedin == "https://www.linkedin.com/company/wrong"
    assert 0.55 <= failed.industry_confidence <= 0.85
    nothing = found["x@y.com"]
    assert (nothing.company_website, nothing.person_linkedin) == (None, None)
    assert all(x.industry in TAXONOMY[:-1] and 0.3 <= x.relevance_score <= 0.95
               for x in found.values())


ANSWERS = {
    '{"industry":"FMCG","company_size":"small","industry_confidence":0.4,"relevance_score":0.3}':
        ("FMCG", 0.4, "small", 0.3),
    '{"industry":"Moon","company_size":"huge","industry_confidence":"1e-1",'
    '"relevance_to_plastics_machinery":"x","relevance_score":0.9}': ("Unknown", 0.1, "unknown", 0.0),
    '{"industry_confidence":-1,"relevance_to_plastics_machinery":0,"relevance_score":"2"}':
        ("Unknown", 0.0, "unknown", 1.0),
    '{"industry_confidence":null,"relevance_to_plastics_machinery":true}':
        ("Unknown", 0.0, "unknown", 1.0),
    '{"industry_confidence":[1],"relevance_to_plastics_machinery":[],"relevance_score":0.2}':
        ("Unknown", 0.0, "unknown", 0.2),
    "{}": ("Unknown", 0.0, "unknown", 0.0),
    "nonsense": ("Unknown", 0.0, "unknown", 0.0),
}


def test_coercion(spark):
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, answer string")
    found = add_coerced_answer(rows, TAXONOMY).orderBy("i").select(
        "extracted.industry", "extracted.industry_confidence", "extracted.company_size",
        "extracted.relevance_score",
    ).collect()
    assert [tuple(r) for r in found] == list(ANSWERS.values())


def test_bad_answers_fall_back(leads):
    answered = leads.withColumn(
        "answer",
        F.when(F.col("email") == "k@itp.dz", '{"industry":"Packaging"}')
        .when(F.col("email") == "f@y.com", "not json"),
    )
    found = {r.email: r.extracted for r in add_extraction(answered, TAXONOMY).collect()}
    stand_in = {r.email: r.extracted for r in add_stand_in_extraction(leads, TAXONOMY).collect()}
    assert (found["k@itp.dz"].industry, found["k@itp.dz"].company_website) == ("Packaging", None)
    assert found["f@y.com"] == stand_in["f@y.com"] and found["x@y.com"] == stand_in["x@y.com"]


def test_evidence_record(leads):
    rows = add_stand_in_extraction(
        leads.withColumn("search_locale", F.lit("dz"))
        .withColumn("has_scraped_data", F.col("site").isNotNull()).transform(add_search_plan),
        TAXONOMY,
    )
    records = {
        r.email: json.loads(r.record)
        for r in rows.select("email", enrichment_record().alias("record")).collect()
    }
    full = records["k@itp.dz"]
    assert list(full) == ["snippets", "scraped", "profile", "search_plan", "extracted_fields"]
    assert full["scraped"]["social_links"] == GOOD_SITE[-1]
    assert full["profile"] == {
        "country": "Algeria", "country_code": "DZ", "search_locale": "dz", "language": "fr",
    }
    assert full["search_plan"]["company_query"] is None
    assert len(full["extracted_fields"]) == 9 and full["extracted_fields"]["sub_category"] is None
    assert "scraped" not in records["x@y.com"]
    assert records["x@y.com"]["snippets"] == {"company_results": [], "person_results": []}


def test_enrichment_run_updates_the_cohort_only(spark):
    stored = spark.sql(
        """select * from values
        ('a@x.dz', 'A', 'Acme', null, null, 'Algeria', 'DZ', 'dz', 'rymm.com', null, null, null),
        ('b@x.dz', 'B', 'Beta', null, null, 'Algeria', 'DZ', 'dz', null, 'Old',
         timestamp '2024-01-01 00:00:00', null)
        as t(email, name, company_name, city, state, country, detected_country_code, search_locale,
             website_csv, industry, enriched_at, updated_at)"""
    ).selectExpr("*", "cast(updated_at as timestamp) u").drop("updated_at").withColumnRenamed(
        "u", "updated_at"
    )
    sites = spark.createDataFrame(
        [("https://rymm.com", 1, *GOOD_SITE)],
        "url_norm string, page_id long, status string, error string, final_url string, "
        "title string, description string, text string, about_url string, about_text string, "
        "social_links map<string,string>",
    )
    now = F.expr("timestamp '2024-02-01 00:00:00'")
    found = {r.email: r for r in enrich_leads(stored, sites, TAXONOMY, now).collect()}
    assert found["a@x.dz"].company_website == "https://www.rymm.com"
    assert found["a@x.dz"].updated_at is not None and found["a@x.dz"].industry in TAXONOMY
    assert (found["b@x.dz"].industry, found["b@x.dz"].updated_at) == ("Old", None)
    assert found["b@x.dz"].company_website is None
    everyone = enrich_leads(stored, sites, TAXONOMY, now, run_type="full")
    assert everyone.where("updated_at is null").count() == 0


def test_failed_fetches_and_about_pages(spark):
    """Every outcome on its way into the site record, narrow and whole; answers written by hand."""
    home = "<title>T</title><body>Home <a href='/about'>About</a><a href='https://x.com/h'>X</a>"
    about = (
        "<body>About us <a href='https://x.com/late'>X</a>"
        "<a href='https://www.instagram.com/i'>I</a>"
    )
    rows = [
        (1, "https://a.in", home, 200, "text/html", None, True),
        (2, "https://a.in/about", about, 200, "text/html", None, True),
        (3, "https://b.in", home, 404, "text/html", None, True),
        (4, "https://c.in", home, None, None, "timeout", True),
        (5, "https://d.in", home, None, None, "ConnectError", None),
        (6, "https://e.in", home, 200, "text/html", None, False),
        (7, "https://f.in", "%PDF", 200, "application/pdf", None, True),
        (8, "https://g.in", home, 200, "text/html", None, True),
        (9, "https://g.in/about", about, 500, "text/html", None, True),
        (10, "https://a.in/", "again", 200, "text/html", None, True),
    ]
    fetches = spark.createDataFrame(
        rows, "page_id long, url string, html string, status_code int, content_type string, "
        "error string, robots_allowed boolean"
    )
    told = fetched_pages(fetches)
    pages = parse_pages(told).join(told.select("page_id", "status", "error"), "page_id")
    narrow = add_about_pages(site_records(pages, texts=False))
    assert "text" not in narrow.columns and "about_text" not in narrow.columns
    whole = with_texts(narrow.select(F.struct("*").alias("site")), pages).select("site.*")
    assert whole.columns == ["page_id", *SITE_FIELDS]
    found = {r.page_id: r for r in whole.collect()}
    assert {i: (r.status, r.error) for i, r in found.items()} == {
        1: ("ok", None), 2: ("ok", None), 3: ("http_error", "http_error"),
        4: ("timeout", "timeout"), 5: ("network_error", "network_error"),
        6: ("blocked_by_robots", None), 7: ("not_html", "not_html"), 8: ("ok", None),
        9: ("http_error", "http_error"),
    }
    first = found[1]
    assert (first.title, first.text, first.about_url) == (
        "T", "Home About X", "https://a.in/about")
    assert first.about_text == "About us X I"
    assert list(first.social_links.items()) == [
        ("twitter", "https://x.com/h"), ("instagram", "https://www.instagram.com/i")]
    assert found[8].about_text == "" and found[8].about_url == "https://g.in/about"
    for i in (3, 4, 5, 6, 7, 9):
        r = found[i]
        assert (r.title, r.text, r.about_url, r.about_text, r.social_links) == (
            None, None, None, None, {})
    assert found[6].final_url is None and found[3].final_url == "https://b.in"


def test_texts_are_joined_last(spark):
    """Whole texts are read by one scan, behind all other joins."""
    plan = QUERIES["prompt_column"](spark, "/root/testdata/sf0.001")
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "FileScan" in line and "text:string" in line]
    assert len(scans) == 1
    narrow = QUERIES["page_join"](spark, "/root/testdata/sf0.001")
    text = narrow._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in text.splitlines() if "FileScan" in x and "text:string" in x]
