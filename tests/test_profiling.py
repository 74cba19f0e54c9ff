"""Geo profile against the known cases."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from leadloom.operators.profiling import add_geo_profile, add_language, apply_geo_profile

# email, phone, country -> code, confidence
CASES = [
    ("infos@itp.dz", "+21321213412", "Algeria", "DZ", 1.0),
    ("infos@itp.dz", None, None, "DZ", 0.3),
    (None, "+213213412341", None, "DZ", 0.4),
    (None, "0021321213412", None, "DZ", 0.4),
    (None, None, "Algerie", "DZ", 0.6),
    (None, None, "Algérie", "DZ", 0.6),
    ("raj@example.in", "+919876543210", "India", "IN", 1.0),
    (None, None, "Bharat", "IN", 0.6),
    (None, None, "in", "IN", 0.6),
    ("ceo@acme.com", None, None, None, 0.0),
    ("founder@startup.io", None, None, None, 0.0),
    ("ceo@acme.com", None, "Germany", "DE", 0.6),
    (None, "+21321111111", "India", "IN", 0.6),
    ("x@y.dz", "+21321111111", "Wakanda", "DZ", 0.7),
    ("x@y.dz", "+21321111111", "India", "DZ", 0.7),
    ("a@b.fr", None, "France", "FR", 0.9),
    ("", "", "", None, 0.0),
    (None, "9876543210", None, None, 0.0),
    ("not-an-email", None, None, None, 0.0),
    ("ceo@sub.domain.dz", None, None, "DZ", 0.3),
    ("x@bbc.co.uk", None, None, "GB", 0.3),
    (None, None, "UK", "GB", 0.6),
    (None, None, "Great Britain", "GB", 0.6),
    (None, "+12125551234", None, "US", 0.4),
    (None, "+77011234567", None, "RU", 0.4),
    (None, None, "Atlantis", None, 0.0),
    ("a@b.co", None, None, None, 0.0),
]


@pytest.fixture(scope="module")
def profiles(spark):
    rows = spark.createDataFrame(
        [(i, *case[:3]) for i, case in enumerate(CASES)],
        "i int, email string, phone string, country string",
    )
    return add_geo_profile(rows)


def test_code_and_confidence(profiles):
    found = profiles.orderBy("i").select("profile.country_code", "profile.confidence").collect()
    assert [tuple(r) for r in found] == [case[3:] for case in CASES]


def test_profile_fields_and_signals(profiles):
    first = profiles.where("i = 0").first().profile
    assert (first.country, first.search_locale, first.language) == ("Algeria", "dz", "fr")
    assert first.signals == [
        "csv_country='Algeria'->DZ", "phone_prefix='+21321'->DZ", "email_tld='.dz'->DZ",
    ]
    signals = {r.i: r.profile.signals for r in profiles.collect()}
    assert signals[9] == ["email_tld='.com'->generic(ignored)"]
    assert signals[13][0] == "csv_country='Wakanda'->unknown"
    assert signals[16] == signals[17] == signals[18] == []


def test_every_vote_combination(spark):
    """The closed form equals the weighted vote for all combinations of three codes and none."""
    names = {None: None, "DZ": "Algeria", "FR": "France", "IN": "India"}
    phones = {None: None, "DZ": "+2135", "FR": "+335", "IN": "+915"}
    mails = {None: None, "DZ": "a@b.dz", "FR": "a@b.fr", "IN": "a@b.in"}
    combinations = list(itertools.product(names, repeat=3))
    rows = spark.createDataFrame(
        [(i, mails[m], phones[p], names[c]) for i, (c, p, m) in enumerate(combinations)],
        "i int, email string, phone string, country string",
    )
    found = add_geo_profile(rows).select("i", "profile.*").orderBy("i").collect()
    for row, votes in zip(found, combinations):
        tally = {}
        for code, weight in zip(votes, (0.6, 0.4, 0.3)):
            if code:
                tally[code] = tally.get(code, 0) + weight
        winner = max(tally, key=tally.get) if tally else None
        assert row.country_code == winner
        assert row.confidence == round(min(tally.get(winner, 0), 1.0), 3)


def test_fill_only_if_missing(spark):
    rows = spark.sql(
        "select * from values ('a@b.dz', '', null), ('a@b.dz', 'Wakanda', '+335'), "
        "('a@b.com', 'Atlantis', null) as t(email, country, phone)"
    ).withColumn("detected_country_code", F.lit("XX"))
    found = apply_geo_profile(add_geo_profile(rows)).select(
        "country", "detected_country_code", "search_locale"
    ).collect()
    assert sorted(map(tuple, found), key=str) == [
        ("Algeria", "DZ", "dz"), ("Atlantis", None, None), ("Wakanda", "FR", "fr"),
    ]


def test_language_lookup(spark):
    rows = spark.sql("select * from values ('dz'), ('IN'), ('xx'), (null) as t(code)")
    found = {r.code: r.language for r in add_language(rows, "code").collect()}
    assert found == {"dz": "fr", "IN": "en", "xx": None, None: None}
