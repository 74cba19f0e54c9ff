"""Filters, pages, facets, clusters, taxonomy, selections, counters, logs, export."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from leadloom.constants import DEFAULT_TAXONOMY, EXPORT_COLUMNS, LIST_COLUMNS
from leadloom.operators import analytics, runlog
from leadloom.operators.analytics import filter_leads, sort_leads
from leadloom.operators.snapshots import (
    search_stored,
    stored_page,
    term_grams,
    write_zones,
    zones_with,
)
from leadloom.operators.taxonomy import (
    clean_taxonomy,
    default_taxonomy,
    read_taxonomy,
    taxonomy_setting,
)
from leadloom.operators.upsert import add_missing_columns, upsert_by_key
from leadloom.operators.validation import (
    mailbox_activity,
    mailbox_status,
    needs_enrichment,
    needs_profile,
    needs_validation,
    repair_activity,
    stand_in_status,
)
from leadloom.sources.runlogs import append_run_log, log_lines, read_run_log
from leadloom.sources.tables import (
    LEAD_COLUMNS,
    append_rows,
    read_table,
    write_export,
    write_snapshot,
)


@pytest.fixture(scope="module")
def leads(spark):
    rows = spark.sql(
        """select * from values
        (1L, 'Ann', 'ann@x.com', 'Acme', 'FMCG', 'Pune', 'MH', 'India', 'valid', 0.5D, 'a.csv'),
        (2L, 'Bob', 'bob@x.com', 'AcMe 50%', 'FMCG', 'Pune', null, '', 'invalid', null, 'a.csv'),
        (3L, null, 'cy@y.com', null, 'FMCG', 'Surat', 'GJ', 'India', 'catch-all', 0.9D, 'b.csv'),
        (4L, 'Dee', 'dee@y.com', 'Beta', 'Old', null, 'GJ', null, null, 0.1D, 'b.csv'),
        (5L, 'Eve', 'eve@y.com', 'Beta', null, 'Agra', 'UP', 'Nepal', '', 0.1D, 'b.csv')
        as t(id, name, email, company_name, industry, city, state, country, email_status,
             relevance_score, source_file)"""
    )
    stamped = rows.withColumn("created_at", F.timestamp_seconds(F.col("id") * 100))
    return add_missing_columns(stamped, LEAD_COLUMNS)


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(leads):
    assert _ids(analytics.filter_leads(leads, search=" ACME ")) == [1, 2]
    assert _ids(analytics.filter_leads(leads, search="x.com")) == [1, 2]
    assert _ids(analytics.filter_leads(leads, search="   ")) == [1, 2, 3, 4, 5]
    assert _ids(analytics.filter_leads(leads, search="a%e")) == [1, 2]
    assert _ids(analytics.filter_leads(leads, search=None, industry="FMCG", state="GJ")) == [3]
    assert _ids(analytics.filter_leads(leads, city="", country=None)) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        analytics.filter_leads(leads, colour="red")


def test_equality_filters_reach_the_scan(leads, tmp_path):
    leads.write.parquet(f"{tmp_path}/t")
    table = leads.sparkSession.read.parquet(f"{tmp_path}/t")
    plan = analytics.filter_leads(table, industry="FMCG").select("email")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(industry,FMCG)" in text and "ReadSchema: struct<email:string,industry" in text


def test_pages(leads):
    first = analytics.lead_page(leads, limit=2).collect()
    assert [r.id for r in first] == [5, 4] and first[0].total == 5
    assert tuple(first[0].asDict()) == (*LIST_COLUMNS, "total")
    assert [r.id for r in analytics.lead_page(leads, page=3, limit=2).collect()] == [1]
    ascending = analytics.lead_page(leads, sort="relevance_score", order="asc").collect()
    assert [r.id for r in ascending] == [2, 4, 5, 1, 3]
    with pytest.raises(ValueError):
        analytics.lead_page(leads, limit=500)
    with pytest.raises(ValueError):
        analytics.lead_page(leads, sort="phone")
    plan = analytics.lead_page(leads, limit=2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert analytics.lead_detail(leads, "id", 3, ("email",)).first().email == "cy@y.com"


def test_overview_and_labels(leads):
    assert analytics.overview(leads).first().asDict() == {
        "total": 5, "valid": 1, "invalid": 1, "risky": 1, "unknown": 1,
    }
    assert [tuple(r) for r in analytics.top_labels(leads, "state", 2).collect()] == [
        ("GJ", 2), ("MH", 1),
    ]
    counts = {r["label"]: r["count"] for r in analytics.status_counts(leads).collect()}
    assert counts == {"valid": 1, "invalid": 1, "catch-all": 1, "unknown": 2}
    facets = [tuple(r) for r in analytics.facet_options(leads, ("country", "state")).collect()]
    assert facets == [
        ("country", "India"), ("country", "Nepal"), ("state", "GJ"), ("state", "MH"), ("state", "UP"),
    ]


def test_industries(leads):
    cards = analytics.industry_cards(leads).collect()
    assert [(r.industry, r["count"], r.valid_pct, r.top_cities) for r in cards] == [
        ("FMCG", 3, 33.3, ["Pune", "Surat"]), ("Old", 1, 0.0, []),
    ]
    assert cards[0].avg_relevance == pytest.approx(0.7)
    detail = {(r.dim, r.label): r["count"] for r in analytics.industry_detail(leads, "FMCG").collect()}
    assert detail == {
        ("total", "FMCG"): 3, ("city", "Pune"): 2, ("city", "Surat"): 1, ("state", "MH"): 1,
        ("state", "GJ"): 1,
    }


def test_taxonomy(spark, leads):
    kept = read_taxonomy(taxonomy_setting(spark, [" FMCG ", "", "X"])).orderBy("position").collect()
    assert [r.label for r in kept] == ["FMCG", "X", "Unknown"]
    for value in ("'nonsense'", "'[1]'", "'{}'", "null", "'[null]'", "'[\"a\", null]'", "''"):
        settings = spark.sql(f"select 'industry_taxonomy' key, {value} value")
        labels = [r.label for r in read_taxonomy(settings).orderBy("position").collect()]
        assert labels == list(DEFAULT_TAXONOMY), value
    assert default_taxonomy(spark).count() == 20
    column = spark.sql("select array(' a ', '', 'Unknown') x").select(clean_taxonomy(F.col("x")))
    assert column.first()[0] == ["a", "Unknown"]
    changed = analytics.reclassify_unknown(leads, default_taxonomy(spark))
    assert {r.id: (r.industry, r.reclassified) for r in changed.collect()} == {
        1: ("FMCG", False), 2: ("FMCG", False), 3: ("FMCG", False), 4: ("Unknown", True),
        5: (None, False),
    }


def test_mailbox_results(spark, values):
    statuses = ["valid", "spamtrap", "do_not_mail", "catch-all", "new", None]
    assert values(mailbox_status, statuses) == [
        "valid", "invalid", "invalid", "catch-all", "unknown", "unknown",
    ]
    assert values(mailbox_activity, statuses) == [
        "active", "inactive", "inactive", "unknown", "unknown", "unknown",
    ]
    mails = ["a@x.com", "bb@y.com", "ccc@zz.in", "é@x.com"]
    digits = [sum(map(ord, m)) % 10 for m in mails]
    expected = [
        ("valid", round(0.7 + d / 30, 2)) if d < 6 else ("catch-all", 0.5) if d < 8
        else ("invalid", 0.0) for d in digits
    ]
    rows = spark.createDataFrame([(m,) for m in mails], "email string")
    found = rows.withColumns(stand_in_status("email")).collect()
    assert [(r.email_status, r.email_activity_score) for r in found] == expected


def test_selections_and_repair(spark):
    rows = spark.sql(
        """select * from values
        (1, null, null, null), (2, timestamp '2024-01-02 00:00:00', 'IN', null),
        (3, timestamp '2024-01-01 23:59:59', null, timestamp '2024-01-01 00:00:00')
        as t(id, email_validated_at, detected_country_code, enriched_at)"""
    )
    now = F.expr("timestamp '2024-02-01 00:00:00'")
    assert _ids(needs_validation(rows, now)) == [1, 3]
    assert _ids(needs_validation(rows, now, "full")) == [1, 2, 3]
    assert _ids(needs_profile(rows)) == [1, 3] and _ids(needs_enrichment(rows)) == [1, 2]
    faulty = spark.sql(
        """select * from values ('invalid', 'active'), ('catch-all', 'active'), ('valid', 'active'),
        ('unknown', 'inactive'), (null, 'active') as t(email_status, email_activity)"""
    )
    assert [r.email_activity for r in repair_activity(faulty).collect()] == [
        "inactive", "unknown", "active", "inactive", "active",
    ]


def test_upsert(spark):
    stored = spark.sql(
        "select * from values ('a', 1, timestamp '2024-01-01 00:00:00'), "
        "('b', 2, timestamp '2024-01-01 00:00:00') as t(email, x, updated_at)"
    )
    changes = spark.sql("select 'a' email, cast(null as int) x, 'n' y")
    now = F.expr("timestamp '2024-02-01 00:00:00'")
    found = {r.email: r for r in upsert_by_key(stored, changes, now).collect()}
    assert (found["a"].x, found["a"].y, found["a"].updated_at.month) == (None, "n", 2)
    assert (found["b"].x, found["b"].y, found["b"].updated_at.month) == (2, None, 1)


def test_tables(spark, leads, tmp_path):
    append_rows(leads.select("id", "email"), f"{tmp_path}/t")
    append_rows(leads.select("id", "email", "city"), f"{tmp_path}/t")
    table = read_table(spark, f"{tmp_path}/t", LEAD_COLUMNS)
    assert table.count() == 10 and set(table.columns) == set(LEAD_COLUMNS)
    write_snapshot(leads, f"{tmp_path}/s")
    with pytest.raises(Exception, match="exists"):
        write_snapshot(leads, f"{tmp_path}/s")


def test_export(leads, tmp_path):
    write_export(leads, f"{tmp_path}/one", single_file=True)
    (part,) = (tmp_path / "one").glob("*.csv")
    lines = part.read_text(encoding="utf-8").splitlines()
    assert lines[0] == "﻿" + ",".join(EXPORT_COLUMNS)
    assert [line.split(",")[1] for line in lines[1:]] == [
        "eve@y.com", "dee@y.com", "cy@y.com", "bob@x.com", "ann@x.com",
    ]
    write_export(leads, f"{tmp_path}/many")
    parts = sorted((tmp_path / "many").glob("*.csv"))
    assert not parts[0].read_text(encoding="utf-8").startswith("﻿")


def test_log_files(spark, tmp_path):
    events = spark.sql(
        """select * from values
        (1L, '2024-01-01T00:00:00', 'stage_start', 'web_search', 'a@x.com', 'k1'),
        (1L, '2024-01-01T00:01:00', 'stage_end', 'web_search', 'b@x.com', null),
        (2L, '2024-01-01T00:02:00', 'error', 'web_search', 'a@x.com', 'k2')
        as t(run_id, ts, event, stage, email, api_key)"""
    )
    folder = f"{tmp_path}/log"
    append_run_log(events, folder)
    append_run_log(events.limit(1), folder)
    (tmp_path / "log" / "run_id=1" / "x.txt").write_text('{"cut": \n\n  \n[1]\n{"run_id": 1}\n')
    assert read_run_log(spark, folder).count() == 5
    one = read_run_log(spark, folder, run_id=1, stage="web_search")
    assert one.count() == 3
    assert read_run_log(spark, folder, run_id=1, email="b@x.com").count() == 1
    line = json.loads(one.where("event = 'stage_start'").first().line)
    assert line["api_key"] == "***REDACTED***" and line["run_id"] == 1
    totals = {r.run_id: r.total_entries for r in runlog.total_entries(read_run_log(spark, folder)).collect()}
    assert totals == {1: 4, 2: 1}
    rollup = {r.run_id: r for r in runlog.log_rollup(read_run_log(spark, folder)).where(
        "stage is not null").collect()}
    assert (rollup[1].events, rollup[1].span_seconds, rollup[2].errors) == (3, 60, 1)


def test_run_counters(spark):
    rows = spark.sql(
        """select * from values
        (1, 'email_validation', 'ok', 'm'), (1, 'email_validation', 'skipped', 'm'),
        (1, 'email_validation', 'failed', 'long message'), (1, 'llm_extraction', 'ok', 'm')
        as t(run_id, stage, outcome, message)"""
    ).withColumn("ts", F.timestamp_seconds(F.lit(0)))
    counters = {r.stage: tuple(r)[2:] for r in runlog.stage_counters(rows).collect()}
    # total, processed, ok, skipped, pct
    assert counters == {"email_validation": (3, 2, 1, 1, 66.7), "llm_extraction": (1, 1, 1, 0, 100.0)}
    progress = runlog.run_progress(runlog.stage_counters(rows)).orderBy("position").collect()
    assert [(r.stage, r.status) for r in progress] == [
        ("ingest", "pending"), ("email_validation", "running"), ("data_profiling", "pending"),
        ("website_scraping", "pending"), ("web_search", "pending"),
        ("llm_extraction", "completed"), ("finalize", "pending"),
    ]
    assert runlog.run_totals(rows).first().asDict() == {
        "run_id": 1, "emails_validated": 1, "emails_skipped": 1, "prospects_enriched": 1, "errors": 1,
    }
    assert runlog.run_totals(rows, rows).first().total_records == 4
    assert runlog.run_errors(rows).first().message.startswith("long")
    many = spark.range(300).select(F.lit(1).alias("run_id"), F.col("id").alias("n"))
    assert runlog.shown_errors(many, "run_id", ["n"]).count() == 100
    runs = spark.sql(
        "select * from values (1L, 'x', null, timestamp '2024-01-01 00:00:00'), "
        "(3L, 'y', null, timestamp '2024-01-03 00:00:00') as t(id, status, completed_at, started_at)"
    ).withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    last = runlog.latest_run(runs).first()
    assert (last.id, last.last_run_at.day) == (3, 3)
    assert [r.id for r in runlog.recent_runs(runs).collect()] == [3, 1]


def test_log_lines_keep_whole_messages(spark):
    events = spark.sql(
        "select 1L run_id, 'error' event, repeat('x', 3000) message union all "
        "select 1L, 'other', repeat('x', 3000)"
    )
    lengths = {json.loads(r.value)["event"]: len(json.loads(r.value)["message"])
               for r in log_lines(events).collect()}
    assert lengths == {"error": 3000, "other": 3000}


def test_deep_masking(spark):
    rows = spark.sql("""select 1 id, '{"a": {"token": {"x": 1}}}' request""")
    assert runlog.mask_json_column(rows, "request").first().request == (
        '{"a": {"token": "***REDACTED***"}}'
    )


def test_stored_pages_and_search(spark, tmp_path):
    """Pages of any depth read a few zones; the index names zones and loses no hit."""
    rows = spark.range(3000).select(
        "id", F.concat(F.lit("Name "), F.col("id") * 7919 % 3000).alias("name"),
        F.when(F.col("id") % 5 > 0, F.concat("id", F.lit("_x%@Mail.in"))).alias("email"),
        F.when(F.col("id") % 9 == 0, "ÄB Co").alias("company_name"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 10 / 10).alias("relevance_score"),
        F.when(F.col("id") % 2 == 0, "x").alias("city"),
    )
    path = f"{tmp_path}/list"
    write_zones(rows, path, zones=40, sort="relevance_score")
    columns = ("id", "relevance_score")
    every = [r.id for r in sort_leads(rows, "relevance_score").select("id").collect()]
    counts = {r.zone: (r.n, r.before) for r in spark.read.parquet(f"{path}/counts").collect()}
    assert sum(n for n, _ in counts.values()) == 3000 and len(counts) > 20
    for page in (1, 2, 60, 119, 120):
        frame = stored_page(spark, path, page, 25, sort="relevance_score", columns=columns)
        found = frame.collect()
        assert [r.id for r in found] == every[(page - 1) * 25 : page * 25]
        assert {r.total for r in found} == {3000}
        start = (page - 1) * 25
        read = [n for n, before in counts.values() if before < start + 25 and before + n > start]
        assert sum(read) < 400, (page, read)
    assert stored_page(spark, path, 121, 25, sort="relevance_score", columns=columns).count() == 0
    for term in ("name 123", "12%_x%@mail", " 99", "äb c", "a_l.in", "%", "nothing like it", "\\x"):
        want = {r.id for r in filter_leads(rows, search=term, city="x").select("id").collect()}
        hits = search_stored(spark, path, term, city="x")
        assert {r.id for r in hits.select("id").collect()} == want, term
    assert zones_with(spark, path, "name 2997") and len(zones_with(spark, path, "name 2997")) < 5
    assert term_grams(" ab%cdef_gh ") == ["cde", "def"] and zones_with(spark, path, "a%b") is None
