"""From leads and fetched pages to enriched leads: the stages after ingest, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.operators.extraction import (
    add_extraction,
    add_stand_in_extraction,
    enrichment_columns,
    evidence_record,
)
from leadloom.operators.pages import join_sites, website_counts, with_texts
from leadloom.operators.profiling import add_geo_profile, add_language, apply_geo_profile
from leadloom.operators.search import add_search_plan, join_results, stand_in_results
from leadloom.operators.upsert import add_missing_columns, upsert_by_key
from leadloom.operators.validation import needs_enrichment

SITE_COLUMNS = {"about_text": "string", "error": "string"}
# What the evidence of an extraction is made of, beside the site's texts.
EVIDENCE = (
    "site", "company_results", "person_results", "country", "detected_country_code",
    "search_locale", "language", "plan", "extracted",
)


def profile_leads(leads: DataFrame, country: str = "country") -> DataFrame:
    """Geo profile from the stated country, written to the lead columns, with the language."""
    return add_language(apply_geo_profile(add_geo_profile(leads, country=country)))


def attach_sites(
    leads: DataFrame, sites: DataFrame, counts: DataFrame | None = None
) -> DataFrame:
    """Leads with the record of their own site."""
    if "text" in sites.columns:
        sites = add_missing_columns(sites, SITE_COLUMNS)
    return join_sites(leads, sites, counts=counts)


def attach_search(leads: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Search plan and results; without a results table the stand-in results."""
    planned = add_search_plan(leads)
    return stand_in_results(planned) if results is None else join_results(planned, results)


def enrichment_record(inside: str = "") -> Column:
    """Everything known about a lead when its fields were extracted; all but `site` may stand in the
    struct named `inside`."""
    at = f"{inside}." if inside else ""
    profile = F.struct(
        F.col(f"{at}country").alias("country"),
        F.col(f"{at}detected_country_code").alias("country_code"),
        F.col(f"{at}search_locale").alias("search_locale"), F.col(f"{at}language").alias("language"),
    )
    snippets = F.struct(
        F.col(f"{at}company_results").alias("company_results"),
        F.col(f"{at}person_results").alias("person_results"),
    )
    return evidence_record({
        "snippets": snippets,
        "scraped": F.col("site"),
        "profile": profile,
        "search_plan": F.col(f"{at}plan"),
    }, f"{at}extracted")


def enrich_leads(
    leads: DataFrame, sites: DataFrame, taxonomy: list[str], as_of: Column,
    results: DataFrame | None = None, answers: DataFrame | None = None,
    run_type: str = "incremental", pages: DataFrame | None = None,
) -> DataFrame:
    """The table of profiled leads after one enrichment run.

    `leads` is a stored table, so counting its websites reads one column; addresses that many leads
    share are split before the site join.  Only the cohort to be enriched reaches the site and
    search joins.  `answers` (`email, answer`) holds model answers; leads without a usable one get
    the stand-in extraction.  With `pages` (`page_id, text`) the sites are records without texts:
    all joins and the update move narrow rows, and the texts are joined last, into the evidence.
    """
    cohort = needs_enrichment(leads, run_type)
    located = attach_sites(add_language(cohort), sites, website_counts(cohort))
    cohort = attach_search(located, results)
    if answers is None:
        extracted = add_stand_in_extraction(cohort, taxonomy)
    else:
        extracted = add_extraction(cohort.join(answers, "email", "left"), taxonomy)
    if pages is None:
        changes = enrichment_columns(extracted, enrichment_record(), as_of)
        return upsert_by_key(leads, changes, as_of)
    changes = enrichment_columns(extracted, F.struct(*EVIDENCE), as_of, "_evidence")
    updated = upsert_by_key(leads, changes, as_of).withColumn("site", F.col("_evidence.site"))
    record = F.when(F.col("_evidence").isNotNull(), enrichment_record("_evidence"))
    before = [F.col("enrichment_raw")] if "enrichment_raw" in leads.columns else []
    return with_texts(updated, pages).withColumn(
        "enrichment_raw", F.coalesce(record, *before)
    ).drop("site", "_evidence")
