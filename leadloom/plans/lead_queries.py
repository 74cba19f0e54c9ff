"""Geo profile, mailbox results, selections, and the list, facet, overview and cluster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.constants import DEFAULT_TAXONOMY, EXPORT_COLUMNS
from leadloom.operators import analytics
from leadloom.operators.profiling import add_geo_profile, add_language, apply_geo_profile
from leadloom.operators.taxonomy import read_taxonomy, taxonomy_setting
from leadloom.operators.upsert import add_missing_columns, upsert_by_key
from leadloom.operators.validation import (
    has_website,
    is_stale,
    is_unenriched,
    is_unprofiled,
    mailbox_activity,
    mailbox_status,
    needs_enrichment,
    repair_activity,
    validation_columns,
)
from leadloom.plans.inputs import AS_OF, table
from leadloom.plans.leads import lead_table
from leadloom.plans.registry import query, time_text
from leadloom.plans.sql import GEO, LEADS, QUALITY, quoted_list, with_ctes
from leadloom.session import shared_folder
from leadloom.operators.snapshots import search_stored, stored_page, write_zones
from leadloom.sources.tables import (
    BUCKETS,
    LEAD_COLUMNS,
    export_rows,
    read_bucketed,
    write_bucketed,
    write_export,
)


def as_of():
    return F.expr(AS_OF)


def profiled_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_geo_profile(lead_table(spark, sf_dir))


# --- geo profile ---------------------------------------------------------------------------------
@query(with_ctes(GEO, """
select email, country, country_code, search_locale, language, signals, confidence from profiled
"""))
def geo_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiled_leads(spark, sf_dir).select(
        "email", "profile.country", "profile.country_code", "profile.search_locale",
        "profile.language", F.array_join("profile.signals", "; ").alias("signals"),
        "profile.confidence",
    )


@query(with_ctes(GEO, """
select email, country_csv, coalesce(country_csv, country) as country,
 country_code as detected_country_code, search_locale, language
from profiled
"""))
def geo_fill_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated country is kept next to the filled one, so a later run votes on the same input."""
    leads = profiled_leads(spark, sf_dir).withColumn("country_csv", F.col("country"))
    return add_language(apply_geo_profile(leads)).select(
        "email", "country_csv", "country", "detected_country_code", "search_locale", "language"
    )


@query(with_ctes(GEO, """
select country_code, email_activity, count(*) as leads, round(avg(confidence), 6) as confidence,
 round(avg(quality), 6) as quality
from (select *, """ + QUALITY + """ as quality from (
 select * exclude (country), country_csv as country from profiled))
group by country_code, email_activity
"""))
def leads_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: cleaned, deduplicated, profiled leads per country and mailbox activity."""
    return (
        profiled_leads(spark, sf_dir)
        .groupBy(F.col("profile.country_code").alias("country_code"), "email_activity")
        .agg(
            F.count("*").alias("leads"),
            F.round(F.avg("profile.confidence"), 6).alias("confidence"),
            F.round(F.avg("data_quality_score"), 6).alias("quality"),
        )
    )


# --- mailbox results -----------------------------------------------------------------------------
@query(with_ctes(LEADS, """
select email, email_status, email_sub_status, email_activity, email_activity_score from leads
"""))
def email_status_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lead_table(spark, sf_dir).select(
        "email", "email_status", "email_sub_status", "email_activity", "email_activity_score"
    )


# Provider answers for the leads that name a company.
_PROVIDER = """
select email,
 case id % 9 when 0 then 'valid' when 1 then 'invalid' when 2 then 'catch-all' when 3 then 'spamtrap'
  when 4 then 'abuse' when 5 then 'do_not_mail' when 6 then 'unknown' when 7 then 'greylisted' end
  as status,
 case when id % 2 = 0 then '' else 'alias' end as sub_status,
 case when id % 3 = 0 then null else cast(id % 11 as double) end as activity_score
from leads where company_name is not null
"""


def _provider_results(leads: DataFrame) -> DataFrame:
    leads.createOrReplaceTempView("leads")
    return leads.sparkSession.sql(_PROVIDER)


@query(with_ctes(f"{LEADS}, results as ({_PROVIDER})", """
select l.email,
 case when r.email is null then null
  when status in ('invalid', 'spamtrap', 'abuse', 'do_not_mail') then 'invalid'
  when status in ('valid', 'catch-all') then status else 'unknown' end as email_status,
 nullif(sub_status, '') as email_sub_status,
 case when r.email is null then null when status = 'valid' then 'active'
  when status in ('invalid', 'spamtrap', 'abuse', 'do_not_mail') then 'inactive'
  else 'unknown' end as email_activity,
 activity_score as email_activity_score, r.email is null as skipped
from leads l left join results r on r.email = l.email
"""))
def validation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = lead_table(spark, sf_dir)
    results = validation_columns(_provider_results(leads))
    return (
        leads.select("email").join(results, "email", "left")
        .withColumn("skipped", F.col("email_status").isNull())
        .select(
            "email", "email_status", "email_sub_status", "email_activity", "email_activity_score",
            "skipped",
        )
    )


@query("""
select event_type as status, props, count(*) as n,
 case event_type when 'error' then 'invalid' when 'view' then 'catch-all' when 'click' then 'valid'
  else 'unknown' end as email_status,
 case event_type when 'error' then 'inactive' when 'click' then 'active' else 'unknown' end
  as email_activity
from events group by event_type, props
""")
def status_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.when(F.col("status") == "error", "do_not_mail").when(
        F.col("status") == "view", "catch-all"
    ).when(F.col("status") == "click", "valid").otherwise(F.col("status"))
    counts = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("status"), "props"
    ).agg(F.count("*").alias("n"))
    return counts.select(
        "status", "props", "n", mailbox_status(provider).alias("email_status"),
        mailbox_activity(provider).alias("email_activity"),
    )


@query(with_ctes(GEO, f"""
select email,
 email_validated_at is null or email_validated_at < {AS_OF} - interval 30 day as to_validate,
 country_code is null as to_profile, enriched_at is null as to_enrich,
 enriched_at is null and website_csv is not null as to_scrape
from profiled
where email_validated_at is null or email_validated_at < {AS_OF} - interval 30 day
 or country_code is null or enriched_at is null
"""))
def stale_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads that any stage of an incremental run picks up, with the stages that do: one pass."""
    leads = profiled_leads(spark, sf_dir).withColumn(
        "detected_country_code", F.col("profile.country_code")
    )
    marks = {
        "to_validate": is_stale(as_of()),
        "to_profile": is_unprofiled(),
        "to_enrich": is_unenriched(),
        "to_scrape": is_unenriched() & has_website(),
    }
    return leads.select("email", *[mark.alias(stage) for stage, mark in marks.items()]).where(
        F.col("to_validate") | F.col("to_profile") | F.col("to_enrich")
    )


# Rows with the activity an old fault left behind.
@query(with_ctes(LEADS, """
select email, email_status,
 case when id % 2 = 0 and email_status = 'invalid' then 'inactive'
  when id % 2 = 0 and email_status = 'catch-all' then 'unknown'
  when id % 2 = 0 then 'active' else email_activity end as email_activity
from leads
"""))
def repaired_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    faulty = lead_table(spark, sf_dir).withColumn(
        "email_activity",
        F.when(F.col("id") % 2 == 0, "active").otherwise(F.col("email_activity")),
    )
    return repair_activity(faulty).select("email", "email_status", "email_activity")


# --- taxonomy ------------------------------------------------------------------------------------
_NEW_TAXONOMY = ["  FMCG ", "", "Plastics & Polymers", "   ", "Other Manufacturing"]


@query(with_ctes(LEADS, """
select email,
 case when industry is null then null
  when industry in ('FMCG', 'Plastics & Polymers', 'Other Manufacturing') then industry
  else 'Unknown' end as industry,
 coalesce(industry not in ('FMCG', 'Plastics & Polymers', 'Other Manufacturing', 'Unknown'), false)
  as reclassified
from leads
"""))
def reclassify_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads after the list of industries was edited: the stored setting is read back."""
    taxonomy = read_taxonomy(taxonomy_setting(spark, _NEW_TAXONOMY))
    return analytics.reclassify_unknown(lead_table(spark, sf_dir), taxonomy).select(
        "email", "industry", "reclassified"
    )


@query(with_ctes(LEADS, f"""
select industry, industry in {quoted_list(DEFAULT_TAXONOMY)} as known, count(*) as n
from leads where industry is not null group by industry
"""))
def taxonomy_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries in use and whether the default list knows them."""
    used = (
        lead_table(spark, sf_dir).where(F.col("industry").isNotNull())
        .groupBy("industry").agg(F.count("*").alias("n"))
    )
    labels = read_taxonomy(taxonomy_setting(spark, []).where(F.lit(False))).select(
        F.col("label").alias("industry")
    )
    marked = used.join(F.broadcast(labels.withColumn("known", F.lit(True))), "industry", "left")
    return marked.withColumn("known", F.coalesce("known", F.lit(False)))


# --- overview, facets, clusters ------------------------------------------------------------------
@query(with_ctes(LEADS, """
select count(*) as total, count(*) filter (where email_status = 'valid') as valid,
 count(*) filter (where email_status = 'invalid') as invalid,
 count(*) filter (where email_status in ('catch-all', 'disposable')) as risky,
 count(*) filter (where email_status is null or email_status = 'unknown') as unknown
from leads
"""))
def overview_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.overview(lead_table(spark, sf_dir))


def _top_sql(column: str, n: int = 10, where: str = "true") -> str:
    return (
        f"select {column} as label, count(*) as count from leads where {column} is not null "
        f"and {where} group by {column} order by count(*) desc, {column} limit {n}"
    )


@query(with_ctes(LEADS, _top_sql("industry")))
def top_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_labels(lead_table(spark, sf_dir), "industry")


@query(with_ctes(LEADS, _top_sql("state")))
def top_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_labels(lead_table(spark, sf_dir), "state")


@query(with_ctes(LEADS, """
select coalesce(nullif(case when company_name is null then null when phone is null then ''
 else email_status end, ''), 'unknown') as label, count(*) as count
from leads group by 1
"""))
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With missing and blank statuses among the leads."""
    status = F.when(F.col("company_name").isNull(), None).when(F.col("phone").isNull(), "")
    leads = lead_table(spark, sf_dir).withColumn(
        "email_status", status.otherwise(F.col("email_status"))
    )
    return analytics.status_counts(leads)


@query(with_ctes(LEADS, """
, cities as (
 select industry, city, row_number() over (partition by industry order by count(*) desc, city)
  as place
 from leads where industry is not null and city is not null group by industry, city
), tops as (
 select industry, string_agg(city, '; ' order by place) as top_cities from cities
 where place <= 3 group by industry
)
select industry, count(*) as count,
 round(100.0 * count(*) filter (where email_status = 'valid') / count(*), 1) as valid_pct,
 round(avg(relevance_score), 6) as avg_relevance, coalesce(any_value(top_cities), '') as top_cities
from leads left join tops using (industry) where industry is not null group by industry
"""))
def industry_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.industry_cards(lead_table(spark, sf_dir)).select(
        "industry", "count", "valid_pct", F.round("avg_relevance", 6).alias("avg_relevance"),
        F.array_join("top_cities", "; ").alias("top_cities"),
    )


@query(with_ctes(LEADS, f"""
select 'total' as dim, 'FMCG' as label, count(*) as count,
 round(100.0 * count(*) filter (where email_status = 'valid') / count(*), 1) as valid_pct,
 round(avg(relevance_score), 6) as avg_relevance
from leads where industry = 'FMCG'
union all select 'city', label, count, null, null
 from ({_top_sql("city", 10, "industry = 'FMCG'")})
union all select 'state', label, count, null, null
 from ({_top_sql("state", 10, "industry = 'FMCG'")})
"""))
def industry_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = analytics.industry_detail(lead_table(spark, sf_dir), "FMCG")
    return detail.withColumn("avg_relevance", F.round("avg_relevance", 6))


@query(with_ctes(LEADS, " union ".join(
    f"select '{c}' as facet, {c} as value from leads where {c} <> ''"
    for c in ("industry", "state", "city", "country", "source_file", "email_status")
)))
def facet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.facet_options(lead_table(spark, sf_dir))


# --- list, detail, export ------------------------------------------------------------------------
_LIST = [
    "id", "name", "email", "phone", "company_name", "city", "state", "country", "industry",
    "email_status", "email_activity", "relevance_score", "source_file",
]


@query(with_ctes(LEADS, f"""
select {", ".join(_LIST)}, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, total
from (
 select *, count(*) over () as total from leads
 where (name ilike '%customer#%1%' or email ilike '%customer#%1%' or company_name ilike '%customer#%1%')
  and email_status = 'valid' and source_file = 'b.csv'
) order by relevance_score desc nulls last, id limit 25 offset 25
"""))
def lead_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of a search with a wildcard in the term and two equality filters."""
    page = analytics.lead_page(
        lead_table(spark, sf_dir), page=2, limit=25, sort="relevance_score", order="desc",
        columns=(*_LIST, "created_at"), search=" customer#%1 ", email_status="valid",
        source_file="b.csv", industry=None, city="",
    )
    return page.withColumn("created_at", time_text("created_at"))


@query(with_ctes(LEADS, f"""
select {", ".join(_LIST)}, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, total
from (select *, count(*) over () as total from leads)
order by company_name asc nulls first, id limit 50
"""))
def lead_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page without a filter, sorted by a column that has nulls."""
    page = analytics.lead_page(
        lead_table(spark, sf_dir), limit=50, sort="company_name", order="asc",
        columns=(*_LIST, "created_at"),
    )
    return page.withColumn("created_at", time_text("created_at"))


def _stored_list(spark: SparkSession, sf_dir: str) -> str:
    """The leads by falling relevance, stored in zones."""
    folder = shared_folder(spark, "lead-list")
    write_zones(lead_table(spark, sf_dir), folder, zones=32, sort="relevance_score")
    return folder


@query(with_ctes(LEADS, f"""
select {", ".join(_LIST)}, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at, total
from (
 select *, count(*) over () as total,
  row_number() over (order by relevance_score desc nulls last, id) as place
 from leads
) where place between 51 and 75 or place > (total - 1) // 25 * 25
"""))
def lead_pages_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third and the last page of the stored list: each reads the zones that it lies in."""
    folder = _stored_list(spark, sf_dir)
    columns = (*_LIST, "created_at")
    third = stored_page(spark, folder, 3, sort="relevance_score", columns=columns)
    last = (third.first().total - 1) // 25 + 1
    pages = third.unionByName(
        stored_page(spark, folder, last, sort="relevance_score", columns=columns)
    )
    return pages.withColumn("created_at", time_text("created_at"))


@query(with_ctes(LEADS, f"""
select {", ".join(_LIST)} from leads
where (name ilike '%customer#%12%' or email ilike '%customer#%12%'
  or company_name ilike '%customer#%12%') and email_status = 'valid'
"""))
def lead_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of a search with a wildcard, by the index of letter runs."""
    folder = _stored_list(spark, sf_dir)
    return search_stored(spark, folder, " customer#%12 ", email_status="valid").select(*_LIST)


_DETAIL = [*_LIST, "pincode", "website_csv", "email_sub_status", "email_activity_score"]


@query(with_ctes(LEADS, f"select {', '.join(_DETAIL)} from leads where email = 'sales@mail0.in'"))
def lead_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.lead_detail(
        lead_table(spark, sf_dir), "email", "sales@mail0.in", tuple(_DETAIL)
    )


def export_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead table with every export column, not yet written ones as null."""
    leads = apply_geo_profile(profiled_leads(spark, sf_dir))
    return add_missing_columns(leads, LEAD_COLUMNS)


_EXPORT_SQL = {
    "created_at": "strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at",
    "enriched_at": "strftime(enriched_at, '%Y-%m-%d %H:%M:%S') as enriched_at",
    "country": "coalesce(country_csv, country) as country",
    "detected_country_code": "country_code as detected_country_code",
    "data_quality_score": QUALITY + " as data_quality_score",
    **{c: f"null::varchar as {c}" for c in (
        "fax", "address", "notes", "sub_category", "company_size", "company_website",
        "company_linkedin", "person_linkedin", "company_description",
    )},
    "industry_confidence": "null::double as industry_confidence",
}


@query(with_ctes(GEO, "select " + ", ".join(
    _EXPORT_SQL.get(c, c) for c in EXPORT_COLUMNS
) + " from profiled"))
def export_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export_rows(export_ready(spark, sf_dir))
    return rows.withColumns({
        "created_at": time_text("created_at"), "enriched_at": time_text("enriched_at"),
    })


@query(with_ctes(GEO, "select " + ", ".join(
    f"{_EXPORT_SQL.get(c, c + ' as ' + c).rsplit(' as ', 1)[0]}::varchar as {c}"
    for c in EXPORT_COLUMNS
) + " from profiled"))
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export written as CSV files and read back as text."""
    folder = shared_folder(spark, "export")
    leads = export_ready(spark, sf_dir)
    write_export(leads.withColumns({
        "created_at": time_text("created_at"), "enriched_at": time_text("enriched_at"),
    }), folder)
    return spark.read.options(header=True, escape='"').csv(folder)


@query(with_ctes(GEO, f"""
select email, id, case when enriched_at is null then 'Packaging' else industry end as industry,
 case when enriched_at is null then null else relevance_score end as relevance_score,
 case when enriched_at is null then 'https://' || split_part(email, '@', 2) end as company_website,
 strftime(coalesce(enriched_at, {AS_OF}), '%Y-%m-%d %H:%M:%S') as enriched_at,
 strftime(case when enriched_at is null then {AS_OF} else created_at end, '%Y-%m-%d %H:%M:%S')
  as updated_at,
 null::varchar as company_size
from profiled
"""))
def upsert_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes for the leads not enriched yet are written over the stored table, which is dealt to
    buckets by e-mail: only the changes move."""
    folder = shared_folder(spark, "bucketed-leads")
    leads = lead_table(spark, sf_dir).withColumn("updated_at", F.col("created_at"))
    write_bucketed(leads, folder, "email", BUCKETS)
    stored = read_bucketed(
        spark, folder, "email", BUCKETS,
        {c: LEAD_COLUMNS[c] for c in ("company_size", "company_website")},
    )
    changes = needs_enrichment(stored).select(
        "email",
        F.lit("Packaging").alias("industry"),
        F.lit(None).cast("double").alias("relevance_score"),
        F.concat(F.lit("https://"), F.substring_index("email", "@", -1)).alias("company_website"),
        as_of().alias("enriched_at"),
    )
    return upsert_by_key(stored, changes, as_of()).select(
        "email", "id", "industry", "relevance_score", "company_website",
        time_text("enriched_at").alias("enriched_at"),
        time_text("updated_at").alias("updated_at"), "company_size",
    )
