"""Fetches that failed, and about pages, on their way into prompts and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.constants import DEFAULT_TAXONOMY, PROMPT
from leadloom.operators.pages import (
    add_about_pages,
    fetched_pages,
    merge_last_wins,
    parse_pages,
    site_records,
    with_texts,
    write_parsed,
)
from leadloom.operators.search import add_prompt
from leadloom.operators.upsert import add_missing_columns
from leadloom.plans.enrichment import attach_search, attach_sites, enrich_leads, profile_leads
from leadloom.plans.enrichment_queries import (
    ANSWER_TEXT,
    PLANNED,
    RECORDED,
    json_results_sql,
    json_text,
)
from leadloom.plans.inputs import PAGES_MARKED, derived
from leadloom.plans.lead_queries import as_of
from leadloom.plans.leads import lead_table
from leadloom.plans.page_queries import SITES, WITH_ABOUT_PAGES, with_spark_names
from leadloom.plans.registry import entries_text, query
from leadloom.plans.sql import canonical_url_sql, quoted
from leadloom.session import shared_folder
from leadloom.sources.tables import read_table, write_snapshot

TAXONOMY = list(DEFAULT_TAXONOMY)

# Every page, and the about pages that some link to, fetched with all kinds of outcomes.
FETCHES = f"""
select page_id, url, html,
 case when page_id % 13 = 5 then null when page_id % 7 = 3 then 404 when page_id % 29 = 8 then 503
  else 200 end as status_code,
 case when page_id % 19 = 6 then 'application/pdf' else 'text/html' end as content_type,
 case when page_id % 13 = 5 then case when page_id % 2 = 0 then 'timeout' else 'ConnectError' end
  end as error,
 page_id % 17 <> 4 as robots_allowed
from ({WITH_ABOUT_PAGES}) as pages_fetched
"""

_STATUS = """case when page_id % 17 = 4 then 'blocked_by_robots'
  when page_id % 13 = 5 then case when page_id % 2 = 0 then 'timeout' else 'network_error' end
  when page_id % 7 = 3 or page_id % 29 = 8 then 'http_error'
  when page_id % 19 = 6 then 'not_html' else 'ok' end"""

# The sites as they would be if every fetch were good, and what is left of them.
_FETCHED = SITES.replace(PAGES_MARKED, WITH_ABOUT_PAGES).replace(
    "\nsites as (", "\nsites_all as ("
).replace("\nsocials as (", "\nsocials_all as (").replace(
    "from socials group by", "from socials_all group by"
) + f""",
told as (select *, {_STATUS} as status from sites_all),
merged as (
 select s.page_id, s.url_norm, s.status,
  case when s.status not in ('ok', 'blocked_by_robots') then s.status end as error,
  case when s.status <> 'blocked_by_robots' then s.url end as url,
  case when s.status = 'ok' then s.title end as title,
  case when s.status = 'ok' then s.description end as description,
  case when s.status = 'ok' then s.text end as text,
  case when s.status = 'ok' then s.about_url end as about_url,
  case when s.status = 'ok' then a.page_id end as about_id,
  case when s.status = 'ok' then coalesce(a.text, '') end as about_text
 from told s left join told a on a.url_norm = {canonical_url_sql("s.about_url")}
  and a.status = 'ok'
),
socials as (
 select page_id, platform, arg_min(url, place) as url, min(place) as place,
  arg_min(pos, place) as pos from (
  select m.page_id, platform, s.url, 0 as place, s.pos
  from merged m join socials_all s using (page_id) where m.status = 'ok'
  union all
  select m.page_id, platform, s.url, 1, s.pos
  from merged m join socials_all s on s.page_id = m.about_id
 ) group by page_id, platform
),
sites as (
 select m.*, coalesce(social_links, '') as social_links from merged m left join (
  select page_id, string_agg(platform || '=' || url, '; ' order by platform) as social_links
  from socials group by page_id
 ) using (page_id)
)"""


def _with_fetches(ctes: str) -> str:
    """The same chain of tables on top of sites that were fetched with all kinds of outcomes."""
    return ctes.replace(SITES, _FETCHED).replace(
        "s.page_id is not null as scraped", "coalesce(s.status = 'ok', false) as scraped, s.status,"
        " s.error, s.about_text"
    )


def fetched_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(site records without texts, stored pages with theirs)."""
    fetches = derived(spark, sf_dir, with_spark_names(FETCHES), ("pages",))
    told = fetched_pages(fetches)
    parsed = parse_pages(told).join(told.select("page_id", "status", "error"), "page_id")
    folder = shared_folder(spark, "fetched")
    write_parsed(parsed, folder)
    pages = spark.read.parquet(folder)
    return add_about_pages(site_records(pages, texts=False)), pages


@query(f"with {_FETCHED}\n" + """
select page_id, status, error, url as final_url, title, about_url, about_text, social_links from sites
""")
def site_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each address gave, about pages included."""
    sites, pages = fetched_sites(spark, sf_dir)
    whole = with_texts(sites.select(F.struct("*").alias("site")), pages)
    return whole.select(
        "site.page_id", "site.status", "site.error", "site.final_url", "site.title",
        "site.about_url", "site.about_text",
        entries_text("site.social_links").alias("social_links"),
    )


_SITE_FAILED = PROMPT["site_failed"].split("{}")


@query(f"with {_with_fetches(PLANNED).strip()}\n" + f"""
select email, scraped, length(text) as text_chars,
 case when status is null then {quoted(PROMPT["site_absent"])}
  when not scraped then {quoted(_SITE_FAILED[0])} || status || {quoted(_SITE_FAILED[1])}
   || coalesce(error, '') || {quoted(_SITE_FAILED[2])}
  else concat_ws('\n',
   'PRIMARY SOURCE — Company website (scraped from ' || final_url || '):',
   '  Title: ' || title, '  Meta description: ' || description,
   '  Homepage text:' || chr(10) || nullif(trim(text), ''),
   '  About page (' || coalesce(about_url, '(about page)') || '):' || chr(10)
    || nullif(trim(about_text), ''),
   '  Social links found on site: {{' || nullif((
     select string_agg('"' || platform || '": "' || url || '"', ', ' order by place, pos)
     from socials where socials.page_id = searched.page_id), '') || '}}') end
 || '\n\n' || case when len(company_results) = 0 and len(person_results) = 0
  then {quoted(PROMPT["snippets_absent"])}
  else {quoted(PROMPT["snippets"])} || '\n  Company results:\n'
   || {json_results_sql("company_results")} || '\n  Person results:\n'
   || {json_results_sql("person_results")} end
 || '\n\n' || {quoted(ANSWER_TEXT)} as prompt
from searched
""")
def prompt_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, from the site on, of leads whose site was read, failed or is not known."""
    sites, pages = fetched_sites(spark, sf_dir)
    leads = attach_search(attach_sites(profile_leads(lead_table(spark, sf_dir)), sites))
    known = add_missing_columns(with_texts(leads, pages), {"notes": "string"})
    prompts = add_prompt(known, TAXONOMY)
    context = F.concat(F.split_part("prompt", F.lit("\n\n"), F.lit(1)), F.lit("\n\n"))
    return prompts.select(
        "email", F.col("has_scraped_data").alias("scraped"),
        F.length("site.text").cast("bigint").alias("text_chars"),
        F.substr("prompt", F.length(context) + 1).alias("prompt"),
    )


# In the evidence the record of a site stands with its outcome.
_RECORDED = _with_fetches(RECORDED).replace(
    "case when scraped then ',\"scraped\"", "case when status is not null then ',\"scraped\""
).replace(
    ',"status":"ok","final_url":\'', ',"status":"\' || status || \'","final_url":\''
).replace(
    ',"about_text":null,"error":null}\'', ',"about_text":\' || ' + json_text("about_text")
    + ' || \',"error":\' || ' + json_text("error") + " || '}'"
).replace("',' order by platform)", "',' order by place, pos)")


@query(f"with {_RECORDED.strip()}\n" + """
select email, case when enriched_at is null then picked_industry else industry end as industry,
 case when enriched_at is null then company_website end as company_website,
 case when enriched_at is null then enrichment_raw end as evidence
from recorded
""")
def enrichment_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enrichment run over such sites; the evidence in full."""
    columns = {
        "enrichment_raw": "string", "company_website": "string", "updated_at": "timestamp",
    }
    folder = shared_folder(spark, "leads")
    write_snapshot(profile_leads(lead_table(spark, sf_dir)).drop("language", "profile"), folder)
    sites, pages = fetched_sites(spark, sf_dir)
    enriched = enrich_leads(
        read_table(spark, folder, columns), sites, TAXONOMY, as_of(), pages=pages
    )
    return enriched.select(
        "email", "industry", "company_website", F.col("enrichment_raw").alias("evidence")
    )


@query(f"with {_FETCHED}" + """,
late as (
 select m.page_id, platform, arg_max(s.url, case when s.page_id = m.about_id then 1 else 0 end) as url
 from merged m join socials_all s
  on (s.page_id = m.page_id and m.status = 'ok') or s.page_id = m.about_id
 group by m.page_id, platform
)
select m.page_id, coalesce(string_agg(platform || '=' || l.url, '; ' order by platform), '')
 as social_links
from merged m left join late l using (page_id) group by m.page_id
""")
def socials_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of a site in which those of its about page win."""
    sites, pages = fetched_sites(spark, sf_dir)
    narrow = site_records(pages, texts=False)
    abouts = narrow.where(F.col("status") == "ok").select(
        F.col("page_id").alias("about_id"), F.col("social_links").alias("late")
    )
    joined = sites.select("page_id", "about_id").join(
        narrow.select("page_id", "social_links"), "page_id"
    ).join(abouts, "about_id", "left")
    none = F.expr("cast(map() as map<string,string>)")
    merged = merge_last_wins("social_links", F.coalesce("late", none))
    return joined.select("page_id", entries_text(merged).alias("social_links"))
