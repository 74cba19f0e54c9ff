"""Site join, search plans and results, prompts, answer coercion, evidence, enrichment run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.constants import COMPANY_SIZES, DEFAULT_TAXONOMY, PROMPT
from leadloom.operators.extraction import (
    add_coerced_answer,
    add_stand_in_extraction,
    is_answer,
)
from leadloom.operators.pages import with_texts
from leadloom.operators.search import add_prompt, add_search_plan, join_results, stand_in_results
from leadloom.operators.upsert import add_missing_columns
from leadloom.plans.enrichment import (
    attach_search,
    attach_sites,
    enrich_leads,
    enrichment_record,
    profile_leads,
)
from leadloom.plans.lead_queries import as_of
from leadloom.plans.leads import lead_table
from leadloom.plans.page_queries import SITES, parsed_sites
from leadloom.plans.registry import entries_text, query
from leadloom.plans.sql import GEO, LEADS, canonical_url_sql, quoted, quoted_list, with_ctes
from leadloom.session import shared_folder
from leadloom.sources.tables import read_table, write_snapshot

TAXONOMY = list(DEFAULT_TAXONOMY)

BASE = f"""{GEO},
{SITES},
base as (
 select p.id, p.email, p.name, p.company_name, p.city, p.state,
  coalesce(p.country_csv, p.country) as country, p.country_code, p.search_locale, p.language,
  p.website_csv, p.enriched_at, p.industry, p.relevance_score, s.page_id is not null as scraped,
  s.page_id, s.url as final_url, s.title, s.description, s.text, s.social_links, s.about_url
 from profiled p left join sites s on s.url_norm = {canonical_url_sql("p.website_csv")}
)"""

PLANNED = f"""{BASE},
quoted_terms as (
 select *, '"' || nullif(trim(replace(company_name, '"', '')), '') || '"' as quoted_company,
  '"' || nullif(trim(replace(name, '"', '')), '') || '"' as quoted_name
 from base
),
planned as (
 select *,
  case when not scraped
   then nullif(concat_ws(' ', quoted_company, coalesce(country, city)), '') end as company_query,
  case when name is not null
   then concat_ws(' ', 'site:linkedin.com', quoted_name, quoted_company) end as person_query,
  coalesce(company_name, 'Unknown Co') as label,
  lower(coalesce(company_name, 'example')) as slug
 from quoted_terms
),
searched as (
 select *,
  case when company_query is not null then [
   {{'title': label || ' | About Us',
    'link': 'https://www.' || replace(slug, ' ', '') || '.example',
    'snippet': label || ' is a B2B supplier based in ' || coalesce(country, city, 'their city')
     || ', serving industrial customers.'}},
   {{'title': label || ' on LinkedIn',
    'link': 'https://www.linkedin.com/company/' || replace(slug, ' ', '-'),
    'snippet': 'View ' || label || ' on LinkedIn.'}}] else [] end as company_results,
  case when person_query is not null then [
   {{'title': name || ' - ' || label,
    'link': 'https://www.linkedin.com/in/' || replace(lower(name), ' ', '-'),
    'snippet': name || ' works at ' || label || '.'}}] else [] end as person_results
 from planned
)"""


def leads_with_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with the record of their site, texts left out."""
    sites, _ = parsed_sites(spark, sf_dir)
    return attach_sites(profile_leads(lead_table(spark, sf_dir)), sites)


def searched_leads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(leads with narrow site records and search results, pages with texts)."""
    sites, pages = parsed_sites(spark, sf_dir)
    located = attach_sites(profile_leads(lead_table(spark, sf_dir)), sites)
    return attach_search(located), pages


@query(with_ctes(BASE, """
select email, website_csv, page_id, title, social_links, scraped as has_scraped_data from base
"""))
def page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads_with_sites(spark, sf_dir).select(
        "email", "website_csv", "site.page_id", "site.title",
        entries_text("site.social_links").alias("social_links"), "has_scraped_data",
    )


@query(with_ctes(PLANNED, """
select email, company_query, person_query,
 concat_ws('; ', 'gl=' || search_locale, 'hl=' || language) as params
from planned
"""))
def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_search_plan(leads_with_sites(spark, sf_dir)).select(
        "email", "plan.company_query", "plan.person_query",
        entries_text("plan.params").alias("params"),
    )


def _results_text(column: str):
    return F.array_join(
        F.transform(column, lambda r: F.concat_ws(" ~ ", r["title"], r["link"], r["snippet"])),
        "; ",
    ).alias(column)


def _results_sql(column: str) -> str:
    return (
        f"coalesce(list_aggregate(list_transform({column}, "
        "lambda r: concat_ws(' ~ ', r.title, r.link, r.snippet)), 'string_agg', '; '), '')"
    )


@query(with_ctes(PLANNED, f"""
select email,
 case when state is null then '' else {_results_sql("company_results")} end as company_results,
 case when state is null then '' else {_results_sql("person_results")} end as person_results
from searched
"""))
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results exist for the leads with a state; the others get empty lists from the join."""
    planned = add_search_plan(leads_with_sites(spark, sf_dir))
    results = stand_in_results(planned.where(F.col("state").isNotNull()))
    return join_results(planned, results).select(
        "email", _results_text("company_results"), _results_text("person_results")
    )


def json_results_sql(column: str) -> str:
    item = " || ',\n' || ".join(
        f"'    \"{f}\": ' || to_json(r.{f})::varchar" for f in ("title", "link", "snippet")
    )
    return (
        f"case when len({column}) = 0 then '[]' else '[\n' || list_aggregate(list_transform("
        f"{column}, lambda r: '  {{\n' || {item} || '\n  }}'), 'string_agg', ',\n') || '\n]' end"
    )


ANSWER_TEXT = PROMPT["answer"].replace("<TAXONOMY>", str(TAXONOMY))


@query(with_ctes(PLANNED, f"""
select email, concat_ws('\n', {quoted(PROMPT["context"])},
  '  Contact: ' || coalesce(name, 'Unknown'),
  '  Email: ' || email || ' (domain: ' || split_part(email, '@', 2) || ')',
  '  Company: ' || coalesce(company_name, 'Unknown'),
  '  Location: ' || coalesce(city, '?') || ', ' || coalesce(state, '?') || ', '
   || coalesce(country, '?') || coalesce(' [' || country_code || ']', ''),
  '  Likely working language: ' || language, '  CSV-supplied website: ' || website_csv)
 || '\n\n' || case when not scraped then {quoted(PROMPT["site_absent"])}
  else concat_ws('\n',
   'PRIMARY SOURCE — Company website (scraped from ' || final_url || '):',
   '  Title: ' || title, '  Meta description: ' || description,
   '  Homepage text:' || chr(10) || nullif(trim(text), ''),
   '  Social links found on site: {{' || nullif((
     select string_agg('"' || platform || '": "' || url || '"', ', ' order by platform)
     from socials where socials.page_id = searched.page_id), '') || '}}') end
 || '\n\n' || case when len(company_results) = 0 and len(person_results) = 0
  then {quoted(PROMPT["snippets_absent"])}
  else {quoted(PROMPT["snippets"])} || '\n  Company results:\n'
   || {json_results_sql("company_results")} || '\n  Person results:\n'
   || {json_results_sql("person_results")} end
 || '\n\n' || {quoted(ANSWER_TEXT)} as prompt
from searched
"""))
def prompt_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads, pages = searched_leads(spark, sf_dir)
    known = add_missing_columns(with_texts(leads, pages), {"notes": "string"})
    return add_prompt(known, TAXONOMY).select("email", "prompt")


# Model answers of all kinds: good, off the vocabulary, numbers as text, out of range, missing keys,
# no object, no JSON.
_ANSWERS = """
select email, case id % 8
 when 0 then concat('{"industry":"FMCG","industry_confidence":0.8,"company_size":"small",',
  '"company_website":"https://n', cast(id as string), '.example",',
  '"relevance_to_plastics_machinery":0.35}')
 when 1 then concat('{"industry":"Space Travel","industry_confidence":"0.8",',
  '"company_size":"huge","relevance_score":0.6}')
 when 2 then concat('{"industry":"Packaging","industry_confidence":1.7,"relevance_score":-3,',
  '"relevance_to_plastics_machinery":0.0,"sub_category":"","person_linkedin":"https://l/in/x"}')
 when 3 then concat('{"industry":null,"industry_confidence":"high",',
  '"relevance_to_plastics_machinery":null,"relevance_score":"0.25"}')
 when 4 then '{}' when 5 then 'no json {'
 when 6 then concat('{"industry":"Textiles & Garments","industry_confidence":',
  cast(id % 100 as string), 'e-2,"relevance_to_plastics_machinery":true,',
  '"company_description":"Line ', cast(id as string), '","company_linkedin":"https://l/company/',
  cast(id as string), '"}')
 else '[1, 2]' end as answer
from leads
"""

_COERCED = f"""{LEADS}, answers as ({_ANSWERS}),
parsed as (
 select email, answer, coalesce(json_type(case when json_valid(answer) then answer end) = 'OBJECT',
   false) as usable,
  case when json_valid(answer) then answer::json end as j
 from answers
),
fields as (
 select *, j->>'industry' as industry_text, j->>'company_size' as size_text,
  try_cast(j->>'industry_confidence' as double) as confidence_value,
  case when j->>'relevance_to_plastics_machinery' = 'true' then 1.0
   when coalesce(try_cast(j->>'relevance_to_plastics_machinery' as double), 0) = 0
   then try_cast(j->>'relevance_score' as double)
   else try_cast(j->>'relevance_to_plastics_machinery' as double) end as relevance_value
 from parsed
)"""


@query(with_ctes(_COERCED, f"""
select email, usable, nullif(j->>'company_website', '') as company_website,
 nullif(j->>'company_description', '') as company_description,
 case when industry_text in {quoted_list(TAXONOMY)} then industry_text else 'Unknown' end
  as industry,
 case when confidence_value is null then 0.0 else greatest(0.0, least(1.0, confidence_value)) end::double as industry_confidence,
 nullif(j->>'sub_category', '') as sub_category,
 case when size_text in {quoted_list(COMPANY_SIZES)} then size_text else 'unknown' end
  as company_size,
 nullif(j->>'person_linkedin', '') as person_linkedin,
 nullif(j->>'company_linkedin', '') as company_linkedin,
 case when relevance_value is null then 0.0 else greatest(0.0, least(1.0, relevance_value)) end::double as relevance_score
from fields
"""))
def coerce_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, lead_table(spark, sf_dir))
    return add_coerced_answer(answers, TAXONOMY).select(
        "email", is_answer("answer").alias("usable"), "extracted.*"
    )


def _answers(spark: SparkSession, leads: DataFrame) -> DataFrame:
    leads.createOrReplaceTempView("leads")
    return spark.sql(_ANSWERS)


def _fraction_sql(start: int) -> str:
    return f"(('0x' || substr(md5(seed), {start}, 7))::bigint / {float(16**7)!r}::double)"


def _pick_sql(start: int, values) -> str:
    labels = "[" + ", ".join(quoted(v) for v in values) + "]"
    return f"({labels})[floor({_fraction_sql(start)} * {len(values)})::int + 1]"


PICKED = f"""{PLANNED},
seeded as (
 select *,
  case when scraped then final_url else company_results[1].link end as company_website,
  case when scraped then coalesce(description, nullif(left(text, 280), ''))
   else company_results[1].snippet end as company_description,
  coalesce((select url from socials where socials.page_id = searched.page_id
   and platform = 'linkedin'), company_results[2].link) as company_linkedin,
  person_results[1].link as person_linkedin
 from searched
),
picked as (
 select *, {_pick_sql(1, [t for t in TAXONOMY if t != "Unknown"])} as picked_industry,
  {_pick_sql(15, COMPANY_SIZES)} as company_size,
  round(case when scraped then 0.7::double + (0.95::double - 0.7::double) * {_fraction_sql(8)}
   else 0.55::double + (0.85::double - 0.55::double) * {_fraction_sql(8)} end, 2)
   as industry_confidence,
  round(0.3::double + 0.65::double * {_fraction_sql(22)}, 2) as picked_relevance
 from (select *, concat_ws('|', coalesce(company_name, 'x'), company_website) as seed from seeded)
)"""


@query(with_ctes(PICKED, """
select email, company_website, company_description, company_linkedin, person_linkedin,
 picked_industry as industry, company_size, industry_confidence, picked_relevance as relevance_score
from picked
"""))
def evidence_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads, _ = searched_leads(spark, sf_dir)
    picked = add_stand_in_extraction(leads, TAXONOMY)
    return picked.select("email", *[f"extracted.{c}" for c in (
        "company_website", "company_description", "company_linkedin", "person_linkedin",
        "industry", "company_size", "industry_confidence", "relevance_score",
    )])


def json_text(value: str) -> str:
    return f"coalesce(to_json({value})::varchar, 'null')"


RECORDED = f"""{PICKED},
recorded as (
 select *,
  '{{"snippets":{{"company_results":' || to_json(company_results)::varchar
  || ',"person_results":' || to_json(person_results)::varchar || '}}'
  || case when scraped then ',"scraped":{{"page_id":' || page_id
   || ',"status":"ok","final_url":' || {json_text("final_url")} || ',"title":' || {json_text("title")}
   || ',"description":' || {json_text("description")} || ',"text":' || {json_text("text")}
   || ',"social_links":{{' || coalesce((
     select string_agg('"' || platform || '":"' || url || '"', ',' order by platform)
     from socials where socials.page_id = picked.page_id), '')
   || '}},"about_url":' || {json_text("about_url")} || ',"about_text":null,"error":null}}' else '' end
  || ',"profile":{{"country":' || {json_text("country")} || ',"country_code":'
  || {json_text("country_code")} || ',"search_locale":' || {json_text("search_locale")}
  || ',"language":' || {json_text("language")} || '}}'
  || ',"search_plan":{{"company_query":' || {json_text("company_query")} || ',"person_query":'
  || {json_text("person_query")} || ',"params":{{' || concat_ws(',',
   '"gl":"' || search_locale || '"', '"hl":"' || language || '"') || '}}}}'
  || ',"extracted_fields":{{"industry":' || {json_text("picked_industry")}
  || ',"industry_confidence":' || industry_confidence || ',"sub_category":null,"company_size":'
  || {json_text("company_size")} || ',"relevance_score":' || picked_relevance
  || ',"company_website":' || {json_text("company_website")} || ',"company_linkedin":'
  || {json_text("company_linkedin")} || ',"person_linkedin":' || {json_text("person_linkedin")}
  || ',"company_description":' || {json_text("company_description")} || '}}}}' as enrichment_raw
 from picked
)"""


@query(with_ctes(RECORDED, "select email, enrichment_raw from recorded"))
def evidence_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads, pages = searched_leads(spark, sf_dir)
    picked = with_texts(add_stand_in_extraction(leads, TAXONOMY), pages)
    return picked.select("email", enrichment_record().alias("enrichment_raw"))


@query(with_ctes(RECORDED, """
select email, case when enriched_at is null then picked_industry else industry end as industry,
 case when enriched_at is null then picked_relevance else relevance_score end as relevance_score,
 case when enriched_at is null then company_website end as company_website,
 case when enriched_at is null then length(enrichment_raw) end as evidence_chars,
 strftime(coalesce(enriched_at, timestamp '2024-02-01 00:00:00'), '%Y-%m-%d') as enriched_on
from recorded
"""))
def enrichment_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole lead table: profile, store, site join, search, extraction, update."""
    columns = {
        "enrichment_raw": "string", "company_website": "string", "updated_at": "timestamp",
    }
    folder = shared_folder(spark, "leads")
    write_snapshot(profile_leads(lead_table(spark, sf_dir)).drop("language", "profile"), folder)
    stored = read_table(spark, folder, columns)
    sites, pages = parsed_sites(spark, sf_dir)
    enriched = enrich_leads(stored, sites, TAXONOMY, as_of(), pages=pages)
    return enriched.select(
        "email", "industry", "relevance_score", "company_website",
        F.length("enrichment_raw").cast("bigint").alias("evidence_chars"),
        F.date_format("enriched_at", "yyyy-MM-dd").alias("enriched_on"),
    )
