"""Contact-shaped inputs derived from the test tables.

Each text is plain SQL that Spark and DuckDB both run unchanged; every row of the source table goes
in.  `AS_OF` stands in for the current time everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "timestamp '2024-02-01 00:00:00'"

# One dirty contact row per customer: padded names, addresses repeated in other rows and other case,
# one shared mailbox that holds a ninth of all rows, phones and countries in many spellings.
LEADS_RAW = f"""
select c_custkey as row_id,
 case c_custkey % 3 when 0 then 'a.csv' when 1 then 'b.csv' else 'c.csv' end as source_file,
 case when c_custkey % 11 = 0 then '' when c_custkey % 11 = 1 then '   '
  else concat('  ', c_name, ' ') end as full_name,
 case when c_custkey % 5 = 0 then '' else concat('First', cast(c_custkey % 50 as string)) end
  as first_name,
 case when c_custkey % 4 = 0 then '' else concat('Last', cast(c_custkey % 40 as string)) end
  as last_name,
 case when c_custkey % 17 = 0 then 'not-an-email' when c_custkey % 13 = 0 then ''
  when c_custkey % 9 = 4 then 'Sales@Mail0.in'
  else concat(case when c_custkey % 2 = 0 then 'User' else 'user' end,
   cast(person as string), '@Mail', cast(person % 10 as string), '.',
   case person % 8 when 0 then 'dz' when 1 then 'in' when 2 then 'com' when 3 then 'fr'
    when 4 then 'co.uk' when 5 then 'io' when 6 then 'de' else 'co' end) end as email,
 case c_custkey % 8 when 0 then concat('+213', lpad(cast(c_custkey as string), 8, '0'))
  when 1 then concat('0', lpad(cast(c_custkey as string), 10, '9'))
  when 2 then concat('98765-', lpad(cast(c_custkey as string), 5, '0'))
  when 3 then concat('0033 ', lpad(cast(c_custkey as string), 9, '1'))
  when 4 then '---' when 5 then null
  when 6 then concat('+1 (212) ', lpad(cast(c_custkey as string), 7, '5'))
  else concat('91', lpad(cast(c_custkey as string), 10, '7')) end as phone,
 case c_custkey % 10 when 0 then 'Algérie' when 1 then ' India ' when 2 then 'IN'
  when 3 then 'Wakanda' when 4 then null when 5 then 'Deutschland' when 6 then 'uk' when 7 then ''
  when 8 then 'España' else 'fr' end as country,
 case when c_custkey % 19 = 0 then null else concat('Co "', c_name, '" Ltd') end as company_name,
 case when c_custkey % 9 = 0 then '' else n_name end as city,
 case when c_custkey % 23 = 0 then null else r_name end as state,
 case when c_custkey % 6 = 0 then lpad(cast(c_custkey as string), 6, '4') end as pincode,
 case when c_custkey % 4 = 0 then null
  when c_custkey % 4 = 1 then concat('  ', replace(replace(url, 'https://', ''), 'http://', ''), ' ')
  else concat(url, case when c_custkey % 3 = 0 then '/' else '' end) end as website,
 case when c_custkey % 14 = 0 then null when c_custkey % 14 = 1 then 'Legacy Label'
  else case c_mktsegment when 'AUTOMOBILE' then 'Automotive & Auto Components'
   when 'BUILDING' then 'Construction & Building Materials'
   when 'FURNITURE' then 'Other Manufacturing' when 'MACHINERY' then 'Plastics & Polymers'
   else 'FMCG' end end as industry,
 case when c_custkey % 7 = 0 then null else cast(c_custkey * 37 % 101 as double) / 100 end
  as relevance_score,
 case when c_custkey % 5 = 0 then null else {AS_OF} - (c_custkey % 61) * interval '1' day end
  as email_validated_at,
 case when c_custkey % 3 = 0 then timestamp '2024-01-15 00:00:00' end as enriched_at
from (
 select *, case when c_custkey % 4 = 3 then c_custkey - 3 else c_custkey end as person,
  c_custkey % (select count(*) from pages) as page_number
 from customer
) as numbered
join nation on c_nationkey = n_nationkey
join region on n_regionkey = r_regionkey
join pages on page_id = page_number
"""

# Pages with descriptions, social links and about links put in, which the raw pages do not have.
PAGES_MARKED = """
select page_id, url,
 replace(replace(html, '</head>', concat(
   case when page_id % 2 = 0 then concat('<meta name="description" content="Maker number ',
    cast(page_id as string), '">') else '' end,
   case when page_id % 3 = 0 then concat('<meta property="og:description" content="OG ',
    cast(page_id as string), '">') else '' end, '</head>')),
  '</footer>', concat(
   case when page_id % 2 = 0 then concat('<a href="https://www.linkedin.com/company/co-',
    cast(page_id as string), '">LinkedIn</a>') else '' end,
   case when page_id % 4 = 0 then '<a href="https://fr.linkedin.com/in/second">second</a>'
    else '' end,
   case when page_id % 3 = 0 then concat('<a href="https://x.com/co', cast(page_id as string),
    '">X</a>') else '' end,
   case when page_id % 5 = 0 then '<a href="/about-us">About Us</a>'
    when page_id % 5 = 1 then '<a href="/p-9">Qui sommes-nous</a>'
    when page_id % 5 = 2 then '<a href="https://other.example.org/about">About</a>' else '' end,
   '<a href="#top">skip</a><a href="javascript:void(0)">js</a></footer>')) as html
from pages
"""

# Run-log shaped events.
RUN_LOG = """
select event_id % 7 as run_id, event_id, ts,
 case event_type when 'signup' then 'stage_start' when 'purchase' then 'stage_end'
  when 'error' then 'error' else 'website_scraped' end as event,
 case event_id % 5 when 0 then 'email_validation' when 1 then 'data_profiling'
  when 2 then 'website_scraping' when 3 then 'web_search' else 'llm_extraction' end as stage,
 concat('user', cast(user_id as string), '@mail.example.com') as email,
 concat('{"api_key":"k', cast(event_id as string), '","value":', cast(event_id % 100 as string),
  ',"Authorization": "Bearer x', cast(event_id as string), '","note":"token free"}') as request
from events
"""

# Outcome of each unit of work of a run, for counters.
STAGE_ROWS = """
select event_id % 7 as run_id, ts,
 case event_id % 5 when 0 then 'email_validation' when 1 then 'data_profiling'
  when 2 then 'website_scraping' when 3 then 'web_search' else 'llm_extraction' end as stage,
 case event_type when 'error' then 'failed' when 'view' then 'skipped' else 'ok' end as outcome,
 concat('unit ', cast(event_id as string), ' ', props) as message
from events
"""

# Runs, one per day of events.
RUNS = """
select cast(extract(day from ts) as bigint) as id, 'incremental' as run_type,
 min(ts) as started_at,
 case when extract(day from ts) % 2 = 0 then max(ts) end as completed_at,
 case when extract(day from ts) % 2 = 0 then 'completed' else 'running' end as status,
 count(*) as total_records
from events group by extract(day from ts)
"""

# Result of fetching the page an event points to.
FETCH_LOG = """
select event_id,
 case when event_id % 29 = 0 then '' else url end as url,
 case when event_id % 11 in (1, 2) then null when event_id % 7 = 3 then 404
  when event_id % 13 = 5 then 503 else 200 end as status_code,
 case event_id % 6 when 0 then 'application/pdf' when 1 then '' when 2 then null
  when 3 then 'application/xhtml+xml' else 'Text/HTML; charset=utf-8' end as content_type,
 case event_id % 11 when 1 then 'timeout' when 2 then 'ConnectError' end as error,
 event_id % 17 <> 4 as robots_allowed
from (select *, event_id % (select count(*) from pages) as page_number from events) as numbered
join pages on page_id = page_number
"""

# One robots file per host of the pages; the host name decides which of four texts it has.
# Lines are separated by `|` here, since the two dialects write a line break differently.
ROBOTS_BODIES = """
select host, case length(host) % 4
  when 0 then 'User-agent: *|Disallow: /en/|Allow: /'
  when 1 then '# all but us|User-agent: otherbot|User-agent: LeadLoomBot|Allow: /en/6|Disallow: /en|Crawl-delay: 5|User-agent: *|Disallow: /'
  when 2 then 'User-agent: leadloombot||Disallow: /|User-agent: *|Disallow:'
  else 'Disallow: /|User-agent: somebot # note|Disallow: /|User-agent: *|Allow: /fr|Disallow: /f|Disallow: /de/' end as body
from (
 select distinct lower(split_part(split_part(url, '/', 3), '?', 1)) as host from pages
) as hosts where length(host) % 7 <> 3
"""

# Source tables of each text.
SOURCES = {
    LEADS_RAW: ("customer", "nation", "region", "pages"),
    PAGES_MARKED: ("pages",),
    RUN_LOG: ("events",),
    STAGE_ROWS: ("events",),
    RUNS: ("events",),
    FETCH_LOG: ("events", "pages"),
    ROBOTS_BODIES: ("pages",),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derived(
    spark: SparkSession, sf_dir: str, text: str, sources: tuple[str, ...] | None = None
) -> DataFrame:
    """The rows of one of the texts above; its source tables become views first."""
    for name in sources or SOURCES[text]:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)
