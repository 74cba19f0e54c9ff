"""Pages: parsing, links, social profiles, about pages, robots rules, fetch outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.constants import ABOUT_ANCHOR_TEXTS, ABOUT_PATH_PATTERNS, SOCIAL_PATTERNS
from leadloom.functions.urls import canonical_url, url_host, url_path
from leadloom.operators.pages import (
    about_link,
    add_about_pages,
    fetch_status,
    native_pages,
    page_links,
    parse_pages,
    site_records,
    social_links,
    social_platform,
    write_parsed,
)
from leadloom.operators.robots import robots_rules, with_robots_verdict
from leadloom.plans.inputs import FETCH_LOG, PAGES_MARKED, ROBOTS_BODIES, derived, table
from leadloom.plans.registry import entries_text, query
from leadloom.plans.sql import (
    HOST,
    PAGES,
    PATH,
    QUERY,
    SCHEME,
    canonical_url_sql,
    quoted,
    quoted_list,
    with_ctes,
)
from leadloom.session import shared_folder
from leadloom.sources.tables import write_snapshot

USER_AGENT = "LeadLoomBot/1.0"

_HIDDEN = "|".join(rf"<{t}\b.*?</{t}\s*>" for t in ("script", "style", "noscript", "svg", "head"))


def _text_sql(column: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(regexp_replace({column}, '(?is){_HIDDEN}', ' ', 'g'),"
        r" '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
    )


_LINK = r"""'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'"""

LINKS = f"""{PAGES},
found as (
 select page_id, url as base, unnest(regexp_extract_all(html, {_LINK}, 1)) as raw_href,
  unnest(regexp_extract_all(html, {_LINK}, 2)) as raw_text,
  generate_subscripts(regexp_extract_all(html, {_LINK}, 1), 1) - 1 as pos
 from pages_marked
),
links as (
 select page_id, base, pos::int as pos, trim(raw_href) as href, {_text_sql("raw_text")} as text,
  case when regexp_matches(trim(raw_href), '^[A-Za-z][A-Za-z0-9+.-]*:') then trim(raw_href)
   when trim(raw_href) like '//%' then {SCHEME.format("base")} || ':' || trim(raw_href)
   when trim(raw_href) like '/%'
    then {SCHEME.format("base")} || '://' || {HOST.format("base")} || trim(raw_href)
   else {SCHEME.format("base")} || '://' || {HOST.format("base")} || coalesce(nullif(
    regexp_replace({PATH.format("base")}, '[^/]*$', ''), ''), '/') || trim(raw_href) end as url
 from found
 where trim(raw_href) <> '' and trim(raw_href) not like '#%'
  and trim(raw_href) not like 'javascript:%'
)"""

_PLATFORM = "case " + " ".join(
    f"when regexp_matches(url, {quoted('(?i)' + p)}) then '{name}'"
    for name, p in SOCIAL_PATTERNS.items()
) + " end"

def _unescaped_sql(column: str) -> str:
    """The entities that occur in the pages, the ampersand last."""
    text = column
    for entity, letter in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        text = f"replace({text}, '{entity}', '{letter}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


SITES = f"""{LINKS},
socials as (
 select page_id, platform, arg_min(url, pos) as url, min(pos) as pos
 from (select *, {_PLATFORM} as platform from links) where platform is not null
 group by page_id, platform
),
social_text as (
 select page_id, string_agg(platform || '=' || url, '; ' order by platform) as social_links
 from socials group by page_id
),
abouts as (
 select page_id, arg_min(url, pos) as about_url from links
 where lower({HOST.format("url")}) = lower({HOST.format("base")})
  and (regexp_matches(coalesce(nullif({PATH.format("url")}, ''), '/'),
    {quoted("(?i)" + "|".join(ABOUT_PATH_PATTERNS))})
   or lower(text) in {quoted_list(ABOUT_ANCHOR_TEXTS)})
 group by page_id
),
native as (
 select page_id, url,
  nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') as title,
  coalesce(
   nullif(trim(regexp_extract(html, '(?is)<meta\\s+name="description"\\s+content="([^"]*)"', 1)), ''),
   nullif(trim(regexp_extract(html,
    '(?is)<meta\\s+property="og:description"\\s+content="([^"]*)"', 1)), '')) as description,
  {_text_sql("html")} as text, {canonical_url_sql("url")} as url_norm
 from pages_marked
),
sites as (
 select page_id, url, url_norm, {_unescaped_sql("title")} as title,
  {_unescaped_sql("description")} as description, {_unescaped_sql("text")} as text,
  coalesce(social_links, '') as social_links, about_url
 from native left join social_text using (page_id) left join abouts using (page_id)
 qualify row_number() over (partition by url_norm order by page_id) = 1
)"""


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, PAGES_MARKED)


def parsed_once(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The pages parsed and written, for queries that join them."""
    folder = shared_folder(spark, "pages")
    write_parsed(parse_pages(pages), folder)
    return spark.read.parquet(folder)


def parsed_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(site records without texts, stored pages with theirs)."""
    pages = parsed_once(spark, marked_pages(spark, sf_dir))
    return site_records(pages, texts=False), pages


@query(with_ctes(SITES, "select page_id, title, description, text from native"))
def page_title_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, description and whole visible text by patterns."""
    return native_pages(marked_pages(spark, sf_dir)).select(
        "page_id", "title", "description", "text"
    )


@query(with_ctes(LINKS, "select page_id, pos, href, url, text from links"), name="page_links")
def links_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(native_pages(marked_pages(spark, sf_dir)))


@query(with_ctes(LINKS, f"""
select page_id, pos, url, {_PLATFORM} as platform from links where {_PLATFORM} is not null
"""))
def social_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        page_links(native_pages(marked_pages(spark, sf_dir)))
        .select("page_id", "pos", "url", social_platform("url").alias("platform"))
        .where(F.col("platform").isNotNull())
    )


@query(with_ctes(SITES, """
select page_id, coalesce(social_links, '') as social_links
from native left join social_text using (page_id)
"""))
def page_socials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native_pages(marked_pages(spark, sf_dir)).select(
        "page_id", entries_text(social_links("links")).alias("social_links")
    )


@query(with_ctes(SITES, "select page_id, about_url from native left join abouts using (page_id)"))
def page_about_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native_pages(marked_pages(spark, sf_dir)).select(
        "page_id", about_link("links", "url").alias("about_url")
    )


@query(with_ctes(SITES, f"""
select page_id, {_unescaped_sql("title")} as title, {_unescaped_sql("description")} as description,
 {_unescaped_sql("text")} as text, coalesce(n, 0) as links,
 coalesce(social_links, '') as social_links, about_url
from native left join social_text using (page_id) left join abouts using (page_id)
left join (select page_id, count(*) as n from links group by page_id) using (page_id)
"""))
def page_text_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full parser form over whole pages."""
    parsed = parse_pages(marked_pages(spark, sf_dir), max_chars=None)
    return parsed.select(
        "page_id", "title", "description", "text", F.size("links").cast("long").alias("links"),
        entries_text(social_links("links")).alias("social_links"),
        about_link("links", "url").alias("about_url"),
    )


# The same pages plus, for each, the about page it links to.
WITH_ABOUT_PAGES = f"""
select page_id, url, html from ({PAGES_MARKED}) as pages_marked
union all
select page_id + 1000000000 as page_id,
 concat(substring(url, 1, length(url) - length(path)), '/about-us') as url,
 concat('<html><head><title>About</title></head><body>We are number ', cast(page_id as string),
  '.<a href="https://www.instagram.com/n', cast(page_id as string), '">I</a>',
  '<a href="https://www.linkedin.com/company/late">L</a></body></html>') as html
from (select *, substring(url, 9 + strpos(substring(url, 9), '/') - 1) as path from pages) as cut
where page_id % 5 = 0
"""


def with_spark_names(text: str) -> str:
    """The text with the one function that the two dialects name differently."""
    return text.replace("strpos(substring(url, 9), '/')", "locate('/', substring(url, 9))")


@query(f"""
with {SITES.replace(PAGES_MARKED, WITH_ABOUT_PAGES)},
merged as (
 select s.page_id, a.page_id as about_id, s.about_url, coalesce(a.text, '') as about_text
 from sites s left join sites a on a.url_norm = {canonical_url_sql("s.about_url")}
),
kept as (
 select page_id, platform, arg_min(url, place) as url from (
  select m.page_id, platform, url, 0 as place from merged m join socials using (page_id)
  union all
  select m.page_id, platform, url, 1 from merged m join socials s on s.page_id = m.about_id
 ) group by page_id, platform
)
select m.page_id, about_url, about_text,
 coalesce(string_agg(platform || '=' || url, '; ' order by platform), '') as social_links
from merged m left join kept using (page_id) group by m.page_id, about_url, about_text
""")
def site_with_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with the text of their about page; profiles of the home page win."""
    pages = derived(spark, sf_dir, with_spark_names(WITH_ABOUT_PAGES), ("pages",))
    sites = add_about_pages(site_records(parsed_once(spark, pages)))
    return sites.select(
        "page_id", "about_url", "about_text", entries_text("social_links").alias("social_links")
    )


# Addresses as people write them, from the page addresses.
_WRITTEN_URLS = """
select page_id, case page_id % 8 when 0 then concat('  ', replace(url, 'http://', 'HTTP://'), '/ ')
  when 1 then replace(replace(url, 'https://', ''), 'http://', '') when 2 then concat(url, '///')
  when 3 then concat(url, ';v=2') when 4 then 'http://' when 5 then concat(url, '#part?x=1')
  when 6 then upper(url) else concat('not a url ', cast(page_id as string)) end as raw
from pages
"""


@query(f"""
with written as ({_WRITTEN_URLS})
select page_id, raw, url, {HOST.format("url")} as host, {PATH.format("url")} as path
from (select *, {canonical_url_sql("raw")} as url from written)
""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = derived(spark, sf_dir, _WRITTEN_URLS, ("pages",))
    return written.withColumn("url", canonical_url("raw")).select(
        "page_id", "raw", "url", url_host("url").alias("host"), url_path("url").alias("path")
    )


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = derived(spark, sf_dir, ROBOTS_BODIES).withColumn(
        "body", F.replace("body", F.lit("|"), F.lit("\n"))
    )
    return robots_rules(bodies, USER_AGENT)


# What the four robots texts say, worked out by hand: no file, or a host whose group has no rules,
# allows everything.
@query(f"""
select page_id, url, case
 when length(host) % 7 = 3 then true
 when length(host) % 4 = 0 then not starts_with(target, '/en/')
 when length(host) % 4 = 1 then starts_with(target, '/en/6') or not starts_with(target, '/en')
 when length(host) % 4 = 2 then true
 else starts_with(target, '/fr') or not (starts_with(target, '/f') or starts_with(target, '/de/'))
 end as robots_allowed
from (
 select page_id, url, lower({HOST.format("url")}) as host,
  coalesce(nullif({PATH.format("url")}, ''), '/')
  || case when {QUERY.format("url")} <> '' then '?' || {QUERY.format("url")} else '' end as target
 from pages
)
""")
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return with_robots_verdict(pages, _robots(spark, sf_dir), spread_by=["page_id"]).select(
        "page_id", "url", "robots_allowed"
    )


@query(f"""
with fetch_log as ({FETCH_LOG})
select event_id, status_code, case when url = '' then 'skipped'
 when not robots_allowed then 'blocked_by_robots' when error = 'timeout' then 'timeout'
 when error is not null then 'network_error' when status_code >= 400 then 'http_error'
 when content_type = 'application/pdf' then 'not_html' else 'ok' end as status
from fetch_log
""", name="fetch_status")
def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived(spark, sf_dir, FETCH_LOG)
    return log.select(
        "event_id", "status_code",
        fetch_status("url", "status_code", "content_type", "error", "robots_allowed")
        .alias("status"),
    )
