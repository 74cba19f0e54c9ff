"""SQL building blocks of the oracles, written independently of the Spark expressions."""

from __future__ import annotations

from leadloom.constants import (
    COUNTRIES,
    COUNTRY_ALIASES,
    EMAIL_PATTERN,
    FOLDED_FROM,
    FOLDED_TO,
    GENERIC_TLDS,
    HEADER_FIELDS,
    SHARED_CALLING_CODES,
    SPECIAL_USE_DOMAINS,
)
from leadloom.functions.geo import sql_values
from leadloom.plans.inputs import LEADS_RAW, PAGES_MARKED


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quoted_list(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


_EMAIL_OK = f"""
  length(e) between 3 and 254 and strpos(e, '@') between 2 and 65
  and regexp_matches(e, {quoted('^' + EMAIL_PATTERN + '$')})
  and not regexp_matches(e, '@.*[a-z0-9-]{{64}}')
  and not regexp_matches(e, '@(.*[.])?[a-z0-9-][a-z0-9-]--')
  and not regexp_matches(e, '[.]({'|'.join(SPECIAL_USE_DOMAINS)})$')
"""

LEAD_ROWS = f"""
leads_raw as ({LEADS_RAW}),
lead_cells as (
 select row_id, source_file, industry, relevance_score, email_validated_at, enriched_at,
  coalesce(nullif(trim(full_name), ''), nullif(concat_ws(' ', nullif(trim(first_name), ''),
   nullif(trim(last_name), '')), '')) as name,
  lower(trim(email)) as e, regexp_replace(phone, '[^0-9]', '', 'g') as d0,
  nullif(trim(company_name), '') as company_name, nullif(trim(city), '') as city,
  nullif(trim(state), '') as state, nullif(trim(pincode), '') as pincode,
  nullif(trim(country), '') as country, nullif(trim(website), '') as w
 from leads_raw
),
lead_rows as (
 select * exclude (e, d0, w, d),
  case when {_EMAIL_OK} then e end as email,
  case when length(d) = 10 then '+91' || d when length(d) between 7 and 15 then '+' || d end
   as phone,
  case when w like '%/' and length(w) > 1 then left(w, length(w) - 1) else w end as website_csv
 from (
  select *, case when d0 like '00%' then substr(d0, 3) when d0 like '0%' then substr(d0, 2)
   else d0 end as d
  from lead_cells
 )
)
"""

LEADS_CLEAN = f"""{LEAD_ROWS},
leads_clean as (
 select * from lead_rows where email is not null
 qualify row_number() over (partition by email order by source_file, row_id) = 1
)
"""

QUALITY = """round(
 case when name is not null then 0.15 else 0 end + case when email is not null then 0.3 else 0 end
 + case when phone is not null then 0.1 else 0 end
 + case when company_name is not null then 0.2 else 0 end
 + case when city is not null then 0.1 else 0 end + case when state is not null then 0.1 else 0 end
 + case when pincode is not null then 0.05 else 0 end, 3)::double"""

LEADS = f"""{LEADS_CLEAN},
leads as (
 select *, row_id as id,
  case source_file when 'a.csv' then timestamp '2024-01-01 08:00:00'
   when 'b.csv' then timestamp '2024-01-02 08:00:00' else timestamp '2024-01-03 08:00:00' end
   as created_at,
  case when h < 6 then 'valid' when h < 8 then 'catch-all' else 'invalid' end as email_status,
  'mock_mode' as email_sub_status,
  case when h < 6 then 'active' when h < 8 then 'unknown' else 'inactive' end as email_activity,
  case when h < 6 then round(0.7 + h / 30, 2) when h < 8 then 0.5 else 0.0 end::double
   as email_activity_score
 from (
  select *, list_sum(list_transform(string_split(email, ''), lambda c: unicode(c))) % 10 as h
  from leads_clean
 )
)
"""

GEO_DIMS = f"""
countries as (
 select * from (values {sql_values(COUNTRIES)}) as t(code, country, calling, language)
),
country_names as (
 select lower(country) as name_key, code from countries
 union select * from (values {sql_values(COUNTRY_ALIASES.items())}) as t(name_key, code)
),
callings as (
 select calling, code from countries
  where calling not in {quoted_list(SHARED_CALLING_CODES)}
 union all select * from (values {sql_values(SHARED_CALLING_CODES.items())}) as t(calling, code)
)
"""

# One vote per kind of evidence, summed per country: the weighted vote as it is stated.
GEO = f"""{LEADS},
{GEO_DIMS},
keyed as (
 select *,
  translate(replace(lower(country), 'ß', 'ss'), '{FOLDED_FROM}', '{FOLDED_TO}') as name_key,
  regexp_replace(phone, '[^0-9]', '', 'g') as digits,
  reverse(split_part(reverse(email), '.', 1)) as tld
 from leads
),
evidence as (
 select keyed.*,
  coalesce(n.code, iso.code) as by_country, p.code as by_phone,
  case when tld = 'uk' then 'GB' when tld not in {quoted_list(GENERIC_TLDS)} then t.code end
   as by_tld
 from keyed
 left join country_names n on n.name_key = keyed.name_key
 left join countries iso on iso.code = upper(keyed.country)
 left join callings p on starts_with(digits, p.calling)
 left join countries t on lower(t.code) = tld
),
votes as (
 select email, by_country as code, 0.6 as weight from evidence where by_country is not null
 union all select email, by_phone, 0.4 from evidence where by_phone is not null
 union all select email, by_tld, 0.3 from evidence where by_tld is not null
),
tally as (select email, code, sum(weight) as weight from votes group by email, code),
winners as (
 select email, arg_max(code, weight) as win, max(weight) as support from tally group by email
),
profiled as (
 select evidence.* exclude (country), evidence.country as country_csv, c.country, win as country_code,
  lower(win) as search_locale, c.language,
  concat_ws('; ',
   case when evidence.country is not null
    then 'csv_country=''' || evidence.country || '''->' || coalesce(by_country, 'unknown') end,
   case when by_phone is not null
    then 'phone_prefix=''' || left(phone, 6) || '''->' || by_phone end,
   case when by_tld is not null then 'email_tld=''.' || tld || '''->' || by_tld
    when tld in {quoted_list(GENERIC_TLDS)}
    then 'email_tld=''.' || tld || '''->generic(ignored)' end) as signals,
  case when support is null then 0.0 else round(least(support, 1.0), 3) end::double as confidence
 from evidence left join winners using (email) left join countries c on c.code = win
)
"""

HEADER_DIM = (
    "header_dim as (select * from (values "
    + sql_values(HEADER_FIELDS.items())
    + ") as t(header_key, field))"
)

PAGES = f"pages_marked as ({PAGES_MARKED})"

SCHEME = r"lower(regexp_extract({0}, '^([^:/?#]+)://', 1))"
HOST = r"regexp_extract({0}, '^[^:/?#]+://([^/?#]*)', 1)"
PATH = r"regexp_extract({0}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract({0}, '^[^?#]*\?([^#]*)', 1)"


def canonical_url_sql(column: str) -> str:
    """The canonical address, from the text up to the fragment."""
    text = f"nullif(trim({column}), '')"
    full = (
        f"case when regexp_matches({text}, '(?i)^https?://') then {text} "
        f"else 'https://' || {text} end"
    )
    path = rf"regexp_replace(regexp_replace({PATH.format(full)}, ';[^/]*$', ''), '/+$', '')"
    return (
        f"case when {HOST.format(full)} <> '' then {SCHEME.format(full)} || '://' || "
        f"{HOST.format(full)} || {path} || case when {QUERY.format(full)} <> '' "
        f"then '?' || {QUERY.format(full)} else '' end end"
    )


def with_ctes(ctes: str, select: str) -> str:
    return f"with {ctes.strip()}\n{select.strip()}"
