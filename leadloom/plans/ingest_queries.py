"""Cleaning, header mapping, dedup and ingest bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.columns import (
    header_dim,
    header_key,
    map_headers,
    resolve_columns,
    sample_rows,
)
from leadloom.operators.dedup import mark_duplicates
from leadloom.operators.ingest import (
    append_files,
    clean_leads,
    ingest_outcome,
    latest_uploads,
    new_leads,
    with_upload_id,
)
from leadloom.plans.inputs import LEADS_RAW, derived
from leadloom.plans.leads import ORDER, clean_table, lead_rows, raw_leads
from leadloom.plans.registry import entries_text, query
from leadloom.plans.sql import (
    HEADER_DIM,
    LEAD_ROWS,
    LEADS_CLEAN,
    QUALITY,
    quoted,
    with_ctes,
)
from leadloom.session import shared_folder
from leadloom.sources.tables import BUCKETS, read_bucketed, write_bucketed


@query(with_ctes(LEAD_ROWS, """
select row_id, source_file, name, email, phone, website_csv, company_name, country from lead_rows
"""))
def clean_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lead_rows(spark, sf_dir).select(
        "row_id", "source_file", "name", "email", "phone", "website_csv", "company_name", "country"
    )


@query(with_ctes(LEAD_ROWS, f"select row_id, {QUALITY} as data_quality_score from lead_rows"))
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lead_rows(spark, sf_dir).select("row_id", "data_quality_score")


# Addresses as people write them, and what they come to, both written by hand; `#` is the customer's
# number.
_INTERNATIONAL = (
    ("ü#@exämple.de", "ü#@exämple.de"),
    ("a#@xn--exmple-cua.de", "a#@exämple.de"),
    ("  JOSÉ.#@BÜCHER.Example.COM ", "josé.#@bücher.example.com"),
    ("用户#@例子。公司", "用户#@例子.公司"),
    ("x#@пример.рф", "x#@пример.рф"),
    ("x#@xn--e1afmkfd.xn--p1ai", "x#@пример.рф"),
    ("e\u0301#@x.in", "é#@x.in"),
    ("a#@straße.de", "a#@straße.de"),
    ("a #@exämple.de", None),
    ("a\u00a0#@exämple.de", None),
    ("é#..b@x.de", None),
    ("é#@localhost", None),
    ("é#@ab--c.de", None),
    ("a#@❤.ws", None),
    ("é#@-x.de", None),
    ("a#@xn--.de", None),
    ("é#@exämple", None),
    ("plain#@x.in", "plain#@x.in"),
    ("PLAIN#@x.in", "plain#@x.in"),
)


def _pick_sql(position: int) -> str:
    shown = [row[position] for row in _INTERNATIONAL]
    cases = " ".join(f"when {i} then {quoted(t)}" for i, t in enumerate(shown) if t is not None)
    number = "cast(c_custkey as string)"
    return f"replace(case c_custkey % {len(shown)} {cases} end, '#', {number})"


_FOREIGN_ROWS = f"select c_custkey as row_id, {_pick_sql(0)} as email from customer"


@query(f"select c_custkey as row_id, {_pick_sql(1)} as email from customer")
def clean_international(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with other than ASCII letters, next to answers written by hand."""
    rows = derived(spark, sf_dir, _FOREIGN_ROWS, ("customer",))
    resolved = resolve_columns(rows, map_headers(["email"]), ["row_id"])
    return clean_leads(resolved).select("row_id", "email")


# Every customer stands for one uploaded file in one of five header dialects; the spelling of the
# headers differs from file to file.
_FILE_HEADERS = """
select c_custkey as file_id,
 case c_custkey % 4 when 0 then header_line when 1 then upper(header_line)
  when 2 then replace(header_line, ' ', '_') else replace(lower(header_line), ' ', '-') end
  as header_line
from (
 select c_custkey, case c_custkey % 5
  when 0 then 'Full Name|Email Address|Mobile Number|Company|Address|City|State|PIN Code|Notes'
  when 1 then 'Name|Email|Phone|Organization|City|State|Industry Note'
  when 2 then 'First Name|Last Name|Work Email|Mobile|Company Name|City|State|Pincode'
  when 3 then 'Contact|EmailID|WhatsApp|Firm Name|Location'
  else concat('fullname|email|phone|businessname|address|city|state|', c_mktsegment) end
  as header_line
 from customer
) as dialects
"""


@query(with_ctes(f"files as ({_FILE_HEADERS}), {HEADER_DIM}", """
, headers as (
 select file_id, unnest(string_split(header_line, '|')) as header,
  generate_subscripts(string_split(header_line, '|'), 1) - 1 as pos
 from files
)
select file_id, pos::int as pos, header, field
from headers left join header_dim
 on header_dim.header_key = regexp_replace(lower(header), '[^a-z0-9]+', '', 'g')
"""))
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derived(spark, sf_dir, _FILE_HEADERS, ("customer",))
    headers = files.select(
        "file_id", F.posexplode(F.split("header_line", "[|]")).alias("pos", "header")
    ).withColumn("header_key", header_key("header"))
    return headers.join(F.broadcast(header_dim(spark)), "header_key", "left").select(
        "file_id", "pos", "header", "field"
    )


# Contact rows under headers of which several mean the same field.
_MESSY_ROWS = f"""
select row_id, email as `E-mail`,
 case when row_id % 3 = 0 then concat(' W', cast(row_id as string), '@Work.in ') else ' ' end
  as `Work Email`,
 first_name as `First Name`, last_name as `Last_Name`,
 case when row_id % 2 = 0 then full_name end as `Contact Person`,
 phone as `Mobile No.`, company_name as `Firm`, city as `Town`,
 cast(row_id % 10 as string) as `Internal Code`,
 case when row_id % 3 = 1 then concat(' ', industry) end as `Segment`
from ({LEADS_RAW}) as leads_raw
"""


@query(with_ctes(f"leads_raw as ({LEADS_RAW})", """
select row_id,
 coalesce(nullif(trim(case when row_id % 2 = 0 then full_name end), ''),
  nullif(concat_ws(' ', nullif(trim(first_name), ''), nullif(trim(last_name), '')), '')) as name,
 case when row_id % 3 = 0 then concat('W', cast(row_id as string), '@Work.in')
  else nullif(trim(email), '') end as email,
 nullif(trim(phone), '') as phone, nullif(trim(company_name), '') as company_name,
 nullif(trim(city), '') as city,
 concat_ws('; ', 'Internal Code=' || (row_id % 10),
  case when row_id % 3 = 1 and industry is not null then 'Segment=' || industry end) as raw_data
from leads_raw
"""))
def resolve_messy_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, _MESSY_ROWS, ("customer", "nation", "region", "pages"))
    resolved = resolve_columns(rows, map_headers(rows.columns), ["row_id"])
    return resolved.select(
        "row_id", "name", "email", "phone", "company_name", "city",
        entries_text("raw_data").alias("raw_data"),
    )


@query(with_ctes(f"leads_raw as ({LEADS_RAW})", """
, firsts as (
 select source_file, row_id, concat_ws('; ',
   'country=' || left(nullif(trim(country), ''), 200),
   'full_name=' || left(nullif(trim(full_name), ''), 200),
   'phone=' || left(nullif(trim(phone), ''), 200)) as cells
 from leads_raw qualify row_number() over (partition by source_file order by row_id) <= 9
)
select source_file, row_id, cells from firsts where cells <> ''
qualify row_number() over (partition by source_file order by row_id) <= 3
"""))
def file_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample per file is the feature; the whole table is read to find it."""
    rows = sample_rows(
        raw_leads(spark, sf_dir), ["full_name", "phone", "country"], order=["row_id"],
        group=["source_file"],
    )
    return rows.select("source_file", "row_id", entries_text("cells").alias("cells"))


@query(with_ctes(LEAD_ROWS, """
select row_id, source_file, email,
 case when email is null then 'skipped' when place = 1 then 'new' else 'duplicate' end as outcome,
 email is not null and place > 1 as is_duplicate,
 case when email is not null and place > 1 then email end as duplicate_of
from (
 select *, row_number() over (partition by email order by source_file, row_id) as place
 from lead_rows
)
"""))
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lead_rows(spark, sf_dir).select("row_id", "source_file", "email")
    return mark_duplicates(rows, ORDER).select(
        "row_id", "source_file", "email", "outcome", "is_duplicate", "duplicate_of"
    )


def _stored_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of the first file, as ingested earlier."""
    return clean_table(spark, sf_dir).where(F.col("source_file") == "a.csv").select("email")


_OUTCOME = f"""{LEADS_CLEAN},
stored as (select email from leads_clean where source_file = 'a.csv'),
incoming as (
 select l.source_file, l.row_id, l.email, s.email is not null as known,
  row_number() over (partition by l.email order by l.source_file, l.row_id) as place
 from lead_rows l left join stored s on s.email = l.email
),
outcome as (
 select source_file as filename, count(*) as total_records,
  count(*) filter (where email is not null and place = 1 and not known) as new_records,
  count(*) filter (where email is not null and (place > 1 or known)) as duplicate_records,
  count(*) filter (where email is null) as skipped_records, min(row_id) as id
 from incoming group by source_file
)"""


@query(with_ctes(_OUTCOME, """
select filename, total_records, new_records, duplicate_records, skipped_records from outcome
"""), name="ingest_outcome")
def outcome_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three files again after the first one was stored: its rows are all duplicates."""
    rows = lead_rows(spark, sf_dir).select("row_id", "source_file", "email")
    return ingest_outcome(rows, ORDER, _stored_leads(spark, sf_dir))


@query(with_ctes(_OUTCOME, """
select row_id, source_file, email from incoming
where email is not null and place = 1 and not known
"""))
def new_leads_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored e-mails are dealt to buckets once; only the incoming rows move."""
    rows = lead_rows(spark, sf_dir).select("row_id", "source_file", "email")
    folder = shared_folder(spark, "bucketed-emails")
    write_bucketed(_stored_leads(spark, sf_dir), folder, "email", BUCKETS)
    return new_leads(rows, ORDER, read_bucketed(spark, folder, "email", BUCKETS))


@query(with_ctes(_OUTCOME, """
select filename, id, id as upload_id, total_records, new_records, duplicate_records,
 skipped_records
from outcome order by id desc limit 100
"""))
def upload_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history row per file, numbered by its first row, newest first."""
    rows = lead_rows(spark, sf_dir).select("row_id", "source_file", "email")
    ids = rows.groupBy(F.col("source_file").alias("filename")).agg(F.min("row_id").alias("id"))
    results = ingest_outcome(rows, ORDER, _stored_leads(spark, sf_dir))
    return latest_uploads(with_upload_id(results, ids).withColumn("id", F.col("upload_id")))


@query(with_ctes(f"leads_raw as ({LEADS_RAW})", """
select row_id, nullif(trim(email), '') as email,
 case when source_file = 'a.csv' then nullif(trim(company_name), '') end as company_name,
 case when source_file <> 'a.csv' then nullif(trim(city), '') end as city,
 case when source_file = 'a.csv' then 'referrals' else 'inquiries' end as source_file
from leads_raw
"""))
def append_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files with differing headers become one table."""
    raw = raw_leads(spark, sf_dir)
    referrals = raw.where(F.col("source_file") == "a.csv").select(
        "row_id", F.col("email").alias("EmailID"), F.col("company_name").alias("Firm Name")
    )
    inquiries = raw.where(F.col("source_file") != "a.csv").select(
        "row_id", F.col("email").alias("E-Mail"), F.col("city").alias("Town")
    )
    parts = [
        resolve_columns(f, map_headers(f.columns), ["row_id"]).withColumn(
            "source_file", F.lit(label)
        )
        for f, label in ((referrals, "referrals"), (inquiries, "inquiries"))
    ]
    return append_files(parts).select("row_id", "email", "company_name", "city", "source_file")
