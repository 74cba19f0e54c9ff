"""Run logs, run counters, throttling, and the file and stream round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.rates import parse_rate
from leadloom.functions.redact import mask_scalars
from leadloom.operators import runlog
from leadloom.operators.ingest import clean_leads, ingest_outcome, new_leads
from leadloom.operators.throttle import admit_hits, hits_in_window
from leadloom.plans.inputs import RUN_LOG, RUNS, STAGE_ROWS, derived, table
from leadloom.plans.leads import HEADERS, raw_leads
from leadloom.plans.registry import entries_text, query, time_text
from leadloom.plans.sql import LEADS_CLEAN, QUALITY, with_ctes
from leadloom.session import shared_folder
from leadloom.sources.files import ROW_ORDER, read_csv_files
from leadloom.sources.runlogs import append_run_log, iso_utc, read_run_log
from leadloom.streaming.ingest import run_to_end, stream_leads, upload_stream

_DAY = 86_400
_TIME = "'%Y-%m-%d %H:%M:%S'"


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RUN_LOG)


# --- counters ------------------------------------------------------------------------------------
@query(with_ctes(f"run_log as ({RUN_LOG})", f"""
select run_id, stage, count(*) as events, count(*) filter (where event = 'error') as errors,
 strftime(min(ts) filter (where event = 'stage_start'), {_TIME}) as started_at,
 strftime(max(ts) filter (where event = 'stage_end'), {_TIME}) as ended_at,
 epoch(date_trunc('second', max(ts) filter (where event = 'stage_end')))::bigint
  - epoch(date_trunc('second', min(ts) filter (where event = 'stage_start')))::bigint
  as span_seconds
from run_log group by run_id, stage
"""))
def run_stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.log_rollup(run_log(spark, sf_dir)).withColumns({
        "started_at": time_text("started_at"), "ended_at": time_text("ended_at"),
    })


@query(with_ctes(f"stage_rows as ({STAGE_ROWS})", """
select run_id, stage, count(*) as total, count(*) filter (where outcome <> 'failed') as processed,
 count(*) filter (where outcome = 'ok') as ok, count(*) filter (where outcome = 'skipped') as skipped,
 round(100.0 * count(*) filter (where outcome <> 'failed') / count(*), 1) as pct
from stage_rows group by run_id, stage
"""), name="stage_counters")
def counters_per_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.stage_counters(derived(spark, sf_dir, STAGE_ROWS))


@query(with_ctes(f"stage_rows as ({STAGE_ROWS})", """
, runs as (select distinct run_id from stage_rows),
stages as (
 select * from (values (0, 'ingest'), (1, 'email_validation'), (2, 'data_profiling'),
  (3, 'website_scraping'), (4, 'web_search'), (5, 'llm_extraction'), (6, 'finalize'))
  as t(position, stage)
)
select r.run_id, s.position, s.stage, nullif(count(outcome), 0) as total,
 case when count(outcome) = 0 then 'pending' when bool_or(outcome = 'failed') then 'running'
  else 'completed' end as status
from runs r join stages s on true
left join stage_rows x on x.run_id = r.run_id and x.stage = s.stage
group by r.run_id, s.position, s.stage
"""), name="run_progress")
def progress_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = runlog.stage_counters(derived(spark, sf_dir, STAGE_ROWS))
    return runlog.run_progress(counters).select("run_id", "position", "stage", "total", "status")


@query(with_ctes(f"stage_rows as ({STAGE_ROWS})", """
select run_id,
 count(*) filter (where stage = 'email_validation' and outcome = 'ok') as emails_validated,
 count(*) filter (where stage = 'email_validation' and outcome = 'skipped') as emails_skipped,
 count(*) filter (where stage = 'llm_extraction' and outcome = 'ok') as prospects_enriched,
 count(*) filter (where outcome = 'failed') as errors
from stage_rows group by run_id
"""), name="run_totals")
def totals_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.run_totals(derived(spark, sf_dir, STAGE_ROWS))


@query(with_ctes(f"stage_rows as ({STAGE_ROWS})", f"""
select run_id, stage, strftime(ts, {_TIME}) as ts, message
from stage_rows where outcome = 'failed'
"""), name="run_errors")
def errors_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = runlog.run_errors(derived(spark, sf_dir, STAGE_ROWS))
    return errors.withColumn("ts", time_text("ts"))


@query(with_ctes(f"stage_rows as ({STAGE_ROWS})", f"""
select run_id, strftime(ts, {_TIME}) as ts, message from stage_rows where outcome = 'failed'
qualify row_number() over (partition by run_id order by ts, message) <= 100
"""))
def errors_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = runlog.run_errors(derived(spark, sf_dir, STAGE_ROWS))
    return runlog.shown_errors(errors, "run_id", ["ts", "message"]).select(
        "run_id", time_text("ts").alias("ts"), "message"
    )


@query(with_ctes(f"runs as ({RUNS})", f"""
select id, status, strftime(coalesce(completed_at, started_at), {_TIME}) as last_run_at
from runs order by id desc limit 1
"""), name="latest_run")
def last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.latest_run(derived(spark, sf_dir, RUNS)).select(
        "id", "status", time_text("last_run_at").alias("last_run_at")
    )


@query(with_ctes(f"runs as ({RUNS})", """
select id, run_type, status, total_records from runs order by id desc limit 50
"""), name="recent_runs")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.recent_runs(derived(spark, sf_dir, RUNS)).select(
        "id", "run_type", "status", "total_records"
    )


# --- log lines -----------------------------------------------------------------------------------
# Log lines as a file may hold them: good ones, blank ones, cut ones and values that are no object.
_LOG_LINES = f"""
select case event_id % 9 when 4 then '   ' when 7 then '{{"event": "cut' when 8 then '"text"'
 else concat(' {{"run_id": ', cast(run_id as string), ', "event": "', event, '", "stage": "', stage,
  '", "email": "', email, '", "request": ', request, '}} ') end as value
from ({RUN_LOG}) as run_log
"""


@query(with_ctes(f"run_log as ({RUN_LOG})", """
select run_id, event, stage, email from run_log
where event_id % 9 not in (4, 7, 8) and run_id = 3 and stage = 'web_search'
"""))
def run_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stage of one run, broken lines dropped (the filter is the feature)."""
    log = runlog.parse_log_lines(derived(spark, sf_dir, _LOG_LINES, ("events",)))
    return runlog.filter_log(log, run_id=3, stage="web_search").select(
        "run_id", "event", "stage", "email"
    )


@query(with_ctes(f"run_log as ({RUN_LOG})", """
select run_id, count(*) as total_entries from run_log where event_id % 9 not in (4, 7, 8)
group by run_id
"""))
def run_log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.total_entries(
        runlog.parse_log_lines(derived(spark, sf_dir, _LOG_LINES, ("events",)))
    )


@query(with_ctes(f"run_log as ({RUN_LOG})", """
select event_id, concat('{"api_key":"***REDACTED***","value":', event_id % 100,
 ',"Authorization": "***REDACTED***","note":"token free"}') as request
from run_log
"""))
def redact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(spark, sf_dir).select("event_id", mask_scalars("request").alias("request"))


# How deep some values are nested: deeper than a parser that calls itself can go.
_DEEP = 20_000


@query(with_ctes(f"run_log as ({RUN_LOG})", f"""
, masked as (
 select event_id, request, concat('{{"api_key": "***REDACTED***", "value": ', event_id % 100,
  ', "Authorization": "***REDACTED***", "note": "token free"}}') as shown
 from run_log
)
select event_id, case when event_id % 500 = 7
  then concat(repeat('[', {_DEEP}), shown, repeat(']', {_DEEP}))
 when event_id % 500 = 8 then concat(repeat('{{"a": ', {_DEEP}), '{{"token": "***REDACTED***"}}',
  repeat('}}', {_DEEP}))
 when event_id % 500 = 9 then concat(repeat('[', {_DEEP}), request)
 when event_id % 500 = 10 then concat('{{"outer": ', event_id, ', "token": "***REDACTED***"}}')
 else concat('{{"outer": [', shown, '], "Token": "***REDACTED***"}}') end as request
from masked
"""))
def redact_log_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested values: whole lists and objects under a secret key are masked too, at any depth; the
    last of repeated keys counts, and text that is no JSON is passed on."""
    request, part = F.col("request"), F.col("event_id") % 500
    opened = F.repeat(F.lit("["), _DEEP)
    nested = (
        F.when(part == 7, F.concat(opened, request, F.repeat(F.lit("]"), _DEEP)))
        .when(part == 8, F.concat(
            F.repeat(F.lit('{"a":'), _DEEP), F.lit('{"token":['), request, F.lit("]}"),
            F.repeat(F.lit("}"), _DEEP),
        ))
        .when(part == 9, F.concat(opened, request))
        .when(part == 10, F.concat(
            F.lit('{"outer": 1, "token": '), request, F.lit(', "outer": '), "event_id",
            F.lit(', "token": [1, 2]}'),
        ))
        .otherwise(F.concat(
            F.lit('{"outer": ['), request, F.lit('], "Token": '), request, F.lit("}")
        ))
    )
    # the texts are far larger than the rows they are made from: these are spread over all tasks first
    rows = run_log(spark, sf_dir).repartition("event_id").select(
        "event_id", nested.alias("request")
    )
    return runlog.mask_json_column(rows, "request")


@query(with_ctes(f"run_log as ({RUN_LOG})", """
select event_id, run_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') as ts, event, stage, email,
 '***REDACTED***' as token, '***REDACTED***' as list_of_secrets, '***REDACTED***' as nested_secret,
 'n' || event_id as note, '***REDACTED***' as header_secret, stage as header_plain,
 '***REDACTED***' as second_secret, event_id % 10 as second_value
from run_log
"""))
def runlog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON lines, one folder per run, and read back."""
    events = run_log(spark, sf_dir).select(
        iso_utc("ts").alias("ts"), "run_id", "event", "stage", "email", "event_id",
        F.concat(F.lit("t"), "event_id").alias("token"),
        F.struct(
            F.array("email", F.lit("s")).alias("Token"),
            F.struct(
                F.struct(F.col("event_id").alias("deep")).alias("API_KEY"),
                F.concat(F.lit("n"), "event_id").alias("note"),
            ).alias("inner"),
            F.create_map(F.lit("Authorization"), F.lit("b"), F.lit("x"), F.col("stage"))
            .alias("headers"),
            F.array(
                F.struct(F.lit("p").alias("api_key"), F.lit(0).alias("value")),
                F.struct(F.lit("q").alias("api_key"), (F.col("event_id") % 10).cast("int")
                         .alias("value")),
            ).alias("calls"),
        ).alias("detail"),
    )
    folder = shared_folder(spark, "runlog")
    append_run_log(events, folder)
    entry = F.try_parse_json("line")
    return read_run_log(spark, folder).select(
        F.try_variant_get(entry, "$.event_id", "bigint").alias("event_id"), "run_id", "ts", "event",
        "stage", "email", F.try_variant_get(entry, "$.token", "string").alias("token"),
        *(F.try_variant_get(entry, f"$.detail.{path}", kind).alias(name) for name, path, kind in (
            ("list_of_secrets", "Token", "string"), ("nested_secret", "inner.API_KEY", "string"),
            ("note", "inner.note", "string"), ("header_secret", "headers.Authorization", "string"),
            ("header_plain", "headers.x", "string"), ("second_secret", "calls[1].api_key", "string"),
            ("second_value", "calls[1].value", "bigint"),
        )),
    )


# --- throttle ------------------------------------------------------------------------------------
@query(f"""
select event_id, user_id, count(*) over (partition by user_id order by epoch_us(ts)
 range between {_DAY * 1_000_000} preceding and current row) as hits
from events
""", name="hits_in_window")
def hits_of_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return hits_in_window(events, "user_id", "ts", _DAY).select("event_id", "user_id", "hits")


def _admission_sql(key: str, max_hits: int, window_seconds: int) -> str:
    """The rule hit by hit: a recursive step per place of a hit in its key's sequence."""
    micros = window_seconds * 1_000_000
    live = f"list_filter(r.kept, lambda x: x >= e.us - {micros})"
    return f"""
with recursive e as (
 select event_id, {key} as key, epoch_us(ts) as us,
  row_number() over (partition by {key} order by ts, event_id) as place
 from events
),
r as (
 select event_id, key, place, true as admitted, [us] as kept from e where place = 1
 union all
 select e.event_id, e.key, e.place, len({live}) < {max_hits},
  case when len({live}) < {max_hits} then list_append({live}, e.us) else {live} end
 from r join e on e.key = r.key and e.place = r.place + 1
)
select event_id, key, admitted from r
"""


@query(_admission_sql("user_id", 2, _DAY))
def throttle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two hits per user and day."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return admit_hits(events, "user_id", "ts", "event_id", 2, _DAY).select(
        "event_id", F.col("user_id").alias("key"), "admitted"
    )


@query("""
select event_id, event_type as key, hits, hits > 5 as over
from (
 select event_id, event_type, count(*) over (partition by event_type order by epoch_us(ts)
  range between 3600000000 preceding and current row) as hits
 from events
)
""")
def throttle_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the last hour per event type, where every key is busy all the time, against a rate
    as settings state it; keys are cut into time cells, so no task gets all hits of one."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    max_hits, seconds = parse_rate(" 5 / Hour")
    return hits_in_window(events, "event_type", "ts", seconds).select(
        "event_id", F.col("event_type").alias("key"), "hits", (F.col("hits") > max_hits).alias("over")
    )


# --- files and streams ---------------------------------------------------------------------------
# Headers of the three files the contact rows are written to, one dialect each.
_DIALECTS = {
    "a.csv": ("Full Name", "First Name", "Last Name", "Email Address", "Mobile Number", "Country",
              "Company", "City", "State", "PIN Code", "Website"),
    "b.csv": ("Contact", "first_name", "last_name", "EmailID", "WhatsApp", "Nation", "Firm Name",
              "Town", "Province", "Zip", "URL"),
    "c.csv": ("fullname", "FIRST NAME", "LAST NAME", "Work Email", "tel", "countrycode",
              "businessname", "city", "region", "postcode", "homepage"),
}


def _write_dialects(spark: SparkSession, sf_dir: str) -> str:
    """Each file of the raw contacts as a folder of CSV parts in row order, in its own dialect."""
    folder = shared_folder(spark, "uploads")
    raw = raw_leads(spark, sf_dir)
    for name, headers in _DIALECTS.items():
        rows = raw.where(F.col("source_file") == name)
        ordered = rows.repartitionByRange("row_id").sortWithinPartitions("row_id")
        ordered.select(
            *[F.col(c).alias(h) for c, h in zip(HEADERS, headers)],
            F.col("row_id").alias("Row Id"),
        ).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    return folder


@query(with_ctes(LEADS_CLEAN, f"""
select email, name, phone, company_name, country, website_csv, {QUALITY} as data_quality_score,
 'Row Id=' || row_id as raw_data
from leads_clean
"""))
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact files in three header dialects, read back, mapped, cleaned and deduplicated."""
    rows, _ = read_csv_files(spark, _write_dialects(spark, sf_dir))
    return new_leads(clean_leads(rows), ROW_ORDER).select(
        "email", "name", "phone", "company_name", "country", "website_csv", "data_quality_score",
        entries_text("raw_data").alias("raw_data"),
    )


@query(with_ctes(LEADS_CLEAN, """
select split_part(source_file, '.', 1) as upload, count(*) as total_records,
 count(*) filter (where email is not null and place = 1) as new_records,
 count(*) filter (where email is not null and place > 1) as duplicate_records,
 count(*) filter (where email is null) as skipped_records
from (
 select *, row_number() over (partition by email order by source_file, row_id) as place
 from lead_rows
) group by source_file
"""))
def ingest_files_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = read_csv_files(spark, _write_dialects(spark, sf_dir))
    upload = F.regexp_extract("file_path", r"/([abc])\.csv/", 1)
    cleaned = clean_leads(rows).withColumn("upload", upload)
    return ingest_outcome(cleaned, ROW_ORDER, file="upload").withColumnRenamed(
        "filename", "upload"
    )


@query(with_ctes(LEADS_CLEAN, """
select 'lead' as kind, email, name, phone, row_id, null::bigint as total_records,
 null::varchar as reason
from leads_clean
union all
select 'upload', split_part(source_file, '.', 1), null, null, null, count(*), null
from lead_rows group by source_file
union all select 'reject', 'bad', null, null, null, null, 'no email column' from lead_rows
 having count(*) > 0
"""))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact rows written as files of three dialects beside one without e-mail, ingested by a
    stream that runs until all files are taken; the stored leads are the same as in batch."""
    incoming = _write_dialects(spark, sf_dir)
    raw_leads(spark, sf_dir).select("full_name", "phone").repartition(1).write.option(
        "header", True
    ).csv(f"{incoming}/bad.csv")
    folder = shared_folder(spark, "stream")
    upload = F.regexp_extract("file_path", r"/(\w+)\.csv/[^/]*$", 1)

    def cleaned(rows: DataFrame) -> DataFrame:
        row_id = F.element_at("raw_data", "Row Id").cast("bigint")
        return clean_leads(rows).withColumns({"upload": upload, "row_id": row_id})

    run_to_end(stream_leads(
        upload_stream(spark, incoming), f"{folder}/leads",
        f"{folder}/uploads", f"{folder}/rows", f"{folder}/rejects", f"{folder}/checkpoint",
        prepare=cleaned, order=["upload", "row_id"], file="upload",
    ))
    nothing = F.lit(None)

    def part(table_name: str, kind: str, **columns) -> DataFrame:
        shown = {
            "email": nothing, "name": nothing, "phone": nothing, "row_id": nothing,
            "total_records": nothing, "reason": nothing, **columns,
        }
        types = {"row_id": "bigint", "total_records": "bigint"}
        return spark.read.parquet(f"{folder}/{table_name}").select(
            F.lit(kind).alias("kind"),
            *(c.cast(types.get(n, "string")).alias(n) for n, c in shown.items()),
        )

    return (
        part("leads", "lead", **{n: F.col(n) for n in ("email", "name", "phone", "row_id")})
        .unionByName(part("uploads", "upload", email=F.col("filename"),
                          total_records=F.col("total_records")))
        .unionByName(part("rejects", "reject", email=upload, reason=F.col("reason")).distinct())
    )
