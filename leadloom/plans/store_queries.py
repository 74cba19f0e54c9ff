"""Stored tables and streams: appended rows, upload history, full detail, page bodies, first arrivals,
progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.constants import DETAIL_COLUMNS
from leadloom.functions.markup import decode_body
from leadloom.operators.ingest import history_rows, ingest_outcome, latest_uploads
from leadloom.operators.upsert import add_missing_columns
from leadloom.plans.inputs import AS_OF, table
from leadloom.plans.lead_queries import as_of, export_ready
from leadloom.plans.leads import ORDER, clean_table, lead_rows, raw_leads
from leadloom.plans.registry import entries_text, query, time_text
from leadloom.plans.sql import GEO, LEAD_ROWS, LEADS_CLEAN, QUALITY, with_ctes
from leadloom.session import shared_folder
from leadloom.sources.tables import LEAD_COLUMNS, append_rows, read_table
from leadloom.streaming.ingest import (
    first_in_order,
    run_to_end,
    stream_leads,
    upload_stream,
)


@query(with_ctes(LEADS_CLEAN, """
select email, name, source_file, case when source_file = 'b.csv' then row_id end as late_id
from leads_clean
"""))
def append_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three appends to one table, the second with a column that the first rows do not have."""
    folder = shared_folder(spark, "appended")
    leads = clean_table(spark, sf_dir).select("email", "name", "source_file", "row_id")
    for source in ("a.csv", "b.csv", "c.csv"):
        part = leads.where(F.col("source_file") == source)
        if source == "b.csv":
            part = part.withColumn("late_id", F.col("row_id"))
        append_rows(part.drop("row_id"), folder)
    return read_table(spark, folder, {"late_id": "bigint"}).select(
        "email", "name", "source_file", "late_id"
    )


@query(with_ctes(LEAD_ROWS, f"""
select source_file as filename, count(*) as total_records,
 count(*) filter (where email is null) as skipped_records,
 strftime({AS_OF}, '%Y-%m-%d %H:%M:%S') as uploaded_at, 'operator' as uploaded_by
from lead_rows group by source_file
"""))
def upload_history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest adds to the upload history, written and read back, newest first."""
    folder = shared_folder(spark, "history")
    rows = lead_rows(spark, sf_dir).select("row_id", "source_file", "email")
    outcome = ingest_outcome(rows, ORDER)
    ids = rows.groupBy(F.col("source_file").alias("filename")).agg(F.min("row_id").alias("id"))
    append_rows(history_rows(outcome, as_of(), "operator").join(ids, "filename"), folder)
    return latest_uploads(read_table(spark, folder)).select(
        "filename", "total_records", "skipped_records", time_text("uploaded_at").alias("uploaded_at"),
        "uploaded_by",
    )


_TIMES = ("created_at", "email_validated_at", "enriched_at", "updated_at")
_DETAIL_SQL = {
    **{c: f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}" for c in _TIMES},
    "updated_at": "null::varchar as updated_at", "raw_data": "'' as raw_data",
    "data_quality_score": f"{QUALITY} as data_quality_score",
    "detected_country_code": "country_code as detected_country_code",
    "country": "coalesce(country_csv, country) as country",
}
_NOT_STORED = (
    "address", "notes", "fax", "company_website", "company_linkedin", "person_linkedin",
    "company_description", "sub_category", "company_size", "enrichment_raw", "is_duplicate",
    "duplicate_of", "industry_confidence",
)


@query(with_ctes(GEO, "select " + ", ".join(
    _DETAIL_SQL.get(c, f"null::varchar as {c}" if c in _NOT_STORED else c) for c in DETAIL_COLUMNS
) + " from profiled"))
def lead_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the detail view, for every lead."""
    leads = add_missing_columns(export_ready(spark, sf_dir), LEAD_COLUMNS)
    shown = {c: time_text(c) for c in _TIMES}
    shown["raw_data"] = F.coalesce(entries_text("raw_data"), F.lit(""))
    return leads.select(*[
        shown.get(c, F.col(c).cast("string") if c in _NOT_STORED else F.col(c)).alias(c)
        for c in DETAIL_COLUMNS
    ])


@query("""
select page_id, concat(html, '�', '(', 'é', '�') as body, length(html) + 4 as chars,
 left(html, 40) as start
from pages
""")
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes as a fetch gives them, broken sequences among them; with a byte cap where asked for."""
    broken = F.concat(
        F.encode("html", "UTF-8"), F.unhex(F.lit("C328")), F.encode(F.lit("é"), "UTF-8"),
        F.unhex(F.lit("FF")),
    )
    pages = table(spark, sf_dir, "pages").withColumn("content", broken)
    start = F.substring(decode_body("content", max_bytes=160), 1, 40)
    return pages.select(
        "page_id", decode_body("content").alias("body"),
        F.length(decode_body("content")).cast("bigint").alias("chars"), start.alias("start"),
    )


@query("""
with early as (
 select user_id, event_id from events where event_id % 3 = 0
 qualify row_number() over (partition by user_id order by ts, event_id) = 1
),
every as (
 select user_id, event_id from events
 qualify row_number() over (partition by user_id order by ts, event_id) = 1
)
select every.user_id, coalesce(early.event_id, every.event_id) as event_id
from every left join early using (user_id)
""")
def stream_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of every user over a stream in two runs: a third of the events, then all of
    them again, so rows are repeated and earlier ones come late; who came first stays first."""
    folder = shared_folder(spark, "arrivals")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    for part in (events.where(F.col("event_id") % 3 == 0), events):
        append_rows(part, f"{folder}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
        firsts = first_in_order(stream, "user_id", ["ts", "event_id"])
        run_to_end(
            firsts.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start(f"{folder}/out")
        )
    return spark.read.schema(events.schema).parquet(f"{folder}/out").select("user_id", "event_id")


@query(with_ctes(LEADS_CLEAN, """
select count(*) as new_records, (select count(*) from lead_rows) as rows_read from leads_clean
"""))
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that a stream reports batch by batch, a few files each, added up."""
    folder = shared_folder(spark, "progress")
    raw_leads(spark, sf_dir).repartition(4, "row_id").select(
        F.col("email").alias("Email"), F.col("full_name").alias("Name")
    ).write.option("header", True).option("escape", '"').csv(f"{folder}/in")
    seen: dict[int, int] = {}  # a number per batch
    run_to_end(stream_leads(
        upload_stream(spark, f"{folder}/in", files_per_batch=2), f"{folder}/leads",
        f"{folder}/uploads", f"{folder}/rows", f"{folder}/rejects", f"{folder}/checkpoint",
        on_batch=lambda number, counters: seen.__setitem__(number, counters["new_records"]),
    ))
    read = spark.read.parquet(f"{folder}/uploads").agg(F.sum("total_records").alias("rows_read"))
    return read.select(F.lit(sum(seen.values())).cast("bigint").alias("new_records"), "rows_read")
