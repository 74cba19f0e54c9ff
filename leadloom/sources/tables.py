"""Stored tables: scan, append, snapshot, export."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.constants import EXPORT_COLUMNS
from leadloom.operators.upsert import add_missing_columns

# Buckets of the lead table: set once for a table, by the size that it is going to have.
BUCKETS = 16
# Columns of the lead table and their types, in order.
LEAD_COLUMNS = {
    "id": "bigint", "name": "string", "email": "string", "phone": "string",
    "company_name": "string", "address": "string", "city": "string", "state": "string",
    "pincode": "string", "country": "string", "website_csv": "string", "notes": "string",
    "fax": "string", "source_file": "string", "raw_data": "map<string,string>",
    "data_quality_score": "double", "email_status": "string", "email_sub_status": "string",
    "email_activity": "string", "email_activity_score": "double",
    "email_validated_at": "timestamp", "detected_country_code": "string",
    "search_locale": "string", "company_website": "string", "company_linkedin": "string",
    "person_linkedin": "string", "company_description": "string", "industry": "string",
    "industry_confidence": "double", "sub_category": "string", "company_size": "string",
    "relevance_score": "double", "enrichment_raw": "string", "enriched_at": "timestamp",
    "is_duplicate": "boolean", "duplicate_of": "string", "created_at": "timestamp",
    "updated_at": "timestamp",
}


def read_table(
    spark: SparkSession, path: str, columns: dict[str, str] | None = None
) -> DataFrame:
    """A Parquet table; columns that older snapshots lack come back as null."""
    table = spark.read.option("mergeSchema", "true").parquet(path)
    return add_missing_columns(table, columns) if columns else table


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A new version of a table in a new folder; readers switch when it is complete."""
    df.write.mode("errorifexists").parquet(path)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A new version of a table in a new folder, dealt to `buckets` files by the key once and for all:
    joins on the key then leave its rows where they are."""
    spark, name = df.sparkSession, f"leadloom_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    dealt.option("path", path).mode("errorifexists").saveAsTable(name)
    spark.sql(f"drop table {name}")  # its files stay, they lie in a folder of their own


def read_bucketed(
    spark: SparkSession, path: str, key: str, buckets: int, columns: dict[str, str] | None = None
) -> DataFrame:
    """The rows that `write_bucketed` wrote with the same key and number of buckets."""
    name = f"leadloom_{uuid.uuid4().hex}"
    fields = spark.read.parquet(path).schema
    spark.sql(
        f"create table {name} ({fields.toDDL()}) using parquet clustered by (`{key}`) "
        f"sorted by (`{key}`) into {int(buckets)} buckets location '{path}'"
    )
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the plan knows the files and their buckets by now
    return add_missing_columns(table, columns) if columns else table


def export_rows(df: DataFrame) -> DataFrame:
    """The export columns, newest first.  The key ends the sort order, so rows of one time stamp
    are still spread over the sort's range partitions."""
    return df.select(*EXPORT_COLUMNS).orderBy(F.desc("created_at"), "email")


def write_export(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV export.  A single file starts with a byte order mark; a large export is one file per
    partition, in order, without it."""
    rows = export_rows(df)
    if single_file:
        first = EXPORT_COLUMNS[0]
        rows = rows.coalesce(1).withColumnRenamed(first, "﻿" + first)
    rows.write.option("header", True).option("escape", '"').csv(path)
