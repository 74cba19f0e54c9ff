"""Cleaning, dedup and bookkeeping of incoming contact rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.contacts import (
    clean_website,
    normalise_email,
    normalise_phone,
    quality_score,
)
from leadloom.operators.dedup import first_rows


def clean_leads(df: DataFrame, default_country_code: str = "91") -> DataFrame:
    """Normalise e-mail, phone and website of canonical rows and score their completeness.

    The rows come from `resolve_columns`: cells are stripped and blank ones are null.
    """
    cleaned = df.withColumns({
        "email": normalise_email("email", stripped=True),
        "phone": normalise_phone("phone", default_country_code),
        "website_csv": clean_website("website_csv", stripped=True),
    })
    return cleaned.withColumn("data_quality_score", quality_score(stripped=True))


def append_files(frames: list[DataFrame]) -> DataFrame:
    """Rows of files with differing headers, missing columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def new_leads(
    cleaned: DataFrame, order: list[str], stored: DataFrame | None = None, key: str = "email"
) -> DataFrame:
    """Rows to insert: the first row per e-mail whose e-mail is not stored yet."""
    incoming = first_rows(cleaned, key, order)
    return incoming if stored is None else incoming.join(stored.select(key), key, "left_anti")


def ingest_outcome(
    cleaned: DataFrame, order: list[str], stored: DataFrame | None = None, key: str = "email",
    file: str = "source_file",
) -> DataFrame:
    """Per file: total, new, duplicate and skipped rows (`total = new + duplicate + skipped`).

    The rows are read once and shrink to one per file and e-mail before the first shuffle; an e-mail
    counts as new in the file of its first row.  A hot e-mail is one row per file after that.
    """
    position = F.struct(*dict.fromkeys([*order, file]))
    counted = cleaned.groupBy(file, key).agg(
        F.count("*").alias("_n"), F.min(position).alias("_first")
    )
    if stored is None:
        counted = counted.withColumn("_known", F.lit(False))
    else:
        known = stored.select(key, F.lit(True).alias("_known"))
        counted = counted.join(known, key, "left")
    earliest = F.min("_first").over(Window.partitionBy(key))
    is_new = (
        F.col(key).isNotNull() & ~F.coalesce("_known", F.lit(False))
        & (F.col("_first") == earliest)
    )
    return (
        counted.withColumn("_new", is_new)
        .groupBy(F.col(file).alias("filename"))
        .agg(
            F.sum("_n").alias("total_records"),
            F.count_if("_new").alias("new_records"),
            F.sum(F.when(F.col(key).isNull(), F.col("_n")).otherwise(0)).alias("skipped_records"),
        )
        .select(
            "filename", "total_records", "new_records",
            (F.col("total_records") - F.col("new_records") - F.col("skipped_records"))
            .alias("duplicate_records"),
            "skipped_records",
        )
    )


def history_rows(outcome: DataFrame, as_of: Column, uploaded_by: str | None = None) -> DataFrame:
    """Rows to append to the upload history, one per file."""
    return outcome.withColumns({
        "uploaded_at": as_of, "uploaded_by": F.lit(uploaded_by).cast("string"),
    })


def latest_uploads(history: DataFrame, n: int = 100) -> DataFrame:
    """The newest uploads first."""
    return history.orderBy(F.desc("id")).limit(n)


def with_upload_id(results: DataFrame, history: DataFrame, file: str = "filename") -> DataFrame:
    """Attach the latest upload id of each file name; 0 when it has none."""
    ids = history.groupBy(file).agg(F.max("id").alias("upload_id"))
    return results.join(ids, file, "left").withColumn(
        "upload_id", F.coalesce("upload_id", F.lit(0))
    )
