"""Mailbox check results: selection of rows to check, status mapping, join back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.constants import MAILBOX_STATUS, STALE_AFTER_DAYS
from leadloom.functions.text import col, non_empty


def _status_lookup(c: Column, position: int) -> Column:
    pairs = [F.lit(x) for k, v in MAILBOX_STATUS.items() for x in (k, v[position])]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit("unknown"))


def mailbox_status(provider_status: Column | str) -> Column:
    """Provider status to the simplified one; anything else is `unknown`."""
    return _status_lookup(col(provider_status), 0)


def mailbox_activity(provider_status: Column | str) -> Column:
    return _status_lookup(col(provider_status), 1)


def stand_in_status(email: Column | str) -> dict[str, Column]:
    """Repeatable check result derived from the address itself, for runs without a provider:
    the sum of the code points modulo ten decides."""
    points = F.transform(F.split(col(email), ""), lambda ch: F.ascii(ch))
    digit = F.aggregate(points, F.lit(0), lambda a, b: a + b) % 10
    status = F.when(digit < 6, "valid").when(digit < 8, "catch-all").otherwise("invalid")
    return {
        "email_status": status,
        "email_sub_status": F.lit("mock_mode"),
        "email_activity": F.when(digit < 6, "active").when(digit < 8, "unknown")
        .otherwise("inactive"),
        "email_activity_score": F.when(digit < 6, F.round(0.7 + digit / 30, 2))
        .when(digit < 8, 0.5)
        .otherwise(0.0),
    }


def with_stand_in_status(df: DataFrame, as_of: datetime | Column) -> DataFrame:
    stamp = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return df.withColumns({**stand_in_status("email"), "email_validated_at": stamp})


def validation_columns(results: DataFrame) -> DataFrame:
    """Provider rows (`email, status, sub_status, activity_score`) as table columns."""
    return results.select(
        "email",
        mailbox_status("status").alias("email_status"),
        non_empty("sub_status").alias("email_sub_status"),
        mailbox_activity("status").alias("email_activity"),
        F.col("activity_score").cast("double").alias("email_activity_score"),
    )


def is_stale(as_of: Column, days: int = STALE_AFTER_DAYS) -> Column:
    """Never checked, or checked more than `days` ago.  The limit is a constant for the scan, so the
    test is pushed down to it."""
    checked = F.col("email_validated_at")
    return checked.isNull() | (checked < as_of - F.make_dt_interval(F.lit(days)))


def is_unprofiled() -> Column:
    return F.col("detected_country_code").isNull()


def is_unenriched() -> Column:
    return F.col("enriched_at").isNull()


def has_website() -> Column:
    return non_empty("website_csv").isNotNull()


def needs_validation(
    df: DataFrame, as_of: Column, run_type: str = "incremental", days: int = STALE_AFTER_DAYS
) -> DataFrame:
    """Rows to check; every row in a full run."""
    return df if run_type == "full" else df.where(is_stale(as_of, days))


def needs_profile(df: DataFrame, run_type: str = "incremental") -> DataFrame:
    return df if run_type == "full" else df.where(is_unprofiled())


def needs_enrichment(df: DataFrame, run_type: str = "incremental") -> DataFrame:
    return df if run_type == "full" else df.where(is_unenriched())


def repair_activity(df: DataFrame) -> DataFrame:
    """Correct `active` on rows whose status says otherwise."""
    wrong = F.col("email_activity") == "active"
    return df.withColumn(
        "email_activity",
        F.when(wrong & (F.col("email_status") == "invalid"), "inactive")
        .when(wrong & F.col("email_status").isin("unknown", "catch-all"), "unknown")
        .otherwise(F.col("email_activity")),
    )
