"""Run logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.redact import mask_nested, mask_scalars
from leadloom.operators.runlog import filter_log, parse_log_lines


def iso_utc(c: Column | str) -> Column:
    """ISO text of a time, microseconds and zone included (session zone UTC)."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def log_lines(events: DataFrame) -> DataFrame:
    """One JSON line per event, whole messages, nulls left out.  Secret columns and fields are masked
    whole at any depth, and so are plain values of secret keys in text that is JSON itself."""
    whole = mask_nested(F.struct("*"), events.schema)
    return events.select("run_id", mask_scalars(F.to_json(whole)).alias("value"))


def append_run_log(events: DataFrame, folder: str) -> None:
    """Append events (`ts, run_id, event`, any more columns), one folder per run."""
    log_lines(events).write.mode("append").partitionBy("run_id").text(folder)


def read_run_log(
    spark: SparkSession, folder: str, run_id: int | None = None, stage: str | None = None,
    email: str | None = None,
) -> DataFrame:
    """Entries of all files under `folder`; asking for one run lists only that run's folder."""
    lines = spark.read.text(folder)
    if run_id is not None and "run_id" in lines.columns:
        lines = lines.where(F.col("run_id") == run_id)
    return filter_log(parse_log_lines(lines.select("value")), run_id, stage, email)
