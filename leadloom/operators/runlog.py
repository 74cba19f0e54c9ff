"""Run logs and run counters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.constants import (
    INGEST_ERRORS_SHOWN,
    RUN_LOG_SECRET_KEYS,
    STAGES,
)
from leadloom.functions.redact import mask_text
from leadloom.functions.text import percent, strip

CORE_FIELDS = ("ts", "run_id", "event", "stage", "email")


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to `ts, run_id, event, stage, email, line`; blank and broken lines are dropped.

    The core fields are typed; the whole line is kept, so any other field stays reachable.
    """
    entry = F.try_parse_json("line")
    return (
        lines.select(strip(value).alias("line"))
        .where((F.col("line") != "") & F.schema_of_variant(entry).startswith("OBJECT"))
        .select(
            F.try_variant_get(entry, "$.ts", "string").alias("ts"),
            F.try_variant_get(entry, "$.run_id", "bigint").alias("run_id"),
            *[
                F.try_variant_get(entry, f"$.{f}", "string").alias(f)
                for f in ("event", "stage", "email")
            ],
            "line",
        )
    )


def filter_log(
    log: DataFrame, run_id: int | None = None, stage: str | None = None, email: str | None = None
) -> DataFrame:
    """Entries of a run, optionally of one stage or one address."""
    for name, value in (("run_id", run_id), ("stage", stage), ("email", email)):
        if value not in (None, ""):
            log = log.where(F.col(name) == value)
    return log


def total_entries(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.count("*").alias("total_entries"))


def mask_json_column(
    df: DataFrame, column: str, keys: tuple[str, ...] = RUN_LOG_SECRET_KEYS
) -> DataFrame:
    """Mask secret values at any depth of a JSON text column, in Arrow batches."""
    position = df.columns.index(column)
    secret = frozenset(keys)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = [mask_text(t, secret) for t in batch.column(position).to_pylist()]
            yield batch.set_column(position, column, pa.array(masked, pa.string()))

    return df.mapInArrow(mask, df.schema)


def log_rollup(log: DataFrame) -> DataFrame:
    """Per run and stage: events, errors, first start, last end and the seconds between."""
    start = F.when(F.col("event") == "stage_start", F.col("ts"))
    end = F.when(F.col("event") == "stage_end", F.col("ts"))
    return log.groupBy("run_id", "stage").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("event") == "error").alias("errors"),
        F.min(start).alias("started_at"),
        F.max(end).alias("ended_at"),
    ).withColumn(
        "span_seconds",
        F.unix_seconds(F.col("ended_at").cast("timestamp"))
        - F.unix_seconds(F.col("started_at").cast("timestamp")),
    )


def stage_counters(rows: DataFrame) -> DataFrame:
    """Per run and stage, from rows `run_id, stage, outcome` (`ok`, `skipped`, `failed`, other):
    total, processed, ok, skipped and processed share."""
    outcome = F.col("outcome")
    processed = F.count_if(outcome != "failed")
    return rows.groupBy("run_id", "stage").agg(
        F.count("*").alias("total"),
        processed.alias("processed"),
        F.count_if(outcome == "ok").alias("ok"),
        F.count_if(outcome == "skipped").alias("skipped"),
        percent(processed, F.count("*")).alias("pct"),
    )


def run_progress(counters: DataFrame) -> DataFrame:
    """One row per run and stage, in stage order: counters of the stages that have run, `pending`
    for the others."""
    runs = counters.select("run_id").distinct()
    stages = F.posexplode(F.array(*[F.lit(s) for s in STAGES])).alias("position", "stage")
    status = F.when(F.col("total").isNull(), "pending").when(
        F.col("processed") < F.col("total"), "running"
    )
    return runs.select("run_id", stages).join(counters, ["run_id", "stage"], "left").withColumn(
        "status", status.otherwise("completed")
    )


def run_totals(rows: DataFrame, leads: DataFrame | None = None) -> DataFrame:
    """Per run: validated and skipped addresses, enriched leads, errors; with `leads` also the size
    of the lead table."""
    stage, outcome = F.col("stage"), F.col("outcome")
    checked = stage == "email_validation"
    totals = rows.groupBy("run_id").agg(
        F.count_if(checked & (outcome == "ok")).alias("emails_validated"),
        F.count_if(checked & (outcome == "skipped")).alias("emails_skipped"),
        F.count_if((stage == "llm_extraction") & (outcome == "ok")).alias("prospects_enriched"),
        F.count_if(outcome == "failed").alias("errors"),
    )
    if leads is None:
        return totals
    return totals.withColumn("total_records", leads.agg(F.count("*")).scalar())


def run_errors(rows: DataFrame) -> DataFrame:
    """One row per error, whole messages; a table instead of a list, since a run may fail often."""
    return rows.where(F.col("outcome") == "failed").select("run_id", "stage", "ts", "message")


def shown_errors(
    errors: DataFrame, group: str, order: list[str], n: int = INGEST_ERRORS_SHOWN
) -> DataFrame:
    """The first `n` errors per group for a response; the limit is the feature."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return errors.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the highest id and its time: end if it has one, else start."""
    last = runs.agg(F.max_by(F.struct(*runs.columns), "id").alias("r"))
    return last.select("r.*").withColumn(
        "last_run_at", F.coalesce("completed_at", "started_at")
    )


def recent_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)
