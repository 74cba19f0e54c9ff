"""Files that arrive over time, ingested once each."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from leadloom.operators.ingest import clean_leads, ingest_outcome, new_leads
from leadloom.sources.files import ROW_ORDER, read_csv_files, readable_path

_FILE = "path string, modificationTime timestamp, length long, content binary"


def upload_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """`file_path` of every new file under `folder`, at most `files_per_batch` at a time; the files
    themselves are not read."""
    return (
        spark.readStream.format("binaryFile").schema(_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(F.col("_metadata.file_path").alias("file_path"))
    )


def stream_leads(
    files: DataFrame, leads: str, uploads: str, rows: str, rejects: str, checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = clean_leads, external: object = None,
    order: list[str] | None = None, file: str = "source_file",
    on_batch: Callable[[int, dict], None] | None = None,
) -> StreamingQuery:
    """Read the files of each batch of `upload_stream`, whatever dialect each is in, and append its
    cleaned rows to `rows`, what could not be read to `rejects`, the new leads to `leads` and the
    outcome per file to `uploads`.

    The files of a batch are read like an upload folder, so headers in any order, encodings and
    quoted line breaks are told apart by file; the table of their headers stands beside the
    checkpoint.  The rows are parsed and cleaned once and written; leads and outcome come from what
    was written.  Each batch writes into folders of its own, named by the batch number and
    overwritten when a batch is run again, and drops the e-mails of earlier batches, so a repeated
    batch changes nothing.  `on_batch` is told the batch number and its counters, which are
    observed while the rows are written.
    """
    spark = files.sparkSession
    order = order or ROW_ORDER

    def write(batch: DataFrame, number: int) -> None:
        # as many addresses as the stream hands out at a time
        paths = [readable_path(r.file_path) for r in batch.collect()]
        if not paths:
            return
        at = f"batch={number}"
        read, refused = read_csv_files(
            spark, paths, external, tables=f"{checkpoint}-headers/{at}", required=False
        )
        prepared = prepare(read)
        prepared.write.mode("overwrite").parquet(f"{rows}/{at}")
        refused.write.mode("overwrite").parquet(f"{rejects}/{at}")
        cleaned = spark.read.schema(prepared.schema).parquet(f"{rows}/{at}")
        stored = _earlier_batches(spark, leads, number)
        progress = Observation()
        fresh = new_leads(cleaned, order, stored).observe(
            progress,
            F.count(F.lit(1)).alias("new_records"),
            F.avg("data_quality_score").alias("data_quality_score"),
        )
        ingest_outcome(cleaned, order, stored, file=file).write.mode("overwrite").parquet(
            f"{uploads}/{at}"
        )
        fresh.write.mode("overwrite").parquet(f"{leads}/{at}")
        if on_batch:
            on_batch(number, progress.get)

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _earlier_batches(spark: SparkSession, leads: str, number: int) -> DataFrame | None:
    """E-mails written by batches before `number`."""
    if number == 0:
        return None
    return spark.read.parquet(leads).where(F.col("batch") < number).select("email")


def first_arrivals(rows: DataFrame, key: str = "email") -> DataFrame:
    """One row per key over the whole stream; the state grows with the number of keys."""
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key])


def first_arrivals_within(
    rows: DataFrame, time: str, delay: str, key: str = "email"
) -> DataFrame:
    """One row per key within the watermark delay; the state is bounded."""
    return (
        rows.where(F.col(key).isNotNull())
        .withWatermark(time, delay)
        .dropDuplicatesWithinWatermark([key])
    )


def first_in_order(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row per key over the whole stream: of the batch that brings a key first, the row that
    comes first by `order`; rows without a key are left out.

    What is kept of a key is a mark in the state store, so a batch looks up its own keys and reads
    nothing of the batches before it.
    """
    schema = rows.schema
    known = StructType([StructField("seen", BooleanType())])

    def step(group, frames, state):
        best = None
        for frame in frames:
            if not state.exists and len(frame):
                first = frame.sort_values(order, kind="stable").head(1)
                best = first if best is None else (
                    pd.concat([best, first]).sort_values(order, kind="stable").head(1)
                )
        if best is not None:
            state.update((True,))
            yield best

    return rows.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(
        step, schema, known, "append", GroupStateTimeout.NoTimeout
    )


class ProgressRows(StreamingQueryListener):
    """Keeps the row counts of finished batches for a progress display."""

    def __init__(self) -> None:
        self.batches: dict[int, int] = {}

    def onQueryStarted(self, event) -> None:
        self.batches.clear()

    def onQueryProgress(self, event) -> None:
        self.batches[event.progress.batchId] = event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an available-now query; a failure of the query is raised here."""
    query.awaitTermination()
