"""Sliding-window admission of hits per key.

A hit is admitted while fewer than `max_hits` admitted hits lie in the last `window_seconds`
(a hit exactly that old still counts); rejected hits leave no trace.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Length of a time cell of `hits_in_window`, in windows.
_CELL_WINDOWS = 16


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _cell(length: int) -> Column:
    return ((F.col("_us") - F.pmod("_us", F.lit(length))) / length).cast("long")


def hits_in_window(
    df: DataFrame, key: str, ts: str, window_seconds: int, output: str = "hits"
) -> DataFrame:
    """Hits of the same key in the last `window_seconds`, the hit itself included.

    Rows are partitioned by key and time cell; hits near the end of a cell also go to the next cell
    as context, so a busy key is spread over its cells.
    """
    width = window_seconds * 1_000_000
    length = width * _CELL_WINDOWS

    def place(cell: Column, own: bool) -> Column:
        return F.struct(cell.alias("cell"), F.lit(own).alias("own"))

    own, carried = place(F.col("_c"), True), place(F.col("_c") + 1, False)
    near_end = F.col("_us") >= (F.col("_c") + 1) * length - width
    placed = (
        df.withColumn("_us", _micros(ts))
        .withColumn("_c", _cell(length))
        .withColumn(
            "_place", F.explode(F.when(near_end, F.array(own, carried)).otherwise(F.array(own)))
        )
        .select("*", F.col("_place.cell").alias("_in"), F.col("_place.own").alias("_own"))
    )
    frame = Window.partitionBy(key, "_in").orderBy("_us").rangeBetween(-width, 0)
    return (
        placed.withColumn(output, F.count("*").over(frame))
        .where("_own")
        .select(*df.columns, output)
    )


def admit_hits(
    df: DataFrame, key: str, ts: str, tie_break: str, max_hits: int, window_seconds: int,
    output: str = "admitted",
) -> DataFrame:
    """Add the admission decision to every hit; hits are taken in `(ts, tie_break)` order, so both
    must be there and `tie_break` unique.  Hits without a key share one.

    Time is cut into cells as long as the window, and most decisions need counting only:

    * a cell is quiet when it and the cell before it hold no more than `max_hits` hits together;
      all its hits are admitted whatever happened before;
    * of the hits of one key at one instant, only the first `max_hits` can be admitted.

    What is left are runs of busy cells.  Each run starts from the hits of the quiet cell before it,
    so runs are independent and a busy key is spread over its runs.  Within a run every decision
    depends on the ones before; a run is read in order from a sorted partition, with at most
    `max_hits` times as state, and is never held in memory.
    """
    width = window_seconds * 1_000_000
    hits = df.withColumns({
        "_key": F.coalesce(F.col(key).cast("string"), F.lit("unknown")),
        "_us": _micros(ts),
    }).withColumn("_cell", _cell(width))
    cells = _busy_runs(hits, max_hits)
    same_instant = Window.partitionBy("_key", "_cell", "_us").orderBy(tie_break)
    placed = hits.join(cells, ["_key", "_cell"]).withColumn(
        output,
        F.when(~F.col("_busy"), True)
        .when(F.row_number().over(same_instant) > max_hits, False),
    )
    known = placed.where(F.col(output).isNotNull()).select(*df.columns, output)
    sequence = (
        placed.where(
            F.col("_run").isNotNull() & F.coalesce(F.col(output), F.lit(True))
        )
        .select(*df.columns, "_key", "_run", "_us", "_busy")
        .repartition(F.col("_key"), F.col("_run"))
        .sortWithinPartitions("_key", "_run", "_us", tie_break)
    )
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields
    )
    decided = sequence.mapInArrow(
        _decider(len(df.columns), output, max_hits, width), f"{schema}, `{output}` boolean"
    )
    return known.unionByName(decided)


def _busy_runs(hits: DataFrame, max_hits: int) -> DataFrame:
    """`_key, _cell, _busy, _run` per cell; the windows run over counted cells, not over hits.

    `_run` is the first cell of the run a busy cell belongs to; a quiet cell right before a run
    carries that run's number too, as its starting state.
    """
    by_key = Window.partitionBy("_key").orderBy("_cell")

    def neighbour(column: str, step: int) -> Column:
        """Value of the adjacent cell, null when that cell holds no hits."""
        shift = F.lag if step < 0 else F.lead
        adjacent = shift("_cell").over(by_key) == F.col("_cell") + step
        return F.when(adjacent, shift(column).over(by_key))

    busy = F.coalesce(neighbour("_n", -1), F.lit(0)) + F.col("_n") > max_hits
    starts = F.col("_busy") & ~F.coalesce(neighbour("_busy", -1), F.lit(False))
    run_start = F.last(F.when(F.col("_starts"), F.col("_cell")), ignorenulls=True).over(by_key)
    return (
        hits.groupBy("_key", "_cell")
        .agg(F.count("*").alias("_n"))
        .withColumn("_busy", busy)
        .withColumn("_starts", starts)
        .withColumn(
            "_run",
            F.when(F.col("_busy"), run_start).when(
                F.coalesce(neighbour("_busy", 1), F.lit(False)), F.col("_cell") + 1
            ),
        )
        .select("_key", "_cell", "_busy", "_run")
    )


def admit_sorted(times: np.ndarray, admitted: deque, max_hits: int, width: int) -> np.ndarray:
    """Decisions for sorted times, given and updating the last admitted times.

    The loop runs over admitted hits only: a full window is skipped in one search.
    """
    decisions = np.zeros(len(times), dtype=bool)
    i = 0
    while i < len(times):
        if len(admitted) == max_hits:
            i = max(i, int(np.searchsorted(times, admitted[0] + width, side="right")))
            if i >= len(times):
                break
            admitted.popleft()
        decisions[i] = True
        admitted.append(int(times[i]))
        i += 1
    return decisions


def _decider(n_columns: int, output: str, max_hits: int, width: int):
    """Reads batches sorted by key, run and time; the state goes on from batch to batch."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, admitted = None, deque()
        for batch in batches:
            keys = batch.column(n_columns).to_numpy(zero_copy_only=False)
            runs = batch.column(n_columns + 1).to_numpy(zero_copy_only=False)
            times = batch.column(n_columns + 2).to_numpy(zero_copy_only=False)
            changes = np.flatnonzero((keys[1:] != keys[:-1]) | (runs[1:] != runs[:-1])) + 1
            edges = [0, *changes.tolist(), len(keys)] if len(keys) else []
            parts = []
            for start, end in zip(edges, edges[1:]):
                run = (keys[start], runs[start])
                if run != current:
                    current, admitted = run, deque()
                parts.append(admit_sorted(times[start:end], admitted, max_hits, width))
            if parts:
                decided = batch.select(range(n_columns)).append_column(
                    output, pa.array(np.concatenate(parts))
                )
                yield decided.filter(batch.column(n_columns + 3))

    return decide
