"""Sliding-window admission on a stream: the admitted times of a key are its state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadloom.operators.throttle import admit_sorted

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AdmissionProcessor(StatefulProcessor):
    """Admits at most `max_hits` hits per key and window.

    Hits of a key are taken in time order within a micro-batch.  A hit older than the newest
    admitted one came too late to be judged and is rejected as late.
    """

    def __init__(self, max_hits: int, window_seconds: int) -> None:
        self.max_hits = max_hits
        self.width = window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.admitted = handle.getListState("admitted", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        hits = pd.concat(rows).sort_values(["us", "id"], kind="stable")
        admitted = deque(us for (us,) in self.admitted.get())
        times = hits["us"].to_numpy()
        late = times < admitted[-1] if admitted else np.zeros(len(times), dtype=bool)
        decisions = np.zeros(len(times), dtype=bool)
        decisions[~late] = admit_sorted(times[~late], admitted, self.max_hits, self.width)
        if admitted:
            self.admitted.put([(us,) for us in admitted])
        yield pd.DataFrame({
            "key": key[0], "id": hits["id"].to_numpy(), "admitted": decisions, "late": late,
        })

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that list state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def admit_stream(
    hits: DataFrame, key: str, ts: str, tie_break: str, max_hits: int, window_seconds: int
) -> DataFrame:
    """`key, id, admitted, late` for every hit of the stream.

    The hits of one key in one micro-batch are held together, so the source's batch limit
    (`maxFilesPerTrigger`) bounds them.
    """
    rows = hits.select(
        F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(tie_break).cast("bigint").alias("id"),
    )
    return rows.groupBy("key").transformWithStateInPandas(
        AdmissionProcessor(max_hits, window_seconds),
        "key string, id bigint, admitted boolean, late boolean",
        outputMode="append",
        timeMode="none",
    )
