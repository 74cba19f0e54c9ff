"""Admission and window counts against the rule taken hit by hit."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.operators.throttle import admit_hits, admit_sorted, hits_in_window


def by_the_rule(hits, max_hits, window):
    """hits: (key, seconds, id); the rule as stated, one hit at a time."""
    admitted, decisions = defaultdict(list), {}
    for key, time, number in sorted(hits, key=lambda h: (h[1], h[2])):
        recent = [t for t in admitted[key][-max_hits:] if time - t <= window]
        decisions[number] = len(recent) < max_hits
        admitted[key] += [time] * decisions[number]
    return decisions


def _hits(kind, seed):
    rng = random.Random(seed)
    hits = []
    for number in range(3000):
        if kind == "hot" and rng.random() < 0.4:
            hits.append(("hot", rng.randrange(4000), number))
        elif kind == "bursts":
            hits.append((f"k{rng.randrange(5)}", rng.choice([0, 5000, 9000]) + rng.randrange(90), number))
        elif kind == "instant":
            hits.append(("one", rng.randrange(4) * 10, number))
        else:
            hits.append((rng.choice(["a", "b", "c", None]), rng.randrange(100_000), number))
    return hits


def _frame(spark, hits):
    rows = spark.createDataFrame(hits, "key string, s int, id long").repartition(6)
    return rows.withColumn("ts", F.timestamp_seconds("s")).withColumn("extra", F.col("id") * 2)


@pytest.mark.parametrize("kind", ["hot", "bursts", "instant", "thin"])
@pytest.mark.parametrize("max_hits,window", [(1, 10), (3, 60), (5, 60)])
def test_admission(spark, kind, max_hits, window):
    hits = _hits(kind, f"{kind}{max_hits}")
    found = admit_hits(_frame(spark, hits), "key", "ts", "id", max_hits, window).collect()
    assert len(found) == len(hits)
    assert all(r.extra == r.id * 2 for r in found)
    expected = by_the_rule([(k or "unknown", s, i) for k, s, i in hits], max_hits, window)
    assert {r.id: r.admitted for r in found} == expected


def test_small_arrow_batches_share_state(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        hits = _hits("hot", "batches")
        found = admit_hits(_frame(spark, hits), "key", "ts", "id", 4, 30).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = by_the_rule([(k or "unknown", s, i) for k, s, i in hits], 4, 30)
    assert {r.id: r.admitted for r in found} == expected


def test_boundary_hit_still_counts():
    times = np.array([1, 2, 3, 12, 30]) * 1_000_000
    decided = admit_sorted(times, deque(), 2, 10_000_000)
    assert decided.tolist() == [True, True, False, True, True]
    exactly = admit_sorted(np.array([0, 10_000_000, 10_000_001]), deque(), 1, 10_000_000)
    assert exactly.tolist() == [True, False, True]


@pytest.mark.parametrize("kind", ["hot", "bursts"])
def test_window_counts(spark, kind):
    hits = _hits(kind, "count")
    found = hits_in_window(_frame(spark, hits), "key", "ts", 45).collect()
    times = defaultdict(list)
    for key, second, _ in hits:
        times[key].append(second)
    expected = {i: sum(s - 45 <= t <= s for t in times[k]) for k, s, i in hits}
    assert {r.id: r.hits for r in found} == expected


def test_admission_of_keys_that_are_always_busy(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "event_type", "event_id", "ts"
    )
    rows = events.select(
        "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id"
    )
    expected = by_the_rule([tuple(r) for r in rows.collect()], 5, 3_600_000_000)
    found = admit_hits(events, "event_type", "ts", "event_id", 5, 3600).collect()
    assert {r.event_id: r.admitted for r in found} == expected
