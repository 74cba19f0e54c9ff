"""A lookup join that keeps its balance when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single task may join without splitting the key.
ROWS_PER_TASK = 1_000_000
# Tasks over which rows without a key are spread.
NULL_SPLITS = 1024


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: list[str],
    how: str = "left",
    counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join `left` to `right`, which holds each key at most once.

    Without `counts` this is a plain join: adaptive execution sees the shuffled sizes and splits the
    partition of a hot key, or of the rows without a key, over several tasks, and no input is read
    twice.

    A caller that has counted the keys anyway passes `counts` (`key, n`).  Keys with more than
    `rows_per_task` rows are then cut into splits before the shuffle: left rows pick a split by a
    hash of `spread_by` (stable when a lost task is run again), right rows are repeated once per
    split.  The list of such keys is broadcast; it has at most `rows / rows_per_task` entries by
    construction.  Left rows without a key match nothing and are spread out too.
    """
    if counts is None:
        return left.join(right, key, how)
    hot = F.broadcast(
        counts.where(F.col("n") > rows_per_task).select(
            key, F.ceil(F.col("n") / rows_per_task).cast("int").alias("_splits")
        )
    )
    splits: Column = F.coalesce(F.col("_splits"), F.lit(1))
    row_hash = F.xxhash64(*spread_by)
    left_split = left.join(hot, key, "left").withColumn(
        "_split",
        F.when(F.col(key).isNull(), F.pmod(row_hash, F.lit(NULL_SPLITS)))
        .otherwise(F.pmod(row_hash, splits))
        .cast("int"),
    ).drop("_splits")
    right_split = right.join(hot, key, "left").withColumn(
        "_split", F.explode(F.sequence(F.lit(0), splits - 1))
    ).drop("_splits")
    return left_split.join(right_split, [key, "_split"], how).drop("_split")
