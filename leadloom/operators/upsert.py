"""Keyed update of a stored table: join, take the new value where there is one, write a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns (`{name: type}`) that the table does not have yet, as null."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def upsert_by_key(
    stored: DataFrame, changes: DataFrame, as_of: Column, key: str = "email"
) -> DataFrame:
    """Stored rows with the columns of `changes` (unique per key) written over them.

    A matched row takes every changed column, nulls too, and gets `updated_at = as_of`.
    """
    updated = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in updated]).withColumn(
        "_hit", F.lit(True)
    )
    joined = stored.join(renamed, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for c in stored.columns:
        if c == "updated_at":
            out.append(F.when(hit, as_of).otherwise(F.col(c)).alias(c))
        elif c in updated:
            out.append(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    out += [F.col(f"_new_{c}").alias(c) for c in updated if c not in stored.columns]
    return joined.select(*out)
