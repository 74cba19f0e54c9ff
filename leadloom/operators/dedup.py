"""First row wins: one lead per e-mail, in file order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Groups that the rows of one key are dealt to before they are ranked.
SALTS = 1024


def first_rows(df: DataFrame, key: str = "email", order: list[str] | None = None) -> DataFrame:
    """The first row of each key; rows without a key are dropped.

    Spark limits each key to one row per task before the shuffle (WindowGroupLimit), so a key that
    holds a third of all rows sends only one row per task.
    """
    window = Window.partitionBy(key).orderBy(*order)
    return (
        df.where(F.col(key).isNotNull())
        .withColumn("_n", F.row_number().over(window))
        .where(F.col("_n") == 1)
        .drop("_n")
    )


def mark_duplicates(
    df: DataFrame,
    order: list[str],
    key: str = "email",
    stored: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Every row with its outcome (`new`, `duplicate`, `skipped`), `is_duplicate` and
    `duplicate_of` (the e-mail it repeats).

    The input is read once.  Rows of a key are dealt to `salts` groups by a hash of their position,
    and only the first row of each group can be the first of the key, so the second step ranks at
    most `salts` rows of a key, whatever share of all rows it holds; all other rows, and those
    without a key, stay spread.  `stored` holds known keys; a key that is stored makes all its rows
    duplicates.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    within = Window.partitionBy(key, salt).orderBy(*order)
    ahead = F.col(key).isNotNull() & (F.row_number().over(within) == 1)
    led = df.withColumn("_ahead", ahead)
    across = Window.partitionBy(
        F.when(F.col("_ahead"), F.col(key)), F.when(~F.col("_ahead"), F.xxhash64(*order))
    ).orderBy(*order)
    rows = led.withColumn("_new", F.col("_ahead") & (F.row_number().over(across) == 1))
    if stored is not None:
        known = stored.select(F.col(key).alias("_key")).distinct().withColumns({
            "_split": F.lit(0).cast("long"), "_known": F.lit(True),
        })
        probe = rows.withColumns({
            "_key": F.when(F.col("_new"), F.col(key)),
            "_split": F.when(F.col("_new"), 0).otherwise(F.xxhash64(*order)).cast("long"),
        })
        rows = probe.join(known, ["_key", "_split"], "left").withColumn(
            "_new", F.col("_new") & F.col("_known").isNull()
        )
    outcome = F.when(F.col(key).isNull(), "skipped").when(F.col("_new"), "new").otherwise(
        "duplicate"
    )
    return (
        rows.withColumn("outcome", outcome)
        .withColumn("is_duplicate", F.col("outcome") == "duplicate")
        .withColumn("duplicate_of", F.when(F.col("outcome") == "duplicate", F.col(key)))
        .select(*df.columns, "outcome", "is_duplicate", "duplicate_of")
    )
