"""A stored list in its sort order, cut into zones: pages of any depth and substring search read the
zones they need."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.constants import LIST_COLUMNS
from leadloom.operators.analytics import filter_leads, order_columns

SEARCHED = ("name", "email", "company_name")
GRAM = 3


def write_zones(
    df: DataFrame, path: str, zones: int, sort: str = "created_at", order: str = "desc",
    tie_break: str = "id", searched: tuple[str, ...] = SEARCHED,
) -> None:
    """`df` in order, in `zones` stretches of about equal size: folder `rows`, one partition a zone;
    `counts`, rows of each zone and of all zones before it; `grams`, which runs of three letters of
    the searched columns stand in which zones."""
    by = order_columns(sort, order, tie_break)
    dealt = df.repartitionByRange(zones, *by).withColumn("zone", F.spark_partition_id())
    dealt.sortWithinPartitions("zone", *by).write.partitionBy("zone").parquet(f"{path}/rows")
    rows = _zone_rows(df.sparkSession, path)
    before = F.sum("n").over(Window.orderBy("zone").rowsBetween(Window.unboundedPreceding, -1))
    # one row a zone
    rows.groupBy("zone").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(before, F.lit(0))
    ).coalesce(1).write.parquet(f"{path}/counts")
    texts = F.explode(F.array(*[F.lower(F.col(c)) for c in searched])).alias("text")
    grams = rows.select("zone", texts).where(F.length("text") >= GRAM).select(
        "zone", F.explode(F.expr(
            f"transform(sequence(1, length(text) - {GRAM - 1}), i -> substring(text, i, {GRAM}))"
        )).alias("gram")
    )
    grams.distinct().repartition("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def _zone_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def _in_zones(spark: SparkSession, path: str, zones: list[int]) -> DataFrame:
    """The rows of these zones; others are not opened."""
    return _zone_rows(spark, path).where(F.col("zone").isin(zones) if zones else F.lit(False))


def stored_page(
    spark: SparkSession, path: str, page: int = 1, limit: int = 25, sort: str = "created_at",
    order: str = "desc", tie_break: str = "id", columns: tuple[str, ...] = LIST_COLUMNS,
) -> DataFrame:
    """One page of the stored list with the total on each row.  Its zones and the total come from the
    counts, so the last page reads no more rows than the first."""
    if page < 1 or not 1 <= limit <= 200:
        raise ValueError("page starts at 1, limit is 1 to 200")
    start = (page - 1) * limit
    counts = spark.read.parquet(f"{path}/counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # a page lies in as many zones as it has rows at most
    wanted = counts.where(
        (F.col("before") < start + limit) & (F.col("before") + F.col("n") > start)
    ).orderBy("zone").collect()
    skipped = start - wanted[0].before if wanted else 0
    rows = _in_zones(spark, path, [r.zone for r in wanted])
    return (
        rows.orderBy(*order_columns(sort, order, tie_break)).offset(skipped).limit(limit)
        .select(*columns).withColumn("total", F.lit(total).cast("bigint"))
    )


def term_grams(term: str) -> list[str]:
    """Runs of three letters that every match of a search term holds; `%` and `_` are wildcards."""
    parts = re.split("[%_]", term.strip().lower())
    return sorted({p[i : i + GRAM] for p in parts for i in range(len(p) - GRAM + 1)})


def zones_with(spark: SparkSession, path: str, term: str) -> list[int] | None:
    """Zones that hold all runs of a term; None if it has none, so that any zone may match.  The
    driver gets at most one number a zone."""
    grams = term_grams(term)
    if not grams:
        return None
    postings = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(grams))
    found = postings.groupBy("zone").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    return [r.zone for r in found.select("zone").collect()]


def search_stored(
    spark: SparkSession, path: str, search: str, **equals: str | None
) -> DataFrame:
    """`filter_leads` over the stored list: the index names zones, the exact test runs in them."""
    zones = zones_with(spark, path, search)
    rows = _zone_rows(spark, path) if zones is None else _in_zones(spark, path, zones)
    return filter_leads(rows, search=search, **equals).drop("zone")
