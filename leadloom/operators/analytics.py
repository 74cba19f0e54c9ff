"""List, facet, overview and cluster queries over the lead table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.constants import FACET_COLUMNS, LIST_COLUMNS, RISKY_STATUSES, SORT_COLUMNS
from leadloom.functions.text import non_empty, percent

_EQUALITY = ("industry", "state", "city", "country", "email_status", "source_file")


def filter_leads(df: DataFrame, search: str | None = None, **equals: str | None) -> DataFrame:
    """All given conditions together; an empty argument is no condition.

    `search` looks for the stripped term anywhere in name, e-mail or company, whatever the case;
    `%` and `_` in it work as wildcards, a backslash is a plain character.
    """
    unknown = set(equals) - set(_EQUALITY)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    if search:
        term = "%" + search.strip().replace("\\", "\\\\") + "%"
        df = df.where(
            F.col("name").ilike(term) | F.col("email").ilike(term)
            | F.col("company_name").ilike(term)
        )
    for name, value in equals.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def sort_leads(
    df: DataFrame, sort: str = "created_at", order: str = "desc", tie_break: str = "id"
) -> DataFrame:
    return df.orderBy(*order_columns(sort, order, tie_break))


def order_columns(sort: str, order: str, tie_break: str = "id") -> list[Column]:
    if sort not in SORT_COLUMNS or order not in ("asc", "desc"):
        raise ValueError(f"cannot sort by {sort} {order}")
    column = F.col(sort).asc_nulls_first() if order == "asc" else F.col(sort).desc_nulls_last()
    return [column, F.col(tie_break)]


def lead_page(
    df: DataFrame, page: int = 1, limit: int = 25, sort: str = "created_at", order: str = "desc",
    tie_break: str = "id", columns: tuple[str, ...] = LIST_COLUMNS, **filters: str | None,
) -> DataFrame:
    """One page of the filtered list with the total number of hits on each row.

    The total is a scalar subquery with its own partial aggregate, not a window over all rows.
    """
    if page < 1 or not 1 <= limit <= 200:
        raise ValueError("page starts at 1, limit is 1 to 200")
    hits = filter_leads(df, **filters)
    rows = sort_leads(hits, sort, order, tie_break).offset((page - 1) * limit).limit(limit)
    total = hits.agg(F.count("*")).scalar()
    return rows.select(*columns).withColumn("total", total)


def lead_detail(df: DataFrame, key: str, value, columns: tuple[str, ...]) -> DataFrame:
    """Point lookup; `key` is unique, so one row at most."""
    return df.where(F.col(key) == value).select(*columns).limit(1)


def facet_options(df: DataFrame, columns: tuple[str, ...] = FACET_COLUMNS) -> DataFrame:
    """Distinct filled values per facet, sorted, one row each: one scan, combined map-side."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("facet"), non_empty(c).alias("value")) for c in columns
    ]))
    return (
        df.select(pairs.alias("p")).select("p.facet", "p.value")
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("facet", "value")
    )


def overview(df: DataFrame) -> DataFrame:
    """Total, valid, invalid, risky and unknown leads in one pass."""
    status = F.col("email_status")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(status == "valid").alias("valid"),
        F.count_if(status == "invalid").alias("invalid"),
        F.count_if(status.isin(*RISKY_STATUSES)).alias("risky"),
        F.count_if(status.isNull() | (status == "unknown")).alias("unknown"),
    )


def top_labels(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The `n` most frequent values, ties in label order."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("label"))
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "label")
        .limit(n)
    )


def status_counts(df: DataFrame) -> DataFrame:
    """Leads per mailbox status; missing and blank count as `unknown`, in one row."""
    label = F.coalesce(non_empty("email_status"), F.lit("unknown"))
    return df.groupBy(label.alias("label")).agg(F.count("*").alias("count"))


def industry_cards(df: DataFrame, cities: int = 3) -> DataFrame:
    """Per industry: leads, valid share, mean relevance and the most frequent cities.

    One scan: counts per (industry, city) are combined map-side, ranked within the industry and
    summed up where they are.  An industry that holds a third of all leads is one row per city after
    the first shuffle.
    """
    per_city = (
        df.where(F.col("industry").isNotNull())
        .groupBy("industry", "city")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("email_status") == "valid").alias("n_valid"),
            F.sum("relevance_score").alias("relevance_sum"),
            F.count("relevance_score").alias("relevance_n"),
        )
    )
    by_size = Window.partitionBy("industry").orderBy(
        F.col("city").isNull(), F.desc("n"), F.asc("city")
    )
    top = F.when(
        F.col("city").isNotNull() & (F.col("rank") <= cities), F.struct("rank", "city")
    )
    return (
        per_city.withColumn("rank", F.row_number().over(by_size))
        .groupBy("industry")
        .agg(
            F.sum("n").alias("count"),
            percent(F.sum("n_valid"), F.sum("n")).alias("valid_pct"),
            F.array_sort(F.collect_list(top)).alias("ranked"),
            F.try_divide(F.sum("relevance_sum"), F.sum("relevance_n")).alias("avg_relevance"),
        )
        .select(
            "industry", "count", "valid_pct", F.col("ranked.city").alias("top_cities"),
            "avg_relevance",
        )
        .orderBy(F.desc("count"), "industry")
    )


def industry_detail(df: DataFrame, industry: str, n: int = 10) -> DataFrame:
    """One industry in long form: its totals and its `n` most frequent cities and states.

    Rows are `(dim, label, count, valid_pct, avg_relevance)`; the two shares are on the `total` row.
    One scan and one shuffle: every lead counts towards three labels, combined map-side.
    """
    dims = F.explode(F.array(
        F.struct(F.lit("total").alias("dim"), F.col("industry").alias("label")),
        F.struct(F.lit("city").alias("dim"), F.col("city").alias("label")),
        F.struct(F.lit("state").alias("dim"), F.col("state").alias("label")),
    ))
    counted = (
        df.where(F.col("industry") == industry)
        .select(dims.alias("d"), "email_status", "relevance_score")
        .groupBy(F.col("d.dim").alias("dim"), F.col("d.label").alias("label"))
        .agg(
            F.count("*").alias("count"),
            percent(F.count_if(F.col("email_status") == "valid"), F.count("*")).alias("valid_pct"),
            F.avg("relevance_score").alias("avg_relevance"),
        )
        .where(F.col("label").isNotNull())
    )
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("count"), "label"))
    is_total = F.col("dim") == "total"
    return (
        counted.withColumn("rank", rank)
        .where(F.col("rank") <= n)
        .select(
            "dim", "label", "count",
            F.when(is_total, F.col("valid_pct")).alias("valid_pct"),
            F.when(is_total, F.col("avg_relevance")).alias("avg_relevance"),
        )
    )


def reclassify_unknown(df: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Industries outside the taxonomy (one `label` column) become `Unknown`; the flag
    `reclassified` tells which rows changed."""
    known = F.broadcast(taxonomy.select(F.col("label").alias("industry")).distinct()).withColumn(
        "_known", F.lit(True)
    )
    reset = F.col("industry").isNotNull() & F.col("_known").isNull()
    joined = df.join(known, "industry", "left").withColumn("reclassified", reset)
    return joined.withColumn(
        "industry", F.when(F.col("reclassified"), "Unknown").otherwise(F.col("industry"))
    ).select(*df.columns, "reclassified")
