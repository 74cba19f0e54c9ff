"""The list of industries, kept as a JSON setting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.constants import DEFAULT_TAXONOMY
from leadloom.functions.text import strip

TAXONOMY_KEY = "industry_taxonomy"


def default_taxonomy(spark: SparkSession) -> DataFrame:
    labels = F.array(*[F.lit(label) for label in DEFAULT_TAXONOMY])
    return spark.range(1).select(F.posexplode(labels).alias("position", "label"))


def read_taxonomy(settings: DataFrame) -> DataFrame:
    """`(position, label)` of the stored list; the default one when the setting is missing or not
    a list of texts.  `settings` has `key` and `value`, `key` is unique."""
    value = settings.where(F.col("key") == TAXONOMY_KEY).agg(F.max("value").alias("value"))
    default = F.array(*[F.lit(label) for label in DEFAULT_TAXONOMY])
    only_texts = F.expr(
        "schema_of_variant(try_parse_json(value)) in ('ARRAY<STRING>', 'ARRAY<VOID>')"
    )
    texts = F.from_json("value", "array<string>")
    stored = F.when(only_texts & F.forall(texts, lambda x: x.isNotNull()), texts)
    return value.select(F.coalesce(stored, default).alias("labels")).select(
        F.posexplode("labels").alias("position", "label")
    )


def taxonomy_setting(spark: SparkSession, labels: list[str]) -> DataFrame:
    """The setting row for a new list: stripped, blanks dropped, `Unknown` added when missing."""
    kept = [label.strip() for label in labels if label and label.strip()]
    if "Unknown" not in kept:
        kept.append("Unknown")
    return spark.range(1).select(
        F.lit(TAXONOMY_KEY).alias("key"),
        F.to_json(F.array(*[F.lit(label) for label in kept])).alias("value"),
    )


def clean_taxonomy(labels: Column) -> Column:
    """The same rule as a column expression over an array column."""
    kept = F.filter(F.transform(labels, lambda x: strip(x)), lambda x: x != "")
    return F.when(F.array_contains(kept, "Unknown"), kept).otherwise(
        F.array_append(kept, F.lit("Unknown"))
    )
