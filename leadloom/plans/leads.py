"""The lead table built from the raw contact rows, as the analytics queries see it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.columns import map_headers, resolve_columns
from leadloom.operators.dedup import first_rows
from leadloom.operators.ingest import clean_leads
from leadloom.operators.validation import stand_in_status
from leadloom.plans.inputs import LEADS_RAW, derived

# Headers of the raw contact rows; the other columns are no file content.
HEADERS = (
    "full_name", "first_name", "last_name", "email", "phone", "country", "company_name", "city",
    "state", "pincode", "website",
)
ORDER = ["source_file", "row_id"]
_KEPT = [
    "row_id", "source_file", "industry", "relevance_score", "email_validated_at", "enriched_at",
]


def raw_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, LEADS_RAW)


def prepare(raw: DataFrame) -> DataFrame:
    """Canonical, cleaned rows, duplicates and rows without e-mail still in."""
    return clean_leads(resolve_columns(raw, map_headers(list(HEADERS)), _KEPT))


def lead_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(raw_leads(spark, sf_dir))


def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per e-mail."""
    return first_rows(lead_rows(spark, sf_dir), order=ORDER)


def lead_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deduplicated leads with mailbox status, id and creation time."""
    created = F.when(F.col("source_file") == "a.csv", "2024-01-01 08:00:00").when(
        F.col("source_file") == "b.csv", "2024-01-02 08:00:00"
    ).otherwise("2024-01-03 08:00:00")
    return clean_table(spark, sf_dir).withColumns({
        "id": F.col("row_id"),
        "created_at": created.cast("timestamp"),
        **stand_in_status("email"),
    })
