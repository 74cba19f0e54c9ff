"""All registered queries."""

from __future__ import annotations

# Importing the modules registers their queries.
from leadloom.plans import (  # noqa: F401
    enrichment_queries,
    fetch_queries,
    ingest_queries,
    lead_queries,
    page_queries,
    run_queries,
    store_queries,
    upload_queries,
)
from leadloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
