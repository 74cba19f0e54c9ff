"""Registered queries: a Spark plan each, with an equivalent SQL text where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a plan under its function name."""

    def register(plan: Plan) -> Plan:
        key = name or plan.__name__
        QUERIES[key] = plan
        if oracle is not None:
            ORACLES[key] = oracle
        return plan

    return register


def entries_text(c: str | Column) -> Column:
    """A map as text, `key=value` in key order, so that results compare as plain values."""
    pairs = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), "; ")


def time_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
