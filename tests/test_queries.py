"""Every registered query against its SQL equivalent, over whole tables."""

from __future__ import annotations

import os

import pytest
from compare import difference, duck

from leadloom.plans.catalogue import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MAY_BE_EMPTY = {"lead_search_page", "run_log_filter", "lead_detail"}


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        message = difference(frame, connection, ORACLES[name])
        assert message is None or (message == "no rows" and name in MAY_BE_EMPTY), message
    else:
        assert frame.count()


def test_entry_points(spark):
    import __spark_entry__ as entry_point

    assert entry_point.queries().keys() >= entry_point.oracle_sql().keys()
    assert entry_point.entry(spark).count()
