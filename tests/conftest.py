"""One local session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Results of a column function over one text column."""

    def apply(function, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
        found = rows.select("i", function("c").alias("v")).orderBy("i").collect()
        return [r.v for r in found]

    return apply
