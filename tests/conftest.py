from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clientlens import session  # noqa: E402
from tests.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    found = local_session()
    yield found
    session.discard_stages(found)


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def customers(spark, folder):
    from clientlens.plans import queries

    return queries.customers(spark, folder)


@pytest.fixture(scope="session")
def nine(spark):
    """The minimal upload: nine rows (i, i, 100 i)."""
    rows = [(i, i, 100.0 * i) for i in range(1, 10)]
    return spark.createDataFrame(rows, "Recency_Days int, Frequency_Orders int, Monetary_Spend double").coalesce(1)
