"""Every query of the core against its SQL, on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import compare
from lexiloom.plans import oracle
from lexiloom.plans.queries import QUERIES

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(str(TABLES))


def test_all_have_sql():
    assert set(oracle.build()) <= set(QUERIES) and set(QUERIES) - set(oracle.build()) == {"stem_fr", "stem_report"}


@pytest.mark.parametrize("name", sorted(oracle.build()))
def test_query(spark, con, name):
    assert compare.differences(QUERIES[name](spark, str(TABLES)), con, oracle.build()[name]) is None
