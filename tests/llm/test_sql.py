"""Those queries of the training-data operators that have SQL, on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import compare
from lexiloom.llm import oracle
from lexiloom.llm.queries import QUERIES

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(str(TABLES))


@pytest.mark.parametrize("name", sorted(oracle.build()))
def test_query(spark, con, name):
    assert compare.differences(QUERIES[name](spark, str(TABLES)), con, oracle.build()[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.build())))
def test_others_run(spark, name):
    assert QUERIES[name](spark, str(TABLES)).count() > 0
