"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

from cohort_engine.queries import ORACLES, QUERIES
from compare import differences, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns)
    assert differences(df, con, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as contract
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
