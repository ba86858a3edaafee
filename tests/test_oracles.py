"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as contract
from scanloom.plans import ORACLES, QUERIES
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_contract(spark):
    df = contract.entry(spark)
    assert df.columns == [
        "scan_id", "critical_count", "high_count", "medium_count", "low_count", "info_count", "total_issues",
    ]
    assert df.count() == spark.read.parquet(f"{FOLDER}/orders.parquet").count()
    assert set(ORACLES) == set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    outcome = compare(spark, con, name, contract.queries()[name], contract.oracle_sql()[name], FOLDER)
    assert outcome is None or outcome.startswith("ok"), outcome
