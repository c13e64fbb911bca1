"""Every registered query against its SQL on the smallest tables, or for rows where there is none."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from groundset.plans import catalog

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
ORACLES = entry.oracle_sql()
WITHOUT_SQL = {"collect_records", "collect_stats", "fuzzy_long_keys"}
OWN = sorted(set(entry.queries()) & set(catalog.QUERIES))


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_only_iterative_jobs_lack_sql():
    assert set(OWN) - set(ORACLES) == WITHOUT_SQL


def test_entry(spark):
    assert entry.entry(spark).count() > 0
