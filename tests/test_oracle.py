"""Every registered query against its DuckDB counterpart, value by value."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from millrace.plans import registered

registered.load_all()

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


def test_every_query_has_a_counterpart():
    assert set(registered.ORACLES) == set(registered.QUERIES)
    assert set(registered.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(name, spark, db):
    assert oracle.differences(registered.QUERIES[name](spark, SF_DIR), db, registered.ORACLES[name]) is None


# Averages meet rounding ties only on more rows than the smallest tables hold.
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["cutting_productivity", "shift_sensor_averages", "session_summary"])
def test_sums_on_more_rows(name, sf, spark):
    sf_dir = f"/root/testdata/{sf}"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test data")
    assert oracle.differences(registered.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), registered.ORACLES[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["business_date", "shift_name", "machine_name"]
