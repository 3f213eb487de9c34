import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = get_spark(
        "tests",
        4,
        **{
            "spark.sql.warehouse.dir": str(warehouse),
            "spark.driver.memory": "4g",
            # Small inputs must still cover several partitions.
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values():
    """Rows of a DataFrame as sorted tuples."""

    def read(df, *columns):
        rows = (df.select(*columns) if columns else df).collect()
        return sorted((tuple(r) for r in rows), key=repr)

    return read
