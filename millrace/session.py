"""Session settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Plants report local time; sources carry explicit offsets, so the session zone
# only decides how instants are shown and which day they fall on.
PLANT_TIME_ZONE = "+05:30"

# Adaptive execution splits the partitions of a frequent join key, also where the
# next step would have reused the partitioning. Changeable at run time.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

SETTINGS = {
    **SKEW_SETTINGS,
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "millrace", cores: int | str | None = None, **extra: str) -> SparkSession:
    """Build a session; ``cores`` selects local mode, otherwise the submitter's master is kept."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, below ``spark.checkpoint.dir``; only local sessions make one of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/plant-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A run-time setting for the jobs started inside the block."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)
