"""Ordered load of the cleaned extracts into Parquet tables."""

from __future__ import annotations

import datetime
import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from millrace.operators import cleaning, filters, quality
from millrace.session import PLANT_TIME_ZONE, setting
from millrace.sources import readers, schemas, sinks

# Dimensions come first, so that references of the facts can be checked.
LOAD_ORDER = (
    schemas.DIM_MACHINE_TYPE,
    schemas.DIM_MACHINES,
    schemas.DIM_USERS,
    schemas.DEVIATION,
    schemas.DERIVED_GMAW,
    schemas.PERIODIC_GMAW,
    schemas.SUMMARY_CLAD,
    schemas.PERIODIC_GASCUTTING,
    schemas.SUMMARY_GASCUTTING,
    schemas.NONCUTTING,
)

# Casting a whole row makes one method larger than the JIT compiles; below this
# limit Spark splits it, which halves the time of the check.
JIT_METHOD_BYTES = "8000"

REPORT = (
    "table_name string, csv string, rows_in bigint, rows_loaded bigint, errors bigint, elapsed double, status string, "
    "missing_columns string, extra_columns string, violations bigint"
)


@dataclass(frozen=True)
class Step:
    csv: str
    table: str
    replace: bool = True


def load_plan(only: str | None = None) -> list[Step]:
    """All tables, or the one given by bare or qualified name."""
    steps = [Step(f"{t.split('.')[-1]}.csv", t) for t in LOAD_ORDER]
    if only is None:
        return steps
    chosen = [s for s in steps if only in (s.table, s.table.split(".")[-1])]
    if not chosen:
        raise ValueError(f"table {only!r} is not in the load plan")
    return chosen


def load_table(
    spark: SparkSession, step: Step, csv_dir: str, root: str, aliases: Mapping[str, str] | None = None
) -> tuple:
    """Read, clean and write one table; rejected rows go to ``<table>__rejected``.

    Rows are judged one by one: a bad row, or a line with more cells than the header, never takes
    good ones with it. The extract is parsed again for the rejected rows only when the first pass
    met any. A replacing load also replaces what the last one rejected. The report names the
    columns that the extract lacks (``missing``) and those that the table lacks (``extra``).
    """
    started = time.time()
    source = f"{csv_dir.rstrip('/')}/{step.csv}"
    if not sinks.exists(spark, source):
        return (step.table, step.csv, 0, 0, 0, 0.0, "file not found", "", "", None)
    lines = readers.read_csv_lines(spark, source)
    checked = cleaning.with_rejections(lines, step.table, aliases, readers.SURPLUS)
    missing, extra = cleaning.drifted(lines.drop(readers.SURPLUS), step.table, aliases)
    target = readers.table_path(root, step.table)
    met = Observation()
    verdicts = checked.drop("source").observe(met, F.count_if(F.col("rejected") != "").alias("rejected"))
    good = sinks.accepted(verdicts)
    if step.table == schemas.DEVIATION:
        # Stored by the plant's day, like the other facts.
        good = readers.with_business_day(good, "start_tm", PLANT_TIME_ZONE)
    errors = 0
    with setting(spark, "spark.sql.codegen.hugeMethodLimit", JIT_METHOD_BYTES):
        if step.replace:
            loaded = sinks.rewrite(good, target)
        else:
            loaded = sinks.write_table(good, readers.versions(spark, target)[0], "append")
        if step.replace:
            sinks.remove(spark, f"{target}__rejected")
        if met.get["rejected"]:
            errors = sinks.write_table(sinks.quarantined(checked), f"{target}__rejected", "append")
    status = "ok" if errors == 0 else f"{errors} rejected"
    elapsed = round(time.time() - started, 1)
    return (step.table, step.csv, loaded + errors, loaded, errors, elapsed, status, missing, extra, None)


def run_load(
    spark: SparkSession,
    csv_dir: str,
    root: str,
    only: str | None = None,
    aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """Load the plan in order; a missing extract is reported and skipped. Returns one row per table.

    Once all are there, each loaded table is held against its keys, references and admissible
    values; ``violations`` counts what broke them (``quality.constraint_report`` has the details).
    """
    rows = [load_table(spark, step, csv_dir, root, aliases) for step in load_plan(only)]
    tables = stored_tables(spark, root)
    broken = {}
    for row in rows:
        if row[0] in tables and row[6] != "file not found":
            broken[row[0]] = quality.constraint_report(row[0], tables).agg(F.sum("violations")).first()[0] or 0
    return spark.createDataFrame([(*row[:-1], broken.get(row[0])) for row in rows], REPORT)


def load_total(report: DataFrame) -> DataFrame:
    return report.agg(F.sum("rows_loaded").alias("total_rows"), F.sum("errors").alias("total_errors"))


class StoredTables(dict):
    """Stored tables by name; ``days`` tells which business days one holds, newest first, without reading it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        paths = {t: readers.table_path(root, t) for t in LOAD_ORDER}
        super().__init__({t: readers.read_stored(spark, p) for t, p in paths.items() if sinks.has_table(spark, p)})

    def days(self, table: str) -> list[datetime.date] | None:
        """None for a table that is not laid out by day."""
        df = self[table]
        return readers.stored_days(self.spark, readers.table_path(self.root, table)) if sinks.partition_columns(df) else None


def stored_tables(spark: SparkSession, root: str) -> StoredTables:
    """The tables present below a root folder."""
    return StoredTables(spark, root)


def verify(spark: SparkSession, root: str, expected: Mapping[str, int] = schemas.EXPECTED_ROWS) -> DataFrame:
    """Row counts of the stored tables against expectation."""
    return quality.row_count_check(stored_tables(spark, root), expected)


def repair_checks() -> list:
    """Checks on the deviation fact after its repair."""
    unit = F.col("parameter_unit")
    return [
        ("parameter_unit missing", unit.isNull(), 0),
        ("parameter_unit A", unit == "A", None),
        ("parameter_unit V", unit == "V", None),
        ("parameter_unit L/min", unit == "L/min", None),
        ("mid present", F.col("mid").isNotNull(), None),
    ]


def user_checks() -> list:
    """The check on the users after the repair."""
    return [("phone shows a fraction", filters.shows_fraction("phno"), 0)]
