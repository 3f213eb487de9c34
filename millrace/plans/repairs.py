"""Repair of stored tables in place, followed by the checks on the outcome."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from millrace.operators import quality, repair
from millrace.plans.load import repair_checks, user_checks
from millrace.sources import readers, schemas, sinks


def repair_units(spark: SparkSession, root: str) -> DataFrame:
    """Fill the units of the deviation fact; returns missing units before and after."""
    path = readers.table_path(root, schemas.DEVIATION)
    sinks.rewrite(repair.fill_units(readers.read_stored(spark, path)), path)
    return quality.null_change(
        readers.read_stored(spark, path, previous=True), readers.read_stored(spark, path), "parameter_unit"
    )


def drop_obsolete_columns(spark: SparkSession, root: str) -> None:
    """Drop the empty columns of every table that has any."""
    for table in repair.OBSOLETE_COLUMNS:
        path = readers.table_path(root, table)
        if sinks.has_table(spark, path):
            df = readers.read_stored(spark, path)
            slim = repair.drop_obsolete(df, table)
            if slim.columns != df.columns:
                sinks.rewrite(slim, path)


def apply_patch(
    spark: SparkSession,
    root: str,
    table: str,
    patch: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    newest_first: Sequence[Column],
) -> int:
    """Keyed update of a stored table from a corrected extract; empty cells are
    ignored. Keys may repeat in the patch: the first row in ``newest_first`` counts,
    so no stored row is ever multiplied. Returns the number of rows that really
    changed; without any the table stays as it is.

    Of a table laid out by day only the days with a changed row are written again.
    They are found by the same update on keys, days and updated columns alone."""
    path = readers.table_path(root, table)
    stored = readers.read_stored(spark, path)
    if sinks.partition_columns(stored):
        return _patch_days(stored, path, patch, keys, columns, newest_first)
    updated = repair.keyed_update(stored, patch, keys, columns, newest_first, skip_null=True, changed="_changed")
    seen = Observation()
    version = sinks.new_version(path)
    sinks.write_table(updated.observe(seen, F.count_if("_changed").alias("changed")).drop("_changed"), version)
    changed = seen.get["changed"]
    if changed:
        sinks.switch(spark, path, version)
    else:
        sinks.remove(spark, version)
    return changed


def _patch_days(stored, path, patch, keys, columns, newest_first) -> int:
    day = sinks.PARTITION_COLUMN
    narrow = stored.select(*dict.fromkeys([*keys, *columns, day]))
    # Rows whose key is in no patch cannot change: the join drops them before anything is compared.
    near = narrow.join(patch.select(*keys).distinct(), list(keys), "left_semi").select(*narrow.columns)
    marked = repair.keyed_update(near, patch, keys, columns, newest_first, skip_null=True, changed="_changed")
    # A day that a row moves to is touched as well as the one it leaves.
    touched = near.select(F.col(day)) if day in columns else marked.where("_changed").select(day)
    if day in columns:
        touched = touched.union(marked.where("_changed").select(day))
    days = [row[0] for row in touched.distinct().collect()]
    changed = marked.where("_changed").count() if days else 0
    if changed:
        updated = repair.keyed_update(sinks.of_days(stored, days), patch, keys, columns, newest_first, skip_null=True)
        sinks.rewrite_days(updated, path, days)
    return changed


def verify_repairs(spark: SparkSession, root: str) -> DataFrame:
    """The checks on the repaired tables, as far as they are stored."""
    parts = [
        quality.run_checks(readers.read_table(spark, table, root), checks)
        for table, checks in ((schemas.DEVIATION, repair_checks()), (schemas.DIM_USERS, user_checks()))
        if sinks.has_table(spark, readers.table_path(root, table))
    ]
    return reduce(DataFrame.unionByName, parts)


def all_passed(checks: DataFrame) -> DataFrame:
    """One row: no check failed, and nothing that had to be found is missing."""
    return checks.agg(F.bool_and(F.col("status").isin("pass", "found")).alias("all_passed"))
