"""Checks on loaded tables, each returned as a small DataFrame.

All checks of a kind on one table share a single pass; results of a few rows are
turned into long form afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.numeric import count_where
from millrace.sources import schemas

# A load is complete when at least 98 % of the expected rows arrived.
ROW_TOLERANCE = 0.02


def _long(one_row: DataFrame, values: Mapping[str, str], key: str, value: str) -> DataFrame:
    """Unpivot a single row; ``values`` maps aggregate column to label."""
    items = [F.struct(F.lit(label).alias(key), F.col(c).alias(value)) for c, label in values.items()]
    return one_row.select(F.inline(F.array(*items)))


def _count_each(df: DataFrame, conditions: Mapping[str, Column], key: str, value: str = "rows") -> DataFrame:
    """Rows meeting each condition, in one aggregate."""
    slots = {f"c{i}": label for i, label in enumerate(conditions)}
    aggregates = [count_where(c).alias(f"c{i}") for i, c in enumerate(conditions.values())]
    return _long(df.agg(*aggregates), slots, key, value)


def table_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Exact row count per table."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def row_count_check(
    frames: Mapping[str, DataFrame],
    expected: Mapping[str, int] = schemas.EXPECTED_ROWS,
    tolerance: float = ROW_TOLERANCE,
) -> DataFrame:
    """Actual against expected rows; too few fails, too many does not."""
    checked = {name: df for name, df in frames.items() if name in expected}
    want = F.create_map(*[F.lit(x) for name in checked for x in (name, expected[name])])
    return (
        table_counts(checked)
        .withColumnRenamed("rows", "actual")
        .withColumn("expected", F.element_at(want, F.col("table_name")).cast("bigint"))
        .withColumn("ok", F.col("actual") >= F.col("expected") * (1 - tolerance))
    )


def row_count_verdict(checked: DataFrame) -> DataFrame:
    return checked.agg(F.sum("actual").alias("total_rows"), F.bool_and("ok").alias("all_ok"))


def run_checks(df: DataFrame, checks: Sequence[tuple[str, Column, int | None]]) -> DataFrame:
    """Count rows per check. With an expected number the check passes or fails;
    without one it reports whether anything was found."""
    counted = _count_each(df, {label: c for label, c, _ in checks}, "label", "actual")
    want = F.create_map(*[x for label, _, n in checks for x in (F.lit(label), F.lit(n).cast("bigint"))])
    result = counted.withColumn("expected", F.element_at(want, F.col("label")))
    status = (
        F.when(F.col("expected").isNotNull(), F.when(F.col("actual") == F.col("expected"), "pass").otherwise("fail"))
        .when(F.col("actual") > 0, "found")
        .otherwise("none")
    )
    return result.withColumn("status", status)


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _count_each(df, {c: F.col(c).isNull() for c in columns}, "column_name", "null_rows")


def null_change(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Missing values of a column before and after a repair."""
    missing = count_where(F.col(column).isNull()).alias("null_rows")
    count = F.count("*").alias("rows")
    first = before.agg(count, missing).select(F.lit("before").alias("stage"), "*")
    return first.unionByName(after.agg(count, missing).select(F.lit("after").alias("stage"), "*"))


def key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Uniqueness of a key: rows, rows with a missing part, keys that repeat, surplus rows."""
    incomplete = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("incomplete", incomplete)
    whole = ~F.col("incomplete")

    def added(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0).cast("bigint"))

    return sizes.agg(
        added(F.col("n")).alias("rows"),
        added(F.when(F.col("incomplete"), F.col("n"))).alias("null_key_rows"),
        count_where(whole & (F.col("n") > 1)).alias("repeated_keys"),
        added(F.when(whole, F.col("n") - 1)).alias("surplus_rows"),
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Foreign keys without a parent and how many rows carry them; NULL keys pass.

    Keys are counted before the join, so a frequent key is one row by then.
    """
    used = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key).alias(key))
    return used.join(known, key, "left_anti")


def orphan_rows(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The offending rows themselves."""
    known = parent.select(F.col(parent_key).alias(key))
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def domain_violations(df: DataFrame, domains: Mapping[str, Sequence]) -> DataFrame:
    """Rows per column whose value is present but not in the list."""
    return _count_each(
        df, {c: F.col(c).isNotNull() & ~F.col(c).isin(*values) for c, values in domains.items()}, "column_name"
    )


def length_violations(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    return _count_each(df, {c: F.length(c) > n for c, n in limits.items()}, "column_name")


def constraint_report(table: str, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Everything the schema declares about one table: required columns, lengths,
    admissible values, keys and references, as (check, subject, violations)."""
    df = frames[table]
    row_checks = {f"not_null:{c}": F.col(c).isNull() for c in schemas.required_columns(table)}
    row_checks |= {f"length:{c}": F.length(c) > n for c, n in schemas.length_limits(table).items()}
    row_checks |= {
        f"domain:{c}": F.col(c).isNotNull() & ~F.col(c).isin(*v) for c, v in schemas.DOMAINS.get(table, {}).items()
    }
    parts = []
    if row_checks:
        parts.append(_count_each(df, row_checks, "check", "violations"))
    for keys in [schemas.PRIMARY_KEYS.get(table), *schemas.UNIQUE_KEYS.get(table, [])]:
        if keys:
            surplus = key_report(df, keys).select(
                F.lit(f"unique:{','.join(keys)}").alias("check"), F.col("surplus_rows").alias("violations")
            )
            parts.append(surplus)
    for column, parent, parent_key in schemas.FOREIGN_KEYS.get(table, []):
        if parent in frames:
            lost = orphans(df, column, frames[parent], parent_key).agg(
                F.coalesce(F.sum("rows"), F.lit(0).cast("bigint")).alias("violations")
            )
            parts.append(lost.select(F.lit(f"reference:{column}").alias("check"), "violations"))
    if not parts:
        return df.sparkSession.createDataFrame([], "table_name string, check string, violations bigint")
    return reduce(DataFrame.unionByName, parts).select(F.lit(table).alias("table_name"), "check", "violations")
