"""Names: registering tables and views, and what the catalog knows about them."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sources import schemas
from millrace.sources.readers import table_path, versions


def lookup_order(names: list[str]) -> dict[str, str]:
    """Bare name to qualified name; the first schema of the search path wins."""
    rank = {s: i for i, s in enumerate(schemas.SEARCH_PATH)}
    ordered = sorted(names, key=lambda n: rank.get(n.split(".")[0], len(rank)), reverse=True)
    return {n.split(".")[-1]: n for n in ordered}


def register(frames: Mapping[str, DataFrame]) -> None:
    """Make tables queryable under their bare names; see ``qualify`` for the others."""
    for bare, name in lookup_order(list(frames)).items():
        frames[name].createOrReplaceTempView(bare)
    for name, df in frames.items():
        df.createOrReplaceTempView(name.replace(".", "__"))


def qualify(sql: str, names: list[str]) -> str:
    """Point ``schema.table`` at the registered view of that table."""
    for name in names:
        schema, bare = name.split(".")
        sql = re.sub(rf"(?i)(?<![\w.]){schema}\s*\.\s*{bare}\b", f"{schema}__{bare}", sql)
    return sql


def publish(spark: SparkSession, root: str) -> None:
    """Enter stored tables into the session catalog, one database per schema."""
    from millrace.sources.sinks import has_table

    for table in schemas.DDL:
        path = table_path(root, table)
        if has_table(spark, path):
            current = versions(spark, path)[0]
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {table.split('.')[0]}")
            # An entry only names a folder: after a rewrite it must name the new one.
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            spark.catalog.createTable(table, path=current, source="parquet")
            if "business_date" in spark.read.parquet(current).columns:
                spark.catalog.recoverPartitions(table)


def column_listing(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(table_schema, table_name, ordinal, column_name, data_type) of every table."""
    spark = next(iter(frames.values())).sparkSession
    rows = [
        (*name.rpartition(".")[::2], i, f.name, f.dataType.simpleString())
        for name, df in frames.items()
        for i, f in enumerate(df.schema, 1)
    ]
    return spark.createDataFrame(
        rows, "table_schema string, table_name string, ordinal int, column_name string, data_type string"
    )


def column_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    return (
        column_listing(frames)
        .groupBy("table_schema", "table_name")
        .agg(F.count("*").alias("column_count"))
        .orderBy("table_schema", "table_name")
    )
