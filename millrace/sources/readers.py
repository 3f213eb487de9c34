"""Scans: CSV with and without header, stored tables, literal rows, JDBC."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millrace.sources import schemas

# Facts lie in one folder a day.
DAY = "business_date"
DATE = re.compile(r"\d{4}-\d{2}-\d{2}")

# Column for lines that hold more cells than the header.
SURPLUS = "_surplus"


# Doubled quotes as in RFC 4180; blanks around values are kept, and so are line
# breaks in quoted cells. For these a file is read by one task: an extract of any
# size should come as a folder of files.
CSV_FORM = {"quote": '"', "escape": '"', "multiLine": True}


def _csv(spark: SparkSession, header: bool):
    return spark.read.options(header=header, **CSV_FORM)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with header, every column as text: nothing is inferred, so identifiers
    keep leading zeros and the file is read once. ``columns`` prunes the scan."""
    df = _csv(spark, True).csv(path)
    return df.select(*columns) if columns else df


# A separator outside quotes.
SEPARATOR = r',(?=(?:[^"]*"[^"]*")*[^"]*\z)'


def read_csv_lines(spark: SparkSession, path: str, surplus: str = SURPLUS) -> DataFrame:
    """The same, and a line with more cells than the header is kept as text in ``surplus``.

    All files of a folder must have the header of the first: another one is an
    error, not a table with its columns exchanged. Short lines end in NULLs.
    """
    names = _csv(spark, True).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, surplus]])
    options = {"columnNameOfCorruptRecord": surplus, "enforceSchema": False}
    df = _csv(spark, True).options(**options).schema(schema).csv(path)
    cells = F.size(F.split(F.col(surplus), SEPARATOR, -1))
    return df.withColumn(surplus, F.when(cells > len(names), F.col(surplus)))


def read_raw(spark: SparkSession, path: str, layout: str | Sequence[str]) -> DataFrame:
    """Headerless export by position. Columns named in parentheses (credentials,
    always empty) are never parsed."""
    names = schemas.RAW_LAYOUTS[layout] if isinstance(layout, str) else list(layout)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    kept = [n for n in names if not n.startswith("(")]
    return _csv(spark, False).schema(schema).csv(path).select(*kept)


def table_path(root: str, table: str) -> str:
    """``schema.table`` below a root folder."""
    return f"{root.rstrip('/')}/{table.replace('.', '/')}"


def read_table(spark: SparkSession, table: str, root: str | None = None) -> DataFrame:
    """Stored table by qualified name, from a folder or from the catalog."""
    return spark.table(table) if root is None else read_stored(spark, table_path(root, table))


def read_stored(spark: SparkSession, path: str, previous: bool = False) -> DataFrame:
    """The table at ``path``, in its current contents or those before the last rewrite."""
    return spark.read.parquet(versions(spark, path)[previous])


def versions(spark: SparkSession, path: str) -> list[str]:
    """Folders with the current and, if kept, the previous contents of a table.

    A small file next to the table names them. Until a table is first rewritten
    there is none, and the files lie at ``path`` itself.
    """
    pointer = spark._jvm.org.apache.hadoop.fs.Path(f"{path}__current")
    fs = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        return [path]
    stream = fs.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()


def stored_days(spark: SparkSession, path: str) -> list[datetime.date]:
    """The business days a stored table holds, newest first, from the names of its folders.

    One listing of as many names as there are days; no file is opened. Rows without
    a day lie in a folder of their own, which is no day.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(versions(spark, path)[0])
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(folder, f"{DAY}=*"))
    names = [status.getPath().getName().partition("=")[2] for status in found]
    return sorted((datetime.date.fromisoformat(n) for n in names if DATE.fullmatch(n)), reverse=True)


def machine_types(spark: SparkSession) -> DataFrame:
    """The seed rows of the type dimension. As VALUES the optimizer knows their size
    and broadcasts them, never the table they are joined to."""
    rows = ", ".join(f"({k}S, '{v}', true)" for k, v in schemas.MACHINE_TYPES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(mtid, machine_type_name, is_active)")


def read_jdbc(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """Parallel read from a database, split on a numeric key. Needs the driver jar
    and a reachable server; credentials belong in ``options`` or the URL."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, **options)
        .options(lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .load()
    )


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=5000, **options).mode(mode).save()


def with_business_day(df: DataFrame, moment: str, zone: str | None = None) -> DataFrame:
    """Calendar day of an instant in the plant's zone; zone-less times are taken as written."""
    c = F.col(moment)
    if zone is not None and not isinstance(df.schema[moment].dataType, T.TimestampNTZType):
        c = F.convert_timezone(F.current_timezone(), F.lit(zone), c.cast("timestamp_ntz"))
    return df.withColumn("business_date", F.to_date(c))
