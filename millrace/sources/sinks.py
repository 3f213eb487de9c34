"""Writing tables: bulk load, replacement, insert-ignore, quarantine."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from millrace.operators import key_bits
from millrace.operators.repair import last_per_key
from millrace.sources.readers import DAY as PARTITION_COLUMN, versions


def partition_columns(df: DataFrame) -> list[str]:
    """Facts are laid out by business day, dimensions are not partitioned."""
    return [PARTITION_COLUMN] if PARTITION_COLUMN in df.columns else []


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Bulk load as Parquet; the row count comes from the write itself.

    Rows of one day may be a large share of the table, so days are not gathered
    into one task: ``REBALANCE`` splits large days and merges small ones. Rows are
    counted in the writing stage, where a task that is run again counts once.
    """
    days = partition_columns(df)
    out = df.hint("rebalance", *days) if days else df
    seen = Observation()
    out.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).partitionBy(*days).parquet(path)
    return seen.get["rows"]


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; missing values become empty cells, instants keep microseconds and offset."""
    form = {"quote": '"', "escape": '"', "nullValue": "", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX"}
    df.write.mode("overwrite").options(header=True, **form).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def has_table(spark: SparkSession, path: str) -> bool:
    return exists(spark, versions(spark, path)[0])


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rewrite(df: DataFrame, path: str) -> int:
    """Put new contents in place of a table, also when they were read from it.

    The new files get a folder of their own, and one small file that names the
    current folder is replaced at the end: no file is moved or copied, and a run
    that fails anywhere leaves the old contents in place. The old files stay until
    the next rewrite, readable as the previous ones: queries that run, and
    DataFrames not read yet, still name them.
    """
    version = new_version(path)
    rows = write_table(df, version)
    switch(df.sparkSession, path, version)
    return rows


def new_version(path: str) -> str:
    return f"{path}__v{uuid.uuid4().hex}"


def switch(spark: SparkSession, path: str, version: str) -> None:
    """Make a complete folder the current contents of the table at ``path``, and those before it the previous ones."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    before = versions(spark, path)
    pointer, draft = hadoop.Path(f"{path}__current"), hadoop.Path(f"{version}__pointer")
    stream = pointer.getFileSystem(conf).create(draft, True)
    stream.write("\n".join([version, *before[:1]]).encode())
    stream.close()
    kind = getattr(hadoop, "Options$Rename")
    overwrite = spark._sc._gateway.new_array(kind, 1)
    overwrite[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(pointer.getFileSystem(conf).getUri(), conf).rename(draft, pointer, overwrite)
    for old in before[1:]:
        remove(spark, old)


def rewrite_days(df: DataFrame, path: str, days: Sequence) -> int:
    """Put new rows in place of some days of a table, also when they were read from it; other days' files stay.

    ``df`` must hold all rows of these days and no others; None is the folder of
    rows without a day. The new files are complete in a folder of their own before
    the table is touched, so a run that fails in between is repeated from there
    (``replace_days``) rather than from the table.
    """
    staged = new_version(path)
    rows = write_table(df, staged)
    replace_days(df.sparkSession, path, staged, days)
    return rows


def replace_days(spark: SparkSession, path: str, staged: str, days: Sequence) -> None:
    """Second half of ``rewrite_days``; running it again changes nothing. Days that got no rows are removed."""
    current = versions(spark, path)[0]
    new = spark.read.schema(spark.read.parquet(current).schema).parquet(staged)
    new = new.hint("rebalance", PARTITION_COLUMN)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION_COLUMN).parquet(current)
    kept = {row[0] for row in new.select(PARTITION_COLUMN).distinct().collect()}
    for day in set(days) - kept:
        remove(spark, f"{current}/{PARTITION_COLUMN}={'__HIVE_DEFAULT_PARTITION__' if day is None else day}")
    remove(spark, staged)


def of_days(df: DataFrame, days: Sequence) -> DataFrame:
    """Rows of these days (None: without one); the scan reads no other folder."""
    wanted = F.col(PARTITION_COLUMN).isin([d for d in days if d is not None])
    return df.where(wanted | F.col(PARTITION_COLUMN).isNull() if None in days else wanted)


def _complete(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def insert_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Incoming rows whose key is free; of several with one key the first in ``order`` stays.

    Append the result to the table. Running it twice adds nothing. Rows without a
    whole key cannot be told apart and are left to ``incomplete_keys``. Of the table
    only the keys are read, and only those that the incoming ones may hold are
    shuffled.
    """
    keyed = incoming.where(_complete(keys))
    held = key_bits.may_match(existing.select(*keys), keyed, keys)
    return last_per_key(keyed, keys, order).join(held, list(keys), "left_anti")


def incomplete_keys(incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that ``insert_new`` sets aside: a part of their key is missing."""
    return incoming.where(~_complete(keys))


def accepted(checked: DataFrame) -> DataFrame:
    """Clean rows of ``cleaning.with_rejections``."""
    return checked.where(F.col("rejected") == "").drop("source", "rejected")


def quarantined(checked: DataFrame) -> DataFrame:
    """Rejected rows as they were read, with the columns at fault."""
    return checked.where(F.col("rejected") != "").select("source.*", "rejected")
