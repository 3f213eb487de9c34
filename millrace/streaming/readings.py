"""Cleaning and shift averages on a stream of extract files.

The row-wise operators run on a stream as they are; the report needs a watermark
so that finished windows can be emitted and forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.numeric import mean
from millrace.operators import cleaning, filters
from millrace.sources import schemas, sinks
from millrace.sources.readers import CSV_FORM, SEPARATOR, SURPLUS


def stream_extracts(spark: SparkSession, folder: str, table: str, surplus: str = SURPLUS) -> DataFrame:
    """New CSV files of a folder as all-text rows in the table's column order.

    A file whose header is not the table's columns in their order is an error, so
    exchanged columns are never taken for each other; lines with more cells than
    the header are kept as text in ``surplus``.
    """
    names = [f.name for f in schemas.schema_of(table)]
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, surplus]])
    options = {"header": True, **CSV_FORM, "enforceSchema": False, "columnNameOfCorruptRecord": surplus}
    lines = spark.readStream.schema(text).options(**options).csv(folder)
    cells = F.size(F.split(F.col(surplus), SEPARATOR, -1))
    return lines.withColumn(surplus, F.when(cells > len(names), F.col(surplus)))


def stream_checked(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Typed rows with the verdict of the batch load."""
    return cleaning.with_rejections(stream_extracts(spark, folder, table), table, surplus=SURPLUS)


def stream_clean(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return sinks.accepted(stream_checked(spark, folder, table))


def load_new_files(
    spark: SparkSession, folder: str, table: str, target: str, checkpoint: str
) -> StreamingQuery:
    """Append every file not seen before to a stored table, then stop.

    Rejected rows go to ``<target>__rejected``. Each sink takes every row exactly
    once; the rejected ones are written before the returned query starts.
    """

    def append(rows: DataFrame, path: str, state: str, *days: str) -> StreamingQuery:
        writer = rows.writeStream.format("parquet").options(path=path, checkpointLocation=f"{checkpoint}/{state}")
        return writer.partitionBy(*days).trigger(availableNow=True).start()

    checked = stream_checked(spark, folder, table)
    append(sinks.quarantined(checked), f"{target}__rejected", "rejected").awaitTermination()
    good = sinks.accepted(checked)
    return append(good, target, "accepted", *sinks.partition_columns(good))


def welding_averages(
    readings: DataFrame, window: str = "8 hours", lateness: str = "10 minutes", start: str = "6 hours"
) -> DataFrame:
    """Average current and voltage per machine and window of welding time."""
    return (
        filters.valid_rows(readings, schemas.PERIODIC_GMAW)
        .withWatermark("tm", lateness)
        .groupBy(F.window("tm", window, window, start).alias("period"), "machine_name")
        .agg(
            F.count("*").alias("sample_count"),
            mean("weld_cur", 2).alias("avg_weld_cur_a"),
            mean("weld_volt", 2).alias("avg_weld_volt_v"),
        )
        .select("period.start", "period.end", "machine_name", "sample_count", "avg_weld_cur_a", "avg_weld_volt_v")
    )
