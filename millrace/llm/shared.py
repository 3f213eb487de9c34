"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.session import setting

LIBC = ctypes.CDLL(None)

# Rows whose crc32(doc_id as text) leaves this remainder are never learned from.
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows kept apart for evaluation."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % HELD_OUT_MODULUS == F.lit(
        HELD_OUT_REMAINDER
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session, as
    in tests, gets one of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        directory = spark.sparkContext.getCheckpointDir()
        base = directory.rsplit("/", 1)[0] if directory else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="millrace-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


# Shuffle files of a finished write serve nobody.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def write(df: DataFrame, path: str, rows: int = 1000, page_rows: int | None = None) -> None:
    """Write as Parquet, with ``rows`` whole texts at a time between Spark and Python.

    The shuffle files behind it go at once rather than when the driver collects garbage.
    Pages are compressed and read whole, outside the heap; ``page_rows`` keeps those of large rows small.
    """
    writer = df.write if page_rows is None else df.write.option("parquet.page.size.row.check.min", page_rows)
    with setting(df.sparkSession, DROP_SHUFFLES, "true"), setting(df.sparkSession, BATCH_ROWS, str(rows)):
        writer.parquet(path)


def stored(df: DataFrame, kept: list[str] | None = None, rows: int = 1000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The folder's name is added to ``kept``, for ``remove`` once nothing reads it any more.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    write(df, path, rows)
    if kept is not None:
        kept.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, kept: list[str]) -> None:
    """Delete stored folders; call it only when all that was computed from them is stored itself."""
    while kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(kept.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """So many whole texts at a time between Spark and Python, for the rest of the session."""
    spark.conf.set(BATCH_ROWS, str(rows))


def plain_reads(spark: SparkSession) -> None:
    """Columns are read in small pieces, for the rest of the session.

    A vectored read fetches a whole column of a row group into one buffer outside
    the heap, which the reading thread then keeps for as long as it lives.
    """
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a task unpacks at once.

    At the end freed memory goes back to the system: idle Python workers would
    otherwise keep it while the stages that follow need it.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of up to ``rows`` rows and ``size`` bytes, or as they come where they are larger.

    Batches that are small on their way keep Spark's buffers small, which it holds outside its heap.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) + batch.num_rows > rows or sum(b.nbytes for b in held) + batch.nbytes > size):
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)
    give_back()


def give_back() -> None:
    """Freed memory of this worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)
