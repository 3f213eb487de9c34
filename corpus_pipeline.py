"""Corpus pipeline over ``documents``: language, near duplicates, benchmark items, source mix, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import decontamination, jaccard_join, language_id, source_mixing, token_output
from millrace.llm.shared import held_out, plain_reads, small_batches, stored, table, tokenizer_path

# A text that costs this many bits a byte is not shortened by any language's statistics.
MOST_BITS_PER_BYTE = 8.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what has no letter and what no learned language explains better than bytes at random; learns from ``docs``."""
    # What this stage returns runs whole rows through Python when it is written.
    small_batches(spark)
    plain_reads(spark)
    model = language_id.learn(docs.where(~held_out()))
    # Whole rows in one column: whatever else they hold cannot clash with the verdict.
    rows = docs.select(F.struct("*").alias("row"), "text")
    judged = language_id.predict(rows, model, ["row"])
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("bits_per_byte") < MOST_BITS_PER_BYTE)).select("row.*")


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, that with the smallest number; texts without words stay all."""
    plain_reads(spark)
    return jaccard_join.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    plain_reads(spark)
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    plain_reads(spark)
    return source_mixing.repeat_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and the place of each document in them."""
    plain_reads(spark)
    # Workers that run the other stages too hold more: texts go in shorter runs, fewer words are remembered, and none when a task ends.
    path = tokenizer_path("word_bpe_49k.json")
    return token_output.encode_documents(docs, path, end_id=2, remembered=100_000, forget=True, run_bytes=1 << 20)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_files),
]

# Stages 1, 2, 3 and 5 have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
