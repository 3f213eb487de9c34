"""Filters on keys: one bit a key, so that rows which surely have no partner need no shuffle.

A filter is a small table of 64-bit words. However many keys it is built from, it
has at most ``BITS`` / 64 rows of two numbers (4 MB, some 16 MB as a hashed
relation), so it may always be broadcast. A key that was put in is always found;
others are found by chance, the more the fuller the filter is. Whatever it finds
is to be settled exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

BITS = 1 << 24
WORD, SET = "__word", "__set"


def _place(columns: Sequence[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITS))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))


def built(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """The filter on ``columns``: words that have a bit set, combined map-side."""
    place = F.col("place")
    words = df.select(_place(columns).alias("place")).groupBy(F.shiftright(place, 6).alias(WORD))
    return words.agg(F.bit_or(_bit(place)).alias(SET))


def marked(df: DataFrame, columns: Sequence[Column], bits: DataFrame, found: str) -> DataFrame:
    """``df`` with a boolean column ``found``: False for rows that are surely not in the filter."""
    place = _place(columns)
    names = [F.col(f"`{c}`") for c in df.columns]
    at = df.select(*names, F.shiftright(place, 6).alias(WORD), _bit(place).alias("__bit"))
    hit = F.coalesce(F.col(SET).bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    return at.join(F.broadcast(bits), WORD, "left").select(*names, hit.alias(found))


def comparable(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> bool:
    """Whether equal keys have equal hashes: the same types on both sides, and no collation of their own."""
    kinds = [(a.schema[k].dataType, b.schema[k].dataType) for k in keys]
    return all(x == y and (not isinstance(x, T.StringType) or x == T.StringType()) for x, y in kinds)


def may_match(df: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` without rows whose key surely is not among those of ``others``; all of it where hashes cannot be compared."""
    if not comparable(df, others, keys):
        return df
    columns = [F.col(k) for k in keys]
    return marked(df, columns, built(others, columns), "__found").where("__found").drop("__found")
