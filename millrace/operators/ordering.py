"""Sorting, limits and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rows without explicit limit, hard cap, preview length.
DEFAULT_LIMIT = 100
ROW_CAP = 200
PREVIEW_ROWS = 20


def ascending(c: str) -> Column:
    """Missing values last, as the reports expect."""
    return F.asc_nulls_last(c)


def descending(c: str) -> Column:
    """Missing values first, as the reports expect."""
    return F.desc_nulls_first(c)


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """Each task keeps its own best ``n``; end ``order`` in a unique column."""
    return df.orderBy(*order).limit(n)


def any_rows(df: DataFrame, n: int = 3) -> DataFrame:
    """Some rows, in no particular order."""
    return df.limit(n)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, cap: int = ROW_CAP) -> dict:
    """First rows as JSON plus a notice on how many more there are; at most ``cap`` rows travel."""
    shown = [r.row for r in as_json(df.limit(cap)).collect()]
    more = len(shown) - rows
    notice = "no rows" if not shown else f"... and {more} more rows" if more > 0 else ""
    return {"rows": shown[:rows], "row_count": len(shown), "notice": notice}


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text in column ``row``; missing values are written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
