"""Operators that depend on row order within a key.

A plain window puts all rows of a key into one task. Here one key may hold a
third of the data, so the order-dependent operators work on chunks: the days of
the order column (spans of numbers where it is one), which cut long keys into
consecutive pieces that anyone can compute alike. The window runs inside each
(key, chunk); what earlier chunks of a key hand over comes from one summary row
per (key, chunk), pre-aggregated map-side. Rows are shuffled once. The result
equals that of the plain window for every input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from millrace.functions.numeric import exact_sum, round_half_up
from millrace.operators.repair import last_per_key

CHUNK, CARRIED = "_chunk", "_carried"

# Quantiles that long chunks are cut at; rows a chunk should hold where that is asked for.
QUANTILES, CHUNK_ROWS = 1000, 1 << 17

# Numbers per chunk where the order column is a number.
NUMBERS = 128

# Messages kept per session and messages handed to the model.
SESSION_LENGTH = 40
CONTEXT_LENGTH = 16


def tail(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = SESSION_LENGTH) -> DataFrame:
    """Last ``n`` rows of each key. Each task keeps at most ``n`` per key before the
    shuffle, so long keys are harmless."""
    newest = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= n).drop("_age")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return last_per_key(df, keys, [F.desc_nulls_last(c) for c in order])


def in_chunks(
    df: DataFrame, order: Sequence[str], chunk: Column | None = None, keys: Sequence[str] = (), most_rows: int | None = None
) -> DataFrame:
    """Add a chunk that rises with the first order column: its day, or the span a number lies in.

    Pass ``chunk`` to cut otherwise; it must never fall as the order rises. With
    ``most_rows`` the chunks of a key that hold more are cut at quantiles into
    parts of about so many rows, wherever the rows of a day crowd; only rows with
    the same value of the first order column stay together.
    """
    if chunk is None:
        first = F.col(order[0])
        numeric = isinstance(df.schema[order[0]].dataType, T.NumericType)
        chunk = F.floor(first / NUMBERS) if numeric else F.to_date(first)
    rows = df.withColumn(CHUNK, chunk)
    return rows if most_rows is None else _cut_long_chunks(rows, keys, order[0], most_rows)


def _cut_long_chunks(rows: DataFrame, keys: Sequence[str], first: str, most_rows: int) -> DataFrame:
    """Two passes over keys and order before the rows are shuffled: counts, and quantiles of long chunks only."""
    kind = rows.schema[first].dataType
    place = F.col(first) if isinstance(kind, T.NumericType) else F.unix_micros(F.col(first).cast("timestamp"))
    by = [*keys, CHUNK]
    names = [f"_of_{i}" for i in range(len(by))]

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[n]) for c, n in zip(by, names)])

    narrow = rows.select(*by, place.alias("_place"))
    long = narrow.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)]).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most_rows)
    crowded = narrow.join(long, same(narrow, long)).where("_place IS NOT NULL")
    grid = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    cuts = crowded.groupBy(*names).agg(F.max("_rows").alias("_rows"), F.percentile_approx("_place", grid, 10 * QUANTILES).alias("_grid"))
    # Every so many quantiles one cut; a value that fills several quantiles is cut once.
    every = F.greatest(F.floor(F.lit(QUANTILES * most_rows) / F.col("_rows")), F.lit(1))
    cuts = cuts.select(*names, F.array_distinct(F.filter("_grid", lambda _, i: (i + 1) % every == 0)).alias("_cuts"))
    placed = rows.join(cuts, same(rows, cuts), "left")
    part = F.coalesce(F.size(F.filter("_cuts", lambda cut: cut <= place)), F.lit(0))
    return placed.withColumn(CHUNK, F.struct(F.col(CHUNK).alias("chunk"), part.alias("part"))).drop(*names, "_cuts")


def _inside(keys: Sequence[str], order: Sequence[str]) -> W:
    return W.partitionBy(*keys, CHUNK).orderBy(*order)


def _across(keys: Sequence[str]) -> W:
    return W.partitionBy(*keys).orderBy(CHUNK)


def _step(previous: Column, current: Column) -> Column:
    """Increase of a counter; a fall means it restarted from zero."""
    return F.when(current >= previous, current - previous).otherwise(current)


def counter_consumption(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    counter: str,
    places: int = 2,
    chunk: Column | None = None,
    most_rows: int | None = None,
) -> DataFrame:
    """Consumption per key from a running counter with restarts.

    One pass: steps inside a chunk are summed there, each (key, chunk) leaves its
    first and last reading, and a second, small window adds the steps between chunks.
    """
    readings = in_chunks(df.where(F.col(counter).isNotNull()), order, chunk, keys, most_rows)
    readings = readings.select(*dict.fromkeys([*keys, *order, counter, CHUNK]))
    inside = _inside(keys, order)
    value = F.col(counter)
    steps = readings.select(
        *keys,
        CHUNK,
        value,
        F.lag(counter).over(inside).alias("before"),
        F.row_number().over(inside).alias("place"),
        F.lead(F.lit(True), 1, False).over(inside).alias("followed"),
    )
    chunks = steps.groupBy(*keys, CHUNK).agg(
        F.count("*").alias("n"),
        exact_sum(F.when(F.col("place") > 1, _step(F.col("before"), value))).alias("inner"),
        F.max(F.when(F.col("place") == 1, value)).alias("first"),
        F.max(F.when(~F.col("followed"), value)).alias("last"),
    )
    before = F.lag("last").over(_across(keys))
    linked = chunks.withColumn("link", F.when(before.isNotNull(), _step(before, F.col("first"))))
    consumed = F.coalesce(exact_sum("inner"), F.lit(0.0)) + F.coalesce(exact_sum("link"), F.lit(0.0))
    return linked.groupBy(*keys).agg(
        F.sum("n").alias("readings"), round_half_up(consumed, places).alias("consumption")
    )


def _with_carried(rows: DataFrame, carried: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, W]:
    """Rows with what earlier chunks hand over in front of them, and the window of the rows before each."""
    both = rows.withColumn(CARRIED, F.lit(False)).unionByName(carried.withColumn(CARRIED, F.lit(True)), allowMissingColumns=True)
    inside = W.partitionBy(*keys, CHUNK).orderBy(F.desc(CARRIED), *order)
    return both, inside.rowsBetween(W.unboundedPreceding, -1)


def counter_steps(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], counter: str, chunk: Column | None = None, most_rows: int | None = None
) -> DataFrame:
    """Every reading with its increase over the previous one (NULL for the first).
    Rows without a reading stay and are skipped when looking back."""
    rows = in_chunks(df, order, chunk, keys, most_rows)
    present = rows.where(F.col(counter).isNotNull())
    left = present.groupBy(*keys, CHUNK).agg(F.max_by(F.col(counter), F.struct(*order)).alias("left"))
    carried = left.select(*keys, CHUNK, F.lag("left").over(_across(keys)).alias(counter)).where(F.col(counter).isNotNull())
    both, earlier = _with_carried(rows, carried, keys, order)
    before = F.last(counter, True).over(earlier)
    return (
        both.withColumn("_before", before)
        .where(~F.col(CARRIED))
        .withColumn("step", F.when(F.col("_before").isNotNull(), _step(F.col("_before"), F.col(counter))))
        .drop("_before", CARRIED, CHUNK)
    )


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    state: str,
    value: str,
    chunk: Column | None = None,
    most_rows: int | None = None,
) -> DataFrame:
    """Consecutive rows of a key with the same ``state`` as one row: ``start`` and ``end`` (first order column),
    number of ``readings``, ``lowest`` and ``highest`` value.

    Rows without a state are skipped. Inside a chunk the runs follow from the
    difference of two row numbers. Only the first and the last run of a chunk can
    go on in another one, so two rows a chunk, whatever their number, decide what
    is joined across chunks.
    """
    rows = in_chunks(df.where(F.col(state).isNotNull()), order, chunk, keys, most_rows)
    first = F.col(order[0])
    whole, same = _inside(keys, order), W.partitionBy(*keys, CHUNK, state).orderBy(*order)
    numbered = rows.withColumn("_place", F.row_number().over(whole)).withColumn("_followed", F.lead(F.lit(True), 1, False).over(whole))
    numbered = numbered.withColumn("_run", F.col("_place") - F.row_number().over(same))
    parts = numbered.groupBy(*keys, CHUNK, state, "_run").agg(
        F.min(first).alias("start"),
        F.max(first).alias("end"),
        F.count("*").alias("readings"),
        (F.min("_place") == 1).alias("_opens"),
        (~F.bool_and("_followed")).alias("_closes"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )
    inner = parts.where(~F.col("_opens") & ~F.col("_closes"))
    # Of two runs at the border of the same chunk the one that opens it comes first.
    along = W.partitionBy(*keys).orderBy(CHUNK, F.desc("_opens"))
    border = parts.where(F.col("_opens") | F.col("_closes"))
    continued = (F.lag(state).over(along) == F.col(state)) & (F.lag(CHUNK).over(along) < F.col(CHUNK)) & F.col("_opens")
    border = border.withColumn("_new", F.when(F.coalesce(continued, F.lit(False)), 0).otherwise(1))
    border = border.withColumn("_event", F.sum("_new").over(along))
    folds = {"start": F.min, "end": F.max, "readings": F.sum, "lowest": F.min, "highest": F.max}
    joined = border.groupBy(*keys, state, "_event").agg(*[fold(name).alias(name) for name, fold in folds.items()])
    return inner.select(*keys, state, *folds).unionByName(joined.select(*keys, state, *folds))


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    alias: str,
    chunk: Column | None = None,
    most_rows: int | None = None,
) -> DataFrame:
    """Largest non-null ``value`` among the earlier rows of the key.

    For a value that grows with the order, such as the time of an event, that is
    the most recent one.
    """
    rows = in_chunks(df, order, chunk, keys, most_rows).withColumn("_value", value)
    left = rows.groupBy(*keys, CHUNK).agg(F.max("_value").alias("left"))
    earlier_chunks = _across(keys).rowsBetween(W.unboundedPreceding, -1)
    carried = left.select(*keys, CHUNK, F.max("left").over(earlier_chunks).alias("_value")).where("_value IS NOT NULL")
    both, earlier = _with_carried(rows, carried, keys, order)
    return both.withColumn(alias, F.max("_value").over(earlier)).where(~F.col(CARRIED)).drop("_value", CARRIED, CHUNK)
