"""Columns computed once, when a table is cleaned, so that reports need not repeat them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import numeric, text
from millrace.operators import sequences
from millrace.operators.repair import UNIT_OF

# A shift has 480 minutes; limits of travel and of reliable speed.
SHIFT_MINUTES = 480
TRAVEL_LIMIT_MM = 100_000
RELIABLE_SPEED_SECONDS = 5

# Constant alarm limits per sensor (high, low).
THRESHOLDS = {"weld_cur": (270.0, 220.0), "weld_volt": (30.0, 20.0), "weld_gas": (30.0, 20.0)}

# The numeric spelling of the deviation flags.
FLAG_NAMES = {"0": "none", "1": "single", "2": "sustained"}

MINUTE_COLUMNS = ("active", "idle", "inrepair", "breakdown")


def accounted_minutes(columns: Sequence[str] = MINUTE_COLUMNS) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total


def allocation_valid(total: Column | str, idle: Column | str, shift_minutes: int = SHIFT_MINUTES) -> Column:
    """Times fit into the shift and none is negative. The documented data admits
    either half of this rule alone; both must hold here."""
    return (text.col(total) <= shift_minutes) & (text.col(idle) >= 0)


def efficiencies() -> dict[str, Column]:
    return {
        "arc_efficiency_pct": numeric.row_percent(F.col("active"), F.col("target_arc_time")),
        "deposit_efficiency_pct": numeric.row_percent(F.col("deposit"), F.col("target_deposit")),
    }


def derive_work_periods(df: DataFrame) -> DataFrame:
    """Totals, validity and efficiencies of the machine × shift × period fact."""
    return (
        df.withColumn("total_accounted_minutes", accounted_minutes())
        .withColumn("time_allocation_valid", allocation_valid("total_accounted_minutes", "idle"))
        .withColumns(efficiencies())
    )


def torch_position(pair: Column | str) -> dict[str, Column]:
    return {"position_x": text.first_of_pair(pair), "position_y": text.second_of_pair(pair)}


def travel_outlier(travel_mm: Column | str, limit: float = TRAVEL_LIMIT_MM) -> Column:
    return text.col(travel_mm) > limit


def speed_unreliable(seconds: Column | str, limit: float = RELIABLE_SPEED_SECONDS) -> Column:
    return text.col(seconds) < limit


def below_detection(reading: Column | str) -> Column:
    """A meter at zero is below its resolution; consumption may still be positive."""
    return text.col(reading) == 0


def recorded(reading: Column | str) -> Column:
    return text.col(reading).isNotNull()


def sum_of_meters(*meters: Column | str, missing_as_zero: bool = False) -> Column:
    cells = [F.coalesce(text.col(m), F.lit(0.0)) if missing_as_zero else text.col(m) for m in meters]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return total


def deviation_label(parameter: Column | str, direction: Column | str) -> Column:
    return F.concat(text.col(parameter), F.lit("_"), text.col(direction))


def is_idle(current: Column | str) -> Column:
    return text.col(current) == 0


def is_welding(current: Column | str) -> Column:
    return text.col(current) != 0


def flag_name(flag: Column | str) -> Column:
    """``0/1/2`` to ``none/single/sustained``; other texts stay."""
    return F.coalesce(text.lookup(flag, FLAG_NAMES), text.col(flag))


def flag_digit(flag: Column | str) -> Column:
    return F.coalesce(text.lookup(flag, {v: k for k, v in FLAG_NAMES.items()}), text.col(flag))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed seconds, fractions included."""
    micros = F.timestamp_diff("MICROSECOND", text.col(start), text.col(end))
    return micros / F.lit(1_000_000.0)


def range_label(value: Column | str, low: float | Column, high: float | Column, very_high: float | Column) -> Column:
    """zero / low / normal / high / very_high. The cut points are not documented
    anywhere, hence arguments without defaults."""
    v = text.col(value)
    return (
        F.when(v == 0, "zero")
        .when(v < low, "low")
        .when(v <= high, "normal")
        .when(v <= very_high, "high")
        .when(v.isNotNull(), "very_high")
    )


# Cut points of a range: low below the first share of the weight, high above the second, very high above the third.
CUT_RANKS = {"low": 0.1, "high": 0.9, "very_high": 0.99}
CUT_ERROR = 0.01


def value_bins(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None, error: float = CUT_ERROR) -> DataFrame:
    """``weight`` (of rows, or of a column) per group in ``by`` and ``bin`` of the positive values.

    Bins grow by a constant factor, so a bin's middle is within ``error`` of every
    value in it, and doubles have some 1,400 / ``error`` / 2 bins at most. Weights
    are added as decimals: bins of parts of a table can be stored and added up.
    Rows without a value, value 0 and below, and weights that are no positive
    number teach nothing.
    """
    factor = math.log((1 + error) / (1 - error))
    heavy = F.lit(1) if weight is None else F.col(weight)
    v, w = F.col(value).cast("double"), heavy.cast("double")
    usual = (v > 0) & (v < float("inf")) & (w > 0) & (w < float("inf"))
    bins = df.where(usual).select(*by, F.ceil(F.log(v) / factor).cast("int").alias("bin"), w.cast("decimal(24,6)").alias("weight"))
    return bins.groupBy(*by, "bin").agg(F.sum("weight").alias("weight"))


def range_cuts(bins: DataFrame, by: Sequence[str], ranks: Mapping[str, float] = CUT_RANKS, error: float = CUT_ERROR) -> DataFrame:
    """Cut points per group in ``by`` from ``value_bins`` of any number of parts, a column for each of ``ranks``.

    Each is within ``error`` of the smallest value at which the weight of all
    values up to it reaches the rank's share. A window holds the bins of one group.
    """
    gamma = (1 + error) / (1 - error)
    whole = bins.groupBy(*by, "bin").agg(F.sum("weight").alias("weight"))
    group = Window.partitionBy(*by)
    upto = F.sum("weight").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = whole.select(*by, "bin", upto.alias("upto"), F.sum("weight").over(group).alias("total"))

    def cut(rank: float) -> Column:
        least = F.min(F.when(F.col("upto") >= F.col("total") * F.lit(str(rank)).cast("decimal(10,9)"), F.col("bin")))
        return F.pow(F.lit(gamma), least) * (2 / (gamma + 1))

    return reached.groupBy(*by).agg(*[cut(rank).alias(name) for name, rank in ranks.items()])


def with_range(df: DataFrame, cuts: DataFrame, by: Sequence[str], value: str, label: str) -> DataFrame:
    """``df`` with the range of ``value`` by its group's cut points (``low``, ``high``, ``very_high``); NULL where a group has none."""
    named = cuts.select(*by, *[F.col(c).alias(f"__{c}") for c in CUT_RANKS])
    limits = [F.col(f"__{c}") for c in CUT_RANKS]
    known = df.join(named, list(by), "left").withColumn(label, F.when(limits[0].isNotNull(), range_label(value, *limits)))
    return known.drop(*[f"__{c}" for c in CUT_RANKS])


def shift_of(moment: Column | str, starts: Sequence[tuple[str, int]] = (("A", 6), ("B", 14), ("C", 22))) -> Column:
    """Shift by hour of day. The clock boundaries are an assumption and therefore a parameter."""
    hour = F.hour(text.col(moment))
    ordered = sorted(starts, key=lambda s: s[1])
    label = F.lit(ordered[-1][0])
    for name, start in ordered:
        label = F.when(hour >= start, name).otherwise(label)
    return label


def deviation_events(df: DataFrame, keys: Sequence[str], order: Sequence[str], parameters: Sequence[str] = tuple(THRESHOLDS), chunk: Column | None = None, most_rows: int | None = None) -> DataFrame:
    """One row per deviation event: consecutive readings of a machine beyond the same limit of a parameter.

    Columns: ``keys``, ``parameter``, ``type`` (high or low), ``deviation_label``,
    ``start_tm``, ``end_tm``, ``span_seconds`` (0 for a single reading),
    ``readings``, ``worst`` (the reading furthest beyond the limit's side) and
    ``flag`` (single or sustained). A reading within its limits, or beyond the
    other one, ends an event; a missing reading, or one without limits, neither
    ends nor extends it. Readings without a time are left out.
    """
    present = df.where(F.col(order[0]).isNotNull())
    long = present.select(*keys, *order, F.inline(_parameter_cells(parameters)))
    above, below = F.col("reading") > F.col("high"), F.col("reading") < F.col("low")
    known = F.col("reading").isNotNull() & (F.col("high").isNotNull() | F.col("low").isNotNull())
    long = long.withColumn("type", F.when(above, "high").when(below, "low").when(known, "none"))
    found = sequences.runs(long, [*keys, "parameter"], order, "type", "reading", chunk, most_rows).where("type <> 'none'")
    return found.select(
        *keys,
        "parameter",
        "type",
        deviation_label("parameter", "type").alias("deviation_label"),
        F.col("start").alias("start_tm"),
        F.col("end").alias("end_tm"),
        seconds_between("start", "end").alias("span_seconds"),
        "readings",
        F.when(F.col("type") == "high", F.col("highest")).otherwise(F.col("lowest")).alias("worst"),
        F.when(F.col("readings") > 1, FLAG_NAMES["2"]).otherwise(FLAG_NAMES["1"]).alias("flag"),
    )


def _parameter_cells(parameters: Sequence[str]) -> Column:
    """The parameters of a row as an array: name, unit, reading and limits."""
    return F.array(
        *[
            F.struct(
                F.lit(p).alias("parameter"),
                F.lit(UNIT_OF.get(p)).cast("string").alias("parameter_unit"),
                F.col(p).cast("double").alias("reading"),
                F.col(f"high_{p}_threshold").cast("double").alias("high"),
                F.col(f"low_{p}_threshold").cast("double").alias("low"),
            )
            for p in parameters
        ]
    )


def threshold_breaches(
    df: DataFrame,
    parameters: Sequence[str] = tuple(THRESHOLDS),
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per reading above its high or below its low limit.

    The parameters of a row are unnested and filtered, so the input is read once
    and everything stays inside generated code.
    """
    above, below = F.col("reading") > F.col("high"), F.col("reading") < F.col("low")
    return (
        df.select(*keep, F.inline(_parameter_cells(parameters)))
        .where(above | below)
        .withColumn("type", F.when(above, "high").otherwise("low"))
        .withColumn("deviation_label", deviation_label("parameter", "type"))
        .drop("high", "low")
    )
