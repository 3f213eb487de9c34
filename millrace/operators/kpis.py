"""Aggregates behind the plant's reports.

Each is a single ``groupBy`` over pruned columns. Sums, counts, minima and
maxima are combined map-side, so a machine with a third of all rows reaches the
reducer as one row per task. Averages are always built from rows, never from
averages of finer groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions.numeric import count_where, mean, percent, total
from millrace.operators.filters import is_valid, valid_rows
from millrace.operators.states import Measure, aggregate
from millrace.sources import schemas

SHIFT_KEYS = ("business_date", "shift_name", "machine_name")
DEVIATION_KEYS = (
    "machine_type", "machine_name", "parameter", "parameter_unit", "deviation_direction", "deviation_label",
)

# Flags that report no deviation, in both spellings.
QUIET_FLAGS = ("none", "0")


def _deviating(flag: str, quiet: Sequence[str]) -> Column:
    return count_where(~F.col(flag).isin(*quiet))


def sensor_measures(quiet: Sequence[str] = QUIET_FLAGS) -> list[Measure]:
    """Averages of six sensors and counts of deviating flags, of welding samples."""
    averages = {
        "avg_weld_cur_a": "weld_cur", "avg_weld_volt_v": "weld_volt", "avg_weld_gas_lmin": "weld_gas",
        "avg_hs_temp_c": "hs_temp", "avg_amb_temp_c": "amb_temp", "avg_rpm": "rpm",
    }
    flags = ("current", "voltage", "gas")
    return [
        Measure("sample_count", "count"),
        *[Measure(name, "mean", F.col(c)) for name, c in averages.items()],
        *[Measure(f"{f}_deviation_events", "count", ~F.col(f"{f}_deviation_flag").isin(*quiet)) for f in flags],
    ]


def deviation_measures() -> list[Measure]:
    """Frequency and duration of deviation events."""
    return [
        Measure("event_count", "count"),
        Measure("avg_duration_seconds", "mean", F.col("span_seconds"), 1),
        Measure("total_duration_minutes", "total", F.col("span_seconds"), 1, divisor=60),
        Measure("first_occurrence", "min", F.col("start_tm")),
        Measure("last_occurrence", "max", F.col("start_tm")),
    ]


def cutting_measures() -> list[Measure]:
    """Counts, averages and consumption of valid cuts."""
    return [
        Measure("total_cuts", "count"),
        Measure("cuts_with_thickness", "count", F.col("thickness_recorded")),
        Measure("avg_cut_speed_mm_per_min", "mean", F.when(F.col("speed_valid"), F.col("mm_per_min"))),
        Measure("avg_thickness_mm", "mean", F.when(F.col("thickness_recorded"), F.col("thickness"))),
        Measure("total_travel_metres", "total", F.col("net_travel_in_mm"), divisor=1000),
        Measure("total_lpg_litres", "total", F.when(~F.col("lpg_below_detection"), F.col("net_lpg_consumption"))),
        Measure("total_o2_litres", "total", F.col("total_o2_consumption")),
    ]


def session_measures() -> list[Measure]:
    """All sessions are counted, measures come from the valid ones."""
    valid = is_valid(schemas.SUMMARY_CLAD)
    return [
        Measure("total_sessions", "count"),
        Measure("valid_sessions", "count", valid),
        Measure("avg_current_a", "mean", F.when(valid, F.col("avg_weld_cur"))),
        Measure("avg_voltage_v", "mean", F.when(valid, F.col("avg_weld_volt"))),
        Measure("total_loss_weight_grams", "total", F.when(valid, F.col("loss_weight"))),
        Measure("total_arc_time_minutes", "total", F.when(valid, F.col("time_span_seconds")), 1, divisor=60),
    ]


def sensor_averages(
    periodic: DataFrame, keys: Sequence[str] = SHIFT_KEYS, quiet: Sequence[str] = QUIET_FLAGS
) -> DataFrame:
    """Welding samples only: averages of six sensors and counts of deviating flags."""
    return aggregate(valid_rows(periodic, schemas.PERIODIC_GMAW), keys, sensor_measures(quiet))


def deviation_summary(deviations: DataFrame) -> DataFrame:
    """Frequency and duration per kind of deviation; missing keys form groups of their own."""
    return aggregate(deviations.withColumnRenamed("type", "deviation_direction"), DEVIATION_KEYS, deviation_measures())


def cutting_productivity(cuts: DataFrame, keys: Sequence[str] = SHIFT_KEYS) -> DataFrame:
    """Valid cuts only; a measure without a single usable row is NULL, not zero."""
    return aggregate(valid_rows(cuts, schemas.SUMMARY_GASCUTTING), keys, cutting_measures())


def session_summary(sessions: DataFrame, keys: Sequence[str] = SHIFT_KEYS) -> DataFrame:
    """All sessions are counted, measures come from the valid ones."""
    return aggregate(sessions, keys, session_measures())


def welding_averages(
    periodic: DataFrame, keys: Sequence[str] = ("machine_name",), places: int = 1
) -> DataFrame:
    """Current and voltage during welding, by machine or by machine and shift."""
    return (
        valid_rows(periodic, schemas.PERIODIC_GMAW)
        .groupBy(*keys)
        .agg(
            mean("weld_cur", places).alias("avg_weld_cur_A"),
            mean("weld_volt", places).alias("avg_weld_volt_V"),
            F.count("*").alias("readings"),
        )
    )


def session_counts(sessions: DataFrame) -> DataFrame:
    """Valid sessions and their current per machine; machines without any stay with 0."""
    valid = is_valid(schemas.SUMMARY_CLAD)
    return sessions.groupBy("machine_name").agg(
        count_where(valid).alias("valid_sessions"),
        mean(F.when(valid, F.col("avg_weld_cur")), 1).alias("avg_cur_A"),
    )


def cutting_speed_by_shift(cuts: DataFrame) -> DataFrame:
    return (
        valid_rows(cuts, schemas.SUMMARY_GASCUTTING)
        .where("speed_valid")
        .groupBy("shift_name")
        .agg(
            F.count("*").alias("cuts"),
            mean("mm_per_min", 1).alias("avg_speed_mm_per_min"),
            mean("thickness", 1).alias("avg_thickness_mm"),
        )
    )


def frequent_deviations(deviations: DataFrame, machine_type: str = "GMAW", top: int = 5) -> DataFrame:
    """Most frequent labels; ties are broken by name so that a rerun gives the same list."""
    return (
        deviations.where(F.col("machine_type") == machine_type)
        .groupBy("deviation_label", "parameter_unit")
        .agg(F.count("*").alias("events"), mean("span_seconds", 1).alias("avg_span_s"))
        .orderBy(F.desc("events"), "deviation_label", "parameter_unit")
        .limit(top)
    )


def session_means(sessions: DataFrame, keys: Sequence[str] = ("machine_name", "shift_name")) -> DataFrame:
    valid = is_valid(schemas.SUMMARY_CLAD)
    weighed = valid & (F.col("loss_weight") > 0)
    return sessions.groupBy(*keys).agg(
        count_where(valid).alias("valid_sessions"),
        mean(F.when(valid, F.col("avg_weld_cur")), 2).alias("avg_cur_A"),
        mean(F.when(valid, F.col("avg_weld_volt")), 2).alias("avg_volt_V"),
        total(F.when(weighed, F.col("loss_weight")), 6).alias("total_loss_weight_g"),
    )


def cutting_by_shift(cuts: DataFrame) -> DataFrame:
    return (
        valid_rows(cuts, schemas.SUMMARY_GASCUTTING)
        .groupBy("shift_name")
        .agg(
            F.count("*").alias("cuts"),
            mean("mm_per_min", 1).alias("avg_speed_mm_per_min"),
            total("net_lpg_consumption", 2).alias("total_lpg_litres"),
            total("total_o2_consumption", 2).alias("total_o2_litres"),
            mean("thickness", 2).alias("avg_thickness_mm"),
        )
    )


def deviation_counts(deviations: DataFrame) -> DataFrame:
    return (
        deviations.groupBy("parameter", "parameter_unit")
        .agg(F.count("*").alias("events"))
        .orderBy(F.desc("events"), "parameter", "parameter_unit")
    )


def distribution(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Values and how often they occur; ``keep_null`` as SQL does, without it as ``value_counts``."""
    source = df if keep_null else df.where(F.col(column).isNotNull())
    return source.groupBy(column).agg(F.count("*").alias("rows"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, missing values and distinct values per column in one pass.

    Distinct values of several columns would multiply every row, so each cell is
    unnested to (column, value) and counted; the partial count collapses repeats
    before the shuffle.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns])
    values = df.select(F.inline(cells)).groupBy("column_name", "v").agg(F.count("*").alias("n"))
    return values.groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0).cast("bigint")).alias("null_rows"),
        F.count("v").alias("distinct_values"),
    )


# Sketches: 2**12 registers for distinct values (standard error 1.6 %), size parameter
# 200 for quantiles (rank error 1.7 % with 99 % confidence).
DISTINCT_BITS, QUANTILE_SIZE = 12, 200


def column_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group in ``by`` and column: ``rows``, ``null_rows`` and sketches that can be stored and merged.

    ``distinct_sketch`` (of the values as text) and, for numbers, ``quantile_sketch``
    (NULL without one) are built map-side in one pass over all columns, so only
    sketches are shuffled, some kilobytes a column and task. NaN has no place
    among the quantiles. An empty table has a row per column only without ``by``.
    """
    aggregates, cells = [], []
    for i, c in enumerate(columns):
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        value = F.col(c).cast("double")
        ranked = F.when(~F.isnan(value), value) if numeric else F.lit(None).cast("double")
        aggregates += [
            F.count(F.col(c)).alias(f"_n{i}"),
            F.hll_sketch_agg(F.col(c).cast("string"), DISTINCT_BITS).alias(f"_d{i}"),
            F.count(ranked).alias(f"_q_n{i}"),
            F.kll_sketch_agg_double(ranked, QUANTILE_SIZE).alias(f"_q{i}"),
        ]
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("_rows").alias("rows"),
                (F.col("_rows") - F.col(f"_n{i}")).alias("null_rows"),
                F.col(f"_d{i}").alias("distinct_sketch"),
                F.when(F.col(f"_q_n{i}") > 0, F.col(f"_q{i}")).alias("quantile_sketch"),
            )
        )
    whole = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    return whole.select(*by, F.inline(F.array(*cells)))


def sketched_profile(sketches: DataFrame, ranks: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Profile per column from sketches of any number of parts: exact ``rows`` and ``null_rows``,
    estimated ``distinct_values`` and ``quantiles`` at ``ranks`` (NULL for columns that are no numbers)."""
    merged = sketches.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        F.sum("null_rows").alias("null_rows"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_values"),
        F.count("quantile_sketch").alias("_some"),
        F.kll_merge_agg_double("quantile_sketch").alias("_quantiles"),
    )
    at = F.kll_sketch_get_quantile_double("_quantiles", F.array(*[F.lit(float(r)) for r in ranks]))
    return merged.withColumn("quantiles", F.when(F.col("_some") > 0, at)).drop("_some", "_quantiles")


def row_count(df: DataFrame, condition: Column | None = None) -> DataFrame:
    source = df if condition is None else df.where(condition)
    return source.agg(F.count("*").alias("rows"))


def session_efficiency(sessions: DataFrame, keys: Sequence[str] = ("machine_name",)) -> DataFrame:
    """Share of valid sessions in percent, from counts."""
    return (
        sessions.groupBy(*keys)
        .agg(
            F.count("*").alias("total_sessions"),
            count_where(is_valid(schemas.SUMMARY_CLAD)).alias("valid_sessions"),
        )
        .withColumn("clad_efficiency_pct", percent(F.col("valid_sessions"), F.col("total_sessions")))
    )


def chart_feed(deviations: DataFrame) -> DataFrame:
    """Bar chart input under the names the front end reads."""
    return deviations.groupBy(F.col("parameter").alias("PARAMETER_TYPE")).agg(F.count("*").alias("COUNT"))


def counter_span(df: DataFrame, keys: Sequence[str], counter: str) -> DataFrame:
    """Consumption from a running counter that is never reset within the key: last minus first."""
    return df.groupBy(*keys).agg((F.max(counter) - F.min(counter)).alias("consumption"))
