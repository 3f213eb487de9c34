"""Catalogue of operational questions as parameterised queries.

"Today" is the latest business date of the table asked. Stored tables know their
days from the names of their folders, so the date is a constant and prunes the
scan before it starts; of a view, which may hold no row of the newest days, the
newest day with a row is looked for, a day at a time. Of other tables the date is
a scalar subquery. "Yesterday" is the day before it, "this week" the seven days
ending with it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.numeric import count_where, mean, percent, total
from millrace.operators import filters, kpis, ordering
from millrace.operators.filters import plausible_efficiency, valid_rows
from millrace.plans.views import Tables, view
from millrace.session import PLANT_TIME_ZONE
from millrace.sources import schemas
from millrace.sources.readers import with_business_day

DAY = "business_date"


def latest_day(df: DataFrame, t: Tables | None = None, fact: str | None = None) -> Column:
    """The last business date present in ``df``, which is the table ``fact`` of ``t`` or made from its rows."""
    known = t.days(fact) if hasattr(t, "days") else None
    if known is None:
        return df.select(F.max(DAY)).scalar()
    whole = df is t[fact]
    newest = next((d for d in known if whole or not df.where(F.col(DAY) == F.lit(d)).select(DAY).isEmpty()), None)
    return F.lit(newest).cast("date")


def on_day(df: DataFrame, t: Tables | None = None, fact: str | None = None, days_back: int = 0) -> DataFrame:
    return df.where(F.col(DAY) == F.date_sub(latest_day(df, t, fact), days_back))


def last_days(df: DataFrame, days: int = 7, t: Tables | None = None, fact: str | None = None) -> DataFrame:
    last = latest_day(df, t, fact)
    return df.where((F.col(DAY) > F.date_sub(last, days)) & (F.col(DAY) <= last))


def last_shift(df: DataFrame, t: Tables | None = None, fact: str | None = None) -> DataFrame:
    """Rows of the latest shift of the latest day."""
    today = on_day(df, t, fact)
    shift = today.select(F.max("shift_name")).scalar()
    return today.where(F.col("shift_name") == shift)


def _efficiency(tables: Tables) -> DataFrame:
    return view("gmaw.v_gmaw_shift_efficiency", tables).where(plausible_efficiency())


def _average_efficiency(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        mean("arc_efficiency_pct", 2).alias("avg_arc_efficiency_pct"), F.count("*").alias("periods")
    )


def _lpg(df: DataFrame) -> DataFrame:
    return valid_rows(df, schemas.NONCUTTING)


def _with_day(deviations: DataFrame, zone: str | None) -> DataFrame:
    """The plant's calendar day, unless the table brings its own."""
    return deviations if DAY in deviations.columns else with_business_day(deviations, "start_tm", zone)


def efficiency_today(t: Tables) -> DataFrame:
    """Arc efficiency of all welding machines today."""
    return _average_efficiency(on_day(view("gmaw.v_gmaw_shift_efficiency", t), t, schemas.DERIVED_GMAW).where(plausible_efficiency()), "machine_name")


def lpg_by_shift(t: Tables) -> DataFrame:
    """Fuel gas by shift, from the heating passes where meters resolve it."""
    return _lpg(t[schemas.NONCUTTING]).groupBy("shift_name").agg(total("total_lpg_cons", 2).alias("total_lpg_litres"))


def lpg_by_shift_from_cuts(t: Tables) -> DataFrame:
    """The same from the cuts; most readings there are below detection."""
    cuts = valid_rows(t[schemas.SUMMARY_GASCUTTING], schemas.SUMMARY_GASCUTTING)
    return cuts.groupBy("shift_name").agg(total("net_lpg_consumption", 2).alias("total_lpg_litres"))


def sessions_this_week(t: Tables) -> DataFrame:
    """Cladding sessions by day, shift and machine this week."""
    return kpis.session_summary(last_days(t[schemas.SUMMARY_CLAD], t=t, fact=schemas.SUMMARY_CLAD))


def latest_deviations(t: Tables, n: int = ordering.DEFAULT_LIMIT, tie: tuple[str, ...] = ("hardware_id", "parameter")) -> DataFrame:
    """Most recent deviation events."""
    return ordering.top(t[schemas.DEVIATION], n, F.desc("start_tm"), *tie)


def cutting_productivity(t: Tables) -> DataFrame:
    return view("gascutting.v_gascutting_productivity", t)


def sensor_averages_by_machine(t: Tables) -> DataFrame:
    """Average current, voltage and gas per welding machine."""
    return (
        valid_rows(t[schemas.PERIODIC_GMAW], schemas.PERIODIC_GMAW)
        .groupBy("machine_name")
        .agg(
            F.count("*").alias("sample_count"),
            mean("weld_cur", 2).alias("avg_weld_cur_a"),
            mean("weld_volt", 2).alias("avg_weld_volt_v"),
            mean("weld_gas", 2).alias("avg_weld_gas_lmin"),
        )
    )


def efficiency_by_shift(t: Tables) -> DataFrame:
    return _average_efficiency(_efficiency(t), "shift_name")


def machine_readings(t: Tables, machine: str, n: int = ordering.DEFAULT_LIMIT) -> DataFrame:
    """First readings of one machine in time order."""
    rows = valid_rows(t[schemas.PERIODIC_GMAW], schemas.PERIODIC_GMAW).where(F.col("machine_name") == machine)
    return ordering.top(rows.select("pdid", "tm", "weld_cur", "weld_volt", "weld_gas"), n, "tm", "pdid")


def deviations_today(t: Tables, zone: str | None = PLANT_TIME_ZONE) -> DataFrame:
    """Events of the latest day in the plant's time zone, by label."""
    events = on_day(_with_day(t[schemas.DEVIATION], zone), t, schemas.DEVIATION)
    return events.groupBy(DAY, "deviation_label").agg(F.count("*").alias("events"))


def cutting_speed(t: Tables) -> DataFrame:
    return kpis.cutting_speed_by_shift(t[schemas.SUMMARY_GASCUTTING])


def cladding_means(t: Tables) -> DataFrame:
    """Current and voltage of valid cladding sessions."""
    return kpis.session_means(t[schemas.SUMMARY_CLAD]).drop("total_loss_weight_g")


def machine_current_today(t: Tables, machine: str) -> DataFrame:
    """Average welding current of one machine today, by shift."""
    today = on_day(t[schemas.PERIODIC_GMAW], t, schemas.PERIODIC_GMAW).where(F.col("machine_name") == machine)
    return (
        valid_rows(today, schemas.PERIODIC_GMAW)
        .groupBy(*kpis.SHIFT_KEYS)
        .agg(F.count("*").alias("sample_count"), mean("weld_cur", 2).alias("avg_weld_cur_a"))
    )


def best_machine_this_week(t: Tables) -> DataFrame:
    """Machine with the highest arc efficiency this week."""
    week = last_days(view("gmaw.v_gmaw_shift_efficiency", t), t=t, fact=schemas.DERIVED_GMAW).where(plausible_efficiency())
    return ordering.top(
        _average_efficiency(week, "machine_name"), 1, F.desc("avg_arc_efficiency_pct"), "machine_name"
    )


def machine_sessions_yesterday(t: Tables, machine: str) -> DataFrame:
    """Sessions of one rectifier on the day before the latest."""
    day = on_day(t[schemas.SUMMARY_CLAD], t, schemas.SUMMARY_CLAD, 1).where(F.col("machine_name") == machine)
    return kpis.session_summary(day)


def lpg_last_shift(t: Tables) -> DataFrame:
    """Fuel gas of the last shift."""
    return (
        _lpg(last_shift(t[schemas.NONCUTTING], t, schemas.NONCUTTING))
        .groupBy(DAY, "shift_name")
        .agg(total("total_lpg_cons", 2).alias("total_lpg_litres"))
    )


def welding_deviations(t: Tables, n: int = ordering.DEFAULT_LIMIT, tie: tuple[str, ...] = ("hardware_id", "parameter")) -> DataFrame:
    """Deviation events of the welding machines, earliest first."""
    return ordering.top(view("gmaw.fact_deviation_gmaw", t), n, "start_tm", *tie)


def efficiency_shift_a_b(t: Tables, machine: str | None = None) -> DataFrame:
    """Arc efficiency of shift A next to shift B."""
    rows = _efficiency(t)
    if machine is not None:
        rows = rows.where(F.col("machine_name") == machine)
    sides = [mean(F.when(F.col("shift_name") == s, F.col("arc_efficiency_pct")), 2).alias(f"shift_{s.lower()}") for s in "AB"]
    return rows.groupBy("machine_name").agg(*sides)


def shift_report_today(t: Tables, zone: str | None = PLANT_TIME_ZONE) -> DataFrame:
    """Key figures of the latest day of each table in long form."""
    shift = ["shift_name", "machine_name"]

    def figures(df: DataFrame, source: str, *names: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        return df.select(F.lit(source).alias("source"), *shift, F.inline(cells))

    welding = kpis.sensor_averages(on_day(t[schemas.PERIODIC_GMAW], t, schemas.PERIODIC_GMAW))
    cutting = kpis.cutting_productivity(on_day(t[schemas.SUMMARY_GASCUTTING], t, schemas.SUMMARY_GASCUTTING))
    cladding = kpis.session_summary(on_day(t[schemas.SUMMARY_CLAD], t, schemas.SUMMARY_CLAD))
    events = (
        on_day(_with_day(t[schemas.DEVIATION], zone), t, schemas.DEVIATION)
        .groupBy("machine_name")
        .agg(F.count("*").alias("event_count"), total("span_seconds", 1, divisor=60).alias("total_duration_minutes"))
        .withColumn("shift_name", F.lit(None).cast("string"))
    )
    return (
        figures(welding, "GMAW", "sample_count", "avg_weld_cur_a", "avg_weld_volt_v")
        .unionByName(figures(cutting, "GASCUTTING", "total_cuts", "total_travel_metres", "total_lpg_litres"))
        .unionByName(figures(cladding, "CLAD", "total_sessions", "valid_sessions", "avg_current_a"))
        .unionByName(figures(events, "DEVIATION", "event_count", "total_duration_minutes"))
    )


def high_voltage_machines(t: Tables) -> DataFrame:
    """Machines with deviations above the voltage limit."""
    high = t[schemas.DEVIATION].where(F.col("parameter").isin("voltage", "weld_volt") & (F.col("type") == "high"))
    return high.groupBy("machine_name").agg(F.count("*").alias("events"))


def cutting_compliance(t: Tables) -> DataFrame:
    """Share of cuts that pass the mandatory filters, by shift. The term is not
    defined anywhere; this is the reading chosen."""
    return (
        t[schemas.SUMMARY_GASCUTTING]
        .groupBy("shift_name")
        .agg(
            F.count("*").alias("total_cuts"),
            count_where(filters.is_valid(schemas.SUMMARY_GASCUTTING)).alias("valid_cuts"),
        )
        .withColumn("compliance_pct", percent(F.col("valid_cuts"), F.col("total_cuts")))
    )


def current_consumption(t: Tables) -> DataFrame:
    """Average current per machine family; current is never multiplied by time."""
    welding = valid_rows(t[schemas.PERIODIC_GMAW], schemas.PERIODIC_GMAW).select(
        F.lit("GMAW").alias("machine_type"), F.col("weld_cur").alias("amperes")
    )
    cladding = valid_rows(t[schemas.SUMMARY_CLAD], schemas.SUMMARY_CLAD).select(
        F.lit("CLAD").alias("machine_type"), F.col("avg_weld_cur").alias("amperes")
    )
    return (
        welding.unionByName(cladding)
        .groupBy("machine_type")
        .agg(mean("amperes", 2).alias("avg_current_a"), F.count("*").alias("rows"))
    )


QUESTIONS: Mapping[str, Callable[..., DataFrame]] = {
    "B1": efficiency_today,
    "B2": lpg_by_shift,
    "B3": sessions_this_week,
    "B4": latest_deviations,
    "B5": cutting_productivity,
    "B6": sensor_averages_by_machine,
    "B7": efficiency_by_shift,
    "B8": machine_readings,
    "B9": deviations_today,
    "B10": cutting_speed,
    "B11": cladding_means,
    "B12": machine_current_today,
    "B13": best_machine_this_week,
    "B14": machine_sessions_yesterday,
    "B15": lpg_last_shift,
    "B16": welding_deviations,
    "B17": efficiency_shift_a_b,
    "B18": shift_report_today,
    "B19": high_voltage_machines,
    "B20": cutting_compliance,
    "B21": current_consumption,
}


def ask(question: str, tables: Tables, **params) -> DataFrame:
    return QUESTIONS[question](tables, **params)
