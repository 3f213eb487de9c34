"""Reports A1–A18, the views P2–P6, counters and sorted top lists."""

from pyspark.sql import functions as F

from millrace.operators import derive, filters, kpis, ordering, sequences
from millrace.plans import daily, testbed as tb
from millrace.plans.registered import ORACLES, query
from millrace.plans.testbed import sql_mean, sql_total, with_tables
from millrace.plans.views import view
from millrace.sources import schemas

KEYS = "business_date, shift_name, machine_name"


def _flagged(flag: str) -> str:
    return f"count(*) FILTER (WHERE {flag} NOT IN ('none', '0'))"


@query(
    "shift_sensor_averages",
    with_tables(
        "per",
        body=f"""SELECT {KEYS}, count(*) AS sample_count,
        {sql_mean('weld_cur', 2)} AS avg_weld_cur_a, {sql_mean('weld_volt', 2)} AS avg_weld_volt_v,
        {sql_mean('weld_gas', 2)} AS avg_weld_gas_lmin, {sql_mean('hs_temp', 2)} AS avg_hs_temp_c,
        {sql_mean('amb_temp', 2)} AS avg_amb_temp_c, {sql_mean('rpm', 2)} AS avg_rpm,
        {_flagged('current_deviation_flag')} AS current_deviation_events,
        {_flagged('voltage_deviation_flag')} AS voltage_deviation_events,
        {_flagged('gas_deviation_flag')} AS gas_deviation_events
        FROM per WHERE is_welding GROUP BY {KEYS}""",
    ),
)
def shift_sensor_averages(spark, sf):
    return kpis.sensor_averages(tb.periodic_gmaw(spark, sf))


@query("sensor_averages_kept_by_day", ORACLES["shift_sensor_averages"])
def sensor_averages_kept_by_day(spark, sf):
    """The view from stored states: all days computed once, the two newest again, merged on reading."""
    name = "gmaw.v_gmaw_sensor_averages"
    tables = tb.stored(spark, sf, schemas.PERIODIC_GMAW)
    daily.refresh(name, tables, tables.root)
    daily.refresh(name, tables, tables.root, tables.days(schemas.PERIODIC_GMAW)[:2])
    return daily.read(spark, name, tables.root)


@query(
    "deviation_events_long",
    with_tables(
        "dev",
        body="""SELECT event_id, hardware_id, parameter, type, reading, deviation_label, parameter_unit FROM dev""",
    ),
)
def deviation_events_long(spark, sf):
    readings = tb.periodic_gmaw(spark, sf)
    return derive.threshold_breaches(readings, keep=("event_id", "hardware_id"))


_SIDES = " UNION ALL ".join(
    f"""SELECT hardware_id, tm, event_id, '{p}' AS parameter, {p} AS reading,
    CASE WHEN {p} > {high} THEN 'high' WHEN {p} < {low} THEN 'low' WHEN {p} IS NOT NULL THEN 'none' END AS side FROM per"""
    for p, (high, low) in derive.THRESHOLDS.items()
)


@query(
    "deviation_events",
    with_tables(
        "per",
        body=f"""SELECT hardware_id, parameter, side AS type, parameter || '_' || side AS deviation_label, min(tm) AS start_tm, max(tm) AS end_tm,
        date_diff('microsecond', min(tm), max(tm)) / 1000000.0::DOUBLE AS span_seconds, count(*) AS readings,
        CASE WHEN side = 'high' THEN max(reading) ELSE min(reading) END AS worst,
        CASE WHEN count(*) > 1 THEN 'sustained' ELSE 'single' END AS flag
        FROM (SELECT *, sum(opens) OVER (PARTITION BY hardware_id, parameter ORDER BY tm, event_id) AS event
            FROM (SELECT *, CASE WHEN side = lag(side) OVER (PARTITION BY hardware_id, parameter ORDER BY tm, event_id) THEN 0 ELSE 1 END AS opens
                FROM ({_SIDES}) WHERE side IS NOT NULL))
        WHERE side <> 'none' GROUP BY hardware_id, parameter, event, side""",
    ),
)
def deviation_events(spark, sf):
    """Events from readings: runs beyond the same limit, across midnight too."""
    return derive.deviation_events(tb.periodic_gmaw(spark, sf), ["hardware_id"], ["tm", "event_id"])


@query(
    "deviation_summary",
    with_tables(
        "dev",
        body=f"""SELECT machine_type, machine_name, parameter, parameter_unit, type AS deviation_direction, deviation_label,
        count(*) AS event_count, {sql_mean('span_seconds', 1)} AS avg_duration_seconds,
        {sql_total('span_seconds', 1, 60)} AS total_duration_minutes,
        min(start_tm) AS first_occurrence, max(start_tm) AS last_occurrence
        FROM dev GROUP BY ALL""",
    ),
)
def deviation_summary(spark, sf):
    return kpis.deviation_summary(tb.deviations(spark, sf))


@query("deviation_summary_from_days", ORACLES["deviation_summary"])
def deviation_summary_from_days(spark, sf):
    """A view without days from the same states; averages are those of all events, not of days."""
    name = "reference.v_deviation_summary"
    tables = tb.stored(spark, sf, schemas.DEVIATION)
    daily.refresh(name, tables, tables.root)
    return daily.read(spark, name, tables.root)


@query(
    "cutting_productivity",
    with_tables(
        "valid_cuts",
        body=f"""SELECT {KEYS}, count(*) AS total_cuts, count(*) FILTER (WHERE thickness_recorded) AS cuts_with_thickness,
        {sql_mean('CASE WHEN speed_valid THEN mm_per_min END', 2)} AS avg_cut_speed_mm_per_min,
        {sql_mean('thickness', 2)} AS avg_thickness_mm, {sql_total('net_travel_in_mm', 2, 1000)} AS total_travel_metres,
        {sql_total('CASE WHEN NOT lpg_below_detection THEN net_lpg_consumption END', 2)} AS total_lpg_litres,
        {sql_total('total_o2_consumption', 2)} AS total_o2_litres FROM valid_cuts GROUP BY {KEYS}""",
    ),
)
def cutting_productivity(spark, sf):
    return kpis.cutting_productivity(tb.cuts(spark, sf))


_VALID = "CASE WHEN NOT is_instantaneous THEN {} END"


@query(
    "session_summary",
    with_tables(
        "sess",
        body=f"""SELECT {KEYS}, count(*) AS total_sessions, count(*) FILTER (WHERE NOT is_instantaneous) AS valid_sessions,
        {sql_mean(_VALID.format('avg_weld_cur'), 2)} AS avg_current_a,
        {sql_mean(_VALID.format('avg_weld_volt'), 2)} AS avg_voltage_v,
        CASE WHEN count({_VALID.format('loss_weight')}) > 0
            THEN {sql_total(_VALID.format('loss_weight'), 2)} END AS total_loss_weight_grams,
        CASE WHEN count(*) FILTER (WHERE NOT is_instantaneous) > 0
            THEN {sql_total(_VALID.format('time_span_seconds'), 1, 60)} END AS total_arc_time_minutes
        FROM sess GROUP BY {KEYS}""",
    ),
)
def session_summary(spark, sf):
    return kpis.session_summary(tb.sessions(spark, sf))


@query(
    "welding_by_machine_first5",
    with_tables(
        "per",
        body=f"""SELECT machine_name, {sql_mean('weld_cur', 1)} AS "avg_weld_cur_A", {sql_mean('weld_volt', 1)} AS "avg_weld_volt_V",
        count(*) AS readings FROM per WHERE is_welding GROUP BY machine_name ORDER BY machine_name LIMIT 5""",
    ),
)
def welding_by_machine_first5(spark, sf):
    return ordering.top(kpis.welding_averages(tb.periodic_gmaw(spark, sf)), 5, ordering.ascending("machine_name"))


@query(
    "session_counts",
    with_tables(
        "sess",
        body=f"""SELECT machine_name, count(*) FILTER (WHERE NOT is_instantaneous) AS valid_sessions,
        {sql_mean(_VALID.format('avg_weld_cur'), 1)} AS "avg_cur_A" FROM sess GROUP BY machine_name""",
    ),
)
def session_counts(spark, sf):
    return kpis.session_counts(tb.sessions(spark, sf))


@query(
    "cutting_speed_by_shift",
    with_tables(
        "valid_cuts",
        body=f"""SELECT shift_name, count(*) AS cuts, {sql_mean('mm_per_min', 1)} AS avg_speed_mm_per_min,
        {sql_mean('thickness', 1)} AS avg_thickness_mm FROM valid_cuts WHERE speed_valid GROUP BY shift_name""",
    ),
)
def cutting_speed_by_shift(spark, sf):
    return kpis.cutting_speed_by_shift(tb.cuts(spark, sf))


@query(
    "frequent_deviations",
    with_tables(
        "dev",
        body=f"""SELECT deviation_label, parameter_unit, count(*) AS events, {sql_mean('span_seconds', 1)} AS avg_span_s
        FROM dev WHERE machine_type = 'GMAW' GROUP BY 1, 2 ORDER BY events DESC, 1, 2 LIMIT 5""",
    ),
)
def frequent_deviations(spark, sf):
    return kpis.frequent_deviations(tb.deviations(spark, sf))


@query(
    "welding_by_machine_shift",
    with_tables(
        "per",
        body=f"""SELECT machine_name, shift_name, {sql_mean('weld_cur', 2)} AS "avg_weld_cur_A",
        {sql_mean('weld_volt', 2)} AS "avg_weld_volt_V", count(*) AS readings
        FROM per WHERE is_welding GROUP BY 1, 2""",
    ),
)
def welding_by_machine_shift(spark, sf):
    return kpis.welding_averages(tb.periodic_gmaw(spark, sf), ("machine_name", "shift_name"), 2)


@query(
    "session_means",
    with_tables(
        "sess",
        body=f"""SELECT machine_name, shift_name, count(*) FILTER (WHERE NOT is_instantaneous) AS valid_sessions,
        {sql_mean(_VALID.format('avg_weld_cur'), 2)} AS "avg_cur_A", {sql_mean(_VALID.format('avg_weld_volt'), 2)} AS "avg_volt_V",
        CASE WHEN count(*) FILTER (WHERE NOT is_instantaneous AND loss_weight > 0) > 0
            THEN {sql_total('CASE WHEN NOT is_instantaneous AND loss_weight > 0 THEN loss_weight END', 6)} END AS total_loss_weight_g
        FROM sess GROUP BY 1, 2""",
    ),
)
def session_means(spark, sf):
    return kpis.session_means(tb.sessions(spark, sf))


@query(
    "cutting_by_shift",
    with_tables(
        "valid_cuts",
        body=f"""SELECT shift_name, count(*) AS cuts, {sql_mean('mm_per_min', 1)} AS avg_speed_mm_per_min,
        {sql_total('net_lpg_consumption', 2)} AS total_lpg_litres, {sql_total('total_o2_consumption', 2)} AS total_o2_litres,
        {sql_mean('thickness', 2)} AS avg_thickness_mm FROM valid_cuts GROUP BY shift_name""",
    ),
)
def cutting_by_shift(spark, sf):
    return kpis.cutting_by_shift(tb.cuts(spark, sf))


@query(
    "deviation_counts",
    with_tables("dev", body="SELECT parameter, parameter_unit, count(*) AS events FROM dev GROUP BY 1, 2"),
)
def deviation_counts(spark, sf):
    return kpis.deviation_counts(tb.deviations(spark, sf))


@query(
    "flag_distribution_with_null",
    with_tables("per", body="SELECT gas_deviation_flag, count(*) AS rows FROM per GROUP BY 1"),
)
def flag_distribution_with_null(spark, sf):
    return kpis.distribution(tb.periodic_gmaw(spark, sf), "gas_deviation_flag")


@query(
    "flag_distribution",
    with_tables(
        "per",
        body="""SELECT gas_deviation_flag, count(*) AS rows FROM per WHERE gas_deviation_flag IS NOT NULL GROUP BY 1""",
    ),
)
def flag_distribution(spark, sf):
    return kpis.distribution(tb.periodic_gmaw(spark, sf), "gas_deviation_flag", keep_null=False)


@query(
    "chart_feed",
    with_tables("dev", body='SELECT parameter AS "PARAMETER_TYPE", count(*) AS "COUNT" FROM dev GROUP BY 1'),
)
def chart_feed(spark, sf):
    return kpis.chart_feed(tb.deviations(spark, sf))


@query(
    "column_profile",
    with_tables(
        "per",
        body=" UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS null_rows,
            count(DISTINCT {c}) AS distinct_values FROM per"""
            for c in ("machine_name", "shift_name", "gas_deviation_flag", "hardware_id")
        ),
    ),
)
def column_profile(spark, sf):
    return kpis.column_profile(
        tb.periodic_gmaw(spark, sf), ("machine_name", "shift_name", "gas_deviation_flag", "hardware_id")
    )


_SKETCHED = ("machine_name", "hardware_id", "weld_cur", "amb_temp", "event_id")


@query(
    "column_sketches_by_day",
    with_tables(
        "per",
        body=" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS null_rows, TRUE AS distinct_close, TRUE AS median_close FROM per"
            for c in _SKETCHED
        ),
    ),
)
def column_sketches_by_day(spark, sf):
    """Sketches per day, merged, against the exact figures: distinct values within 5 %, the median's rank within 3 %."""
    readings = tb.periodic_gmaw(spark, sf)
    profile = kpis.sketched_profile(kpis.column_sketches(readings, _SKETCHED, ["business_date"]))
    exact = kpis.column_profile(readings, _SKETCHED).select("column_name", F.col("distinct_values").alias("exact"))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in _SKETCHED[2:]])
    values = readings.select(F.inline(cells)).where("v IS NOT NULL")
    middle = profile.where("quantiles IS NOT NULL").select("column_name", F.col("quantiles")[1].alias("median"))
    below = values.join(middle, "column_name").groupBy("column_name").agg(
        F.avg((F.col("v") < F.col("median")).cast("int")).alias("under"), F.avg((F.col("v") <= F.col("median")).cast("int")).alias("upto")
    )
    close = (F.col("under") <= 0.53) & (F.col("upto") >= 0.47)
    joined = profile.join(exact, "column_name").join(below, "column_name", "left")
    return joined.select(
        "column_name",
        "rows",
        "null_rows",
        (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_close"),
        F.coalesce(close, F.col("quantiles").isNull()).alias("median_close"),
    )


@query("row_count_where", with_tables("per", body="SELECT count(*) AS rows FROM per WHERE is_welding"))
def row_count_where(spark, sf):
    return kpis.row_count(tb.periodic_gmaw(spark, sf), filters.is_valid(schemas.PERIODIC_GMAW))


@query(
    "session_efficiency",
    with_tables(
        "sess",
        body="""SELECT machine_name, count(*) AS total_sessions, count(*) FILTER (WHERE NOT is_instantaneous) AS valid_sessions,
        CAST((2 * count(*) FILTER (WHERE NOT is_instantaneous) * 10000 + count(*)) // (2 * count(*)) AS DOUBLE) / 100
            AS clad_efficiency_pct FROM sess GROUP BY 1""",
    ),
)
def session_efficiency(spark, sf):
    return kpis.session_efficiency(tb.sessions(spark, sf))


_STEP = """CASE WHEN prev IS NULL THEN NULL WHEN {c} >= prev THEN {c} - prev ELSE {c} END"""


@query(
    "counter_consumption",
    with_tables(
        "flow",
        body=f"""SELECT hardware_id, count(*) AS readings,
        CAST(coalesce(sum({_STEP.format(c='tenths')}), 0) AS DOUBLE) / 10 AS consumption
        FROM (SELECT *, lag(tenths) OVER (PARTITION BY hardware_id ORDER BY tm, event_id) AS prev FROM flow) GROUP BY 1""",
    ),
)
def counter_consumption(spark, sf):
    return sequences.counter_consumption(
        tb.flow_readings(spark, sf), ["hardware_id"], ["tm", "event_id"], "total_lpg_consumption"
    )


@query(
    "counter_steps",
    with_tables(
        "flow",
        body=f"""SELECT event_id, hardware_id,
        CAST(CASE WHEN gappy_tenths IS NULL THEN NULL ELSE {_STEP.format(c='gappy_tenths')} END AS DOUBLE) / 10 AS step
        FROM (SELECT *, last_value(gappy_tenths IGNORE NULLS) OVER (PARTITION BY hardware_id ORDER BY tm, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM flow)""",
    ),
)
def counter_steps(spark, sf):
    readings = tb.flow_readings(spark, sf).select("event_id", "hardware_id", "tm", "gappy_counter")
    steps = sequences.counter_steps(readings, ["hardware_id"], ["tm", "event_id"], "gappy_counter")
    return steps.select("event_id", "hardware_id", F.round("step", 1).alias("step"))


# Short chunks, so that days are cut at these sizes of the tables.
@query("counter_consumption_cut", ORACLES["counter_consumption"])
def counter_consumption_cut(spark, sf):
    return sequences.counter_consumption(
        tb.flow_readings(spark, sf), ["hardware_id"], ["tm", "event_id"], "total_lpg_consumption", most_rows=8
    )


@query("counter_steps_cut", ORACLES["counter_steps"])
def counter_steps_cut(spark, sf):
    readings = tb.flow_readings(spark, sf).select("event_id", "hardware_id", "tm", "gappy_counter")
    steps = sequences.counter_steps(readings, ["hardware_id"], ["tm", "event_id"], "gappy_counter", most_rows=8)
    return steps.select("event_id", "hardware_id", F.round("step", 1).alias("step"))


@query(
    "counter_span",
    with_tables(
        "flow",
        body="""SELECT hardware_id, business_date, CAST(max(tenths) - min(tenths) AS DOUBLE) / 10 AS consumption
        FROM flow GROUP BY 1, 2""",
    ),
)
def counter_span(spark, sf):
    span = kpis.counter_span(tb.flow_readings(spark, sf), ("hardware_id", "business_date"), "total_lpg_consumption")
    return span.withColumn("consumption", F.round("consumption", 1))


@query(
    "work_periods_derived",
    with_tables(
        "periods",
        body="""SELECT oid, machine_name, CAST(active AS DOUBLE) AS active, CAST(idle AS DOUBLE) AS idle,
        CAST(total_accounted_minutes AS DOUBLE) AS total_accounted_minutes, time_allocation_valid,
        arc_efficiency_pct, deposit_efficiency_pct FROM periods""",
    ),
)
def work_periods_derived(spark, sf):
    return tb.work_periods(spark, sf).select(
        "oid", "machine_name", "active", "idle", "total_accounted_minutes", "time_allocation_valid",
        "arc_efficiency_pct", "deposit_efficiency_pct",
    )


@query(
    "shift_efficiency",
    with_tables(
        "periods",
        body=f"""SELECT {KEYS}, CAST(active AS DOUBLE) AS active_minutes, CAST(idle AS DOUBLE) AS idle_minutes,
        CAST(breakdown AS DOUBLE) AS breakdown_minutes, arc_efficiency_pct, CAST(deposit AS DOUBLE) AS deposit,
        CAST(target_deposit AS DOUBLE) AS target_deposit, deposit_efficiency_pct FROM periods WHERE machine_type = 'GMAW'""",
    ),
)
def shift_efficiency(spark, sf):
    return view("gmaw.v_gmaw_shift_efficiency", {schemas.DERIVED_GMAW: tb.work_periods(spark, sf)})


@query(
    "plausible_efficiency",
    with_tables(
        "periods",
        body="""SELECT machine_name, count(*) AS periods, min(arc_efficiency_pct) AS lowest, max(arc_efficiency_pct) AS highest
        FROM periods WHERE arc_efficiency_pct BETWEEN 0 AND 200 GROUP BY 1""",
    ),
)
def plausible_efficiency(spark, sf):
    return (
        tb.work_periods(spark, sf)
        .where(filters.plausible_efficiency())
        .groupBy("machine_name")
        .agg(
            F.count("*").alias("periods"),
            F.min("arc_efficiency_pct").alias("lowest"),
            F.max("arc_efficiency_pct").alias("highest"),
        )
    )


def _deviation_rows(machine_type: str) -> str:
    return with_tables(
        "dev",
        body=f"""SELECT event_id, machine_name, parameter, type, CAST(span_seconds AS DOUBLE) AS span_seconds
        FROM dev WHERE machine_type = '{machine_type}'""",
    )


_DEVIATION_COLUMNS = ("event_id", "machine_name", "parameter", "type", "span_seconds")


@query("deviations_gmaw", _deviation_rows("GMAW"))
def deviations_gmaw(spark, sf):
    t = {schemas.DEVIATION: tb.deviations(spark, sf)}
    return view("gmaw.fact_deviation_gmaw", t).select(*_DEVIATION_COLUMNS)


@query("deviations_clad", _deviation_rows("CLAD"))
def deviations_clad(spark, sf):
    t = {schemas.DEVIATION: tb.deviations(spark, sf)}
    return view("clad.fact_deviation_clad", t).select(*_DEVIATION_COLUMNS)


@query(
    "valid_rows",
    with_tables(
        "per", "cuts", "passes", "sess", "usr",
        body="""SELECT 'gmaw.fact_periodic_gmaw' AS table_name, count(*) AS rows, count(*) FILTER (WHERE is_welding) AS valid_rows FROM per
        UNION ALL SELECT 'gascutting.fact_summarize_gascutting', count(*), count(*) FILTER (WHERE NOT timer_overflow AND NOT travel_outlier) FROM cuts
        UNION ALL SELECT 'gascutting.fact_summarize_gascutting_noncutting', count(*), count(*) FILTER (WHERE NOT speed_unreliable) FROM passes
        UNION ALL SELECT 'clad.fact_summarize_clad', count(*), count(*) FILTER (WHERE NOT is_instantaneous) FROM sess""",
    ),
)
def valid_rows(spark, sf):
    parts = None
    for name, df in tb.PlantTables(spark, sf).items():
        if name in filters.MANDATORY:
            part = df.agg(
                F.count("*").alias("rows"), F.count_if(filters.is_valid(name)).alias("valid_rows")
            ).select(F.lit(name).alias("table_name"), "rows", "valid_rows")
            parts = part if parts is None else parts.unionByName(part)
    return parts


@query(
    "top_with_missing_first",
    with_tables(
        "per",
        body="""SELECT event_id, amb_temp FROM per ORDER BY amb_temp DESC NULLS FIRST, event_id LIMIT 100""",
    ),
)
def top_with_missing_first(spark, sf):
    rows = tb.periodic_gmaw(spark, sf).select("event_id", "amb_temp")
    return ordering.top(rows, 100, ordering.descending("amb_temp"), "event_id")


@query(
    "latest_reading_per_machine",
    with_tables(
        "per",
        body="""SELECT machine_name, event_id, tm, weld_cur FROM per
        QUALIFY row_number() OVER (PARTITION BY machine_name ORDER BY tm DESC, event_id DESC) = 1""",
    ),
)
def latest_reading_per_machine(spark, sf):
    rows = tb.periodic_gmaw(spark, sf).select("machine_name", "event_id", "tm", "weld_cur")
    return sequences.latest_per_key(rows, ["machine_name"], ["tm", "event_id"])
