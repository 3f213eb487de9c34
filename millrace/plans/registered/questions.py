"""The question catalogue B1–B21."""

from pyspark.sql import functions as F

from millrace.plans import questions, testbed as tb
from millrace.plans.registered import ORACLES, query
from millrace.plans.testbed import sql_mean, sql_round, sql_sum, sql_total, with_tables
from millrace.sources import schemas


def _ask(name, oracle, *ctes, **params):
    """Register a question of the catalogue under its function's name."""
    function = getattr(questions, name)

    def run(spark, sf):
        return function(tb.PlantTables(spark, sf), **params)

    run.__doc__ = function.__doc__
    query(name, with_tables(*ctes, body=oracle))(run)


_TODAY = "business_date = (SELECT max(business_date) FROM {0})"
_WEEK = "business_date > (SELECT max(business_date) FROM {0}) - 7"
_VALID = "CASE WHEN NOT is_instantaneous THEN {} END"
_SESSION = f"""business_date, shift_name, machine_name, count(*) AS total_sessions, count(*) FILTER (WHERE NOT is_instantaneous) AS valid_sessions,
    {sql_mean(_VALID.format('avg_weld_cur'), 2)} AS avg_current_a, {sql_mean(_VALID.format('avg_weld_volt'), 2)} AS avg_voltage_v,
    CASE WHEN count({_VALID.format('loss_weight')}) > 0 THEN {sql_total(_VALID.format('loss_weight'), 2)} END AS total_loss_weight_grams,
    CASE WHEN count(*) FILTER (WHERE NOT is_instantaneous) > 0
        THEN {sql_total(_VALID.format('time_span_seconds'), 1, 60)} END AS total_arc_time_minutes"""
_EFFICIENCY = f"{sql_mean('arc_efficiency_pct', 2)} AS avg_arc_efficiency_pct, count(*) AS periods"
_PLAUSIBLE = "arc_efficiency_pct BETWEEN 0 AND 200"
_GMAW = "(SELECT * FROM periods WHERE machine_type = 'GMAW')"

_ask(
    "efficiency_today",
    f"SELECT machine_name, {_EFFICIENCY} FROM {_GMAW} WHERE {_PLAUSIBLE} AND {_TODAY.format(_GMAW)} GROUP BY 1",
    "periods",
)
_ask(
    "lpg_by_shift",
    f"SELECT shift_name, {sql_total('total_lpg_cons', 2)} AS total_lpg_litres FROM passes WHERE NOT speed_unreliable GROUP BY 1",
    "passes",
)
_ask(
    "lpg_by_shift_from_cuts",
    f"SELECT shift_name, {sql_total('net_lpg_consumption', 2)} AS total_lpg_litres FROM valid_cuts GROUP BY 1",
    "valid_cuts",
)
_ask("sessions_this_week", f"SELECT {_SESSION} FROM sess WHERE {_WEEK.format('sess')} GROUP BY 1, 2, 3", "sess")
_DEV = """event_id, hardware_id, mid, machine_name, machine_type, business_date, start_tm, CAST(span_seconds AS DOUBLE) AS span_seconds,
    parameter, type, reading, deviation_label, parameter_unit"""
_ask(
    "latest_deviations",
    f"SELECT {_DEV} FROM dev ORDER BY start_tm DESC, hardware_id, parameter, event_id LIMIT 100",
    "dev",
    tie=("hardware_id", "parameter", "event_id"),
)
_ask(
    "sensor_averages_by_machine",
    f"""SELECT machine_name, count(*) AS sample_count, {sql_mean('weld_cur', 2)} AS avg_weld_cur_a,
    {sql_mean('weld_volt', 2)} AS avg_weld_volt_v, {sql_mean('weld_gas', 2)} AS avg_weld_gas_lmin FROM per WHERE is_welding GROUP BY 1""",
    "per",
)
_ask("efficiency_by_shift", f"SELECT shift_name, {_EFFICIENCY} FROM {_GMAW} WHERE {_PLAUSIBLE} GROUP BY 1", "periods")
_ask(
    "machine_readings",
    """SELECT pdid, tm, weld_cur, weld_volt, weld_gas FROM per WHERE is_welding AND machine_name = 'M-3' ORDER BY tm, pdid LIMIT 100""",
    "per",
    machine="M-3",
)
_ask(
    "deviations_today",
    f"SELECT business_date, deviation_label, count(*) AS events FROM dev WHERE {_TODAY.format('dev')} GROUP BY 1, 2",
    "dev",
)
_ask(
    "cladding_means",
    f"""SELECT machine_name, shift_name, count(*) FILTER (WHERE NOT is_instantaneous) AS valid_sessions,
    {sql_mean(_VALID.format('avg_weld_cur'), 2)} AS "avg_cur_A", {sql_mean(_VALID.format('avg_weld_volt'), 2)} AS "avg_volt_V"
    FROM sess GROUP BY 1, 2""",
    "sess",
)
_ask(
    "machine_current_today",
    f"""SELECT business_date, shift_name, machine_name, count(*) AS sample_count, {sql_mean('weld_cur', 2)} AS avg_weld_cur_a
    FROM per WHERE is_welding AND machine_name = 'M-3' AND {_TODAY.format('per')} GROUP BY 1, 2, 3""",
    "per",
    machine="M-3",
)
_ask(
    "best_machine_this_week",
    f"""SELECT machine_name, {_EFFICIENCY} FROM {_GMAW} WHERE {_PLAUSIBLE} AND {_WEEK.format(_GMAW)} GROUP BY 1
    ORDER BY avg_arc_efficiency_pct DESC, machine_name LIMIT 1""",
    "periods",
)
_ask(
    "machine_sessions_yesterday",
    f"""SELECT {_SESSION} FROM sess WHERE machine_name = 'Rectifier2' AND business_date = (SELECT max(business_date) FROM sess) - 1
    GROUP BY 1, 2, 3""",
    "sess",
    machine="Rectifier2",
)
_ask(
    "lpg_last_shift",
    f"""SELECT business_date, shift_name, {sql_total('total_lpg_cons', 2)} AS total_lpg_litres FROM passes WHERE NOT speed_unreliable
    AND {_TODAY.format('passes')} AND shift_name = (SELECT max(shift_name) FROM passes WHERE {_TODAY.format('passes')}) GROUP BY 1, 2""",
    "passes",
)
_ask(
    "welding_deviations",
    f"SELECT {_DEV} FROM dev WHERE machine_type = 'GMAW' ORDER BY start_tm, hardware_id, parameter, event_id LIMIT 100",
    "dev",
    tie=("hardware_id", "parameter", "event_id"),
)
_SIDE = "CASE WHEN shift_name = '{}' THEN arc_efficiency_pct END"
_ask(
    "efficiency_shift_a_b",
    f"""SELECT machine_name, {sql_mean(_SIDE.format('A'), 2)} AS shift_a, {sql_mean(_SIDE.format('B'), 2)} AS shift_b
    FROM {_GMAW} WHERE {_PLAUSIBLE} GROUP BY 1""",
    "periods",
)


def _figures(source, table, where, metrics):
    return " UNION ALL ".join(
        f"""SELECT '{source}' AS source, shift_name, machine_name, '{name}' AS metric, CAST({value} AS DOUBLE) AS value
        FROM {table} WHERE {where} GROUP BY shift_name, machine_name"""
        for name, value in metrics.items()
    )


_ask(
    "shift_report_today",
    " UNION ALL ".join(
        [
            _figures(
                "GMAW", "per", f"is_welding AND {_TODAY.format('per')}",
                {"sample_count": "count(*)", "avg_weld_cur_a": sql_mean("weld_cur", 2), "avg_weld_volt_v": sql_mean("weld_volt", 2)},
            ),
            _figures(
                "GASCUTTING", "valid_cuts", _TODAY.format("cuts"),
                {
                    "total_cuts": "count(*)",
                    "total_travel_metres": sql_total("net_travel_in_mm", 2, 1000),
                    "total_lpg_litres": sql_total("CASE WHEN NOT lpg_below_detection THEN net_lpg_consumption END", 2),
                },
            ),
            _figures(
                "CLAD", "sess", _TODAY.format("sess"),
                {
                    "total_sessions": "count(*)",
                    "valid_sessions": "count(*) FILTER (WHERE NOT is_instantaneous)",
                    "avg_current_a": sql_mean(_VALID.format("avg_weld_cur"), 2),
                },
            ),
            _figures(
                "DEVIATION", "(SELECT * REPLACE (NULL::VARCHAR AS shift_name) FROM (SELECT *, '' AS shift_name FROM dev))",
                _TODAY.format("dev"),
                {"event_count": "count(*)", "total_duration_minutes": sql_round(sql_sum("span_seconds"), "CAST(60 AS HUGEINT)", 1)},
            ),
        ]
    ),
    "per", "dev", "cuts", "valid_cuts", "sess",
)
_ask(
    "high_voltage_machines",
    "SELECT machine_name, count(*) AS events FROM dev WHERE parameter = 'weld_volt' AND type = 'high' GROUP BY 1",
    "dev",
)
_ask(
    "cutting_compliance",
    """SELECT shift_name, total_cuts, valid_cuts, CAST((2 * valid_cuts * 10000 + total_cuts) // (2 * total_cuts) AS DOUBLE) / 100 AS compliance_pct
    FROM (SELECT shift_name, count(*) AS total_cuts, count(*) FILTER (WHERE NOT timer_overflow AND NOT travel_outlier) AS valid_cuts
    FROM cuts GROUP BY 1)""",
    "cuts",
)
_ask(
    "current_consumption",
    f"""SELECT machine_type, {sql_mean('amperes', 2)} AS avg_current_a, count(*) AS rows FROM (
    SELECT 'GMAW' AS machine_type, weld_cur AS amperes FROM per WHERE is_welding UNION ALL
    SELECT 'CLAD', avg_weld_cur FROM sess WHERE NOT is_instantaneous) GROUP BY 1""",
    "per", "sess",
)


@query("deviations_today_stored", ORACLES["deviations_today"])
def deviations_today_stored(spark, sf):
    """The same over a table laid out by day, whose latest day is known from its folders."""
    return questions.deviations_today(tb.stored(spark, sf, schemas.DEVIATION))


@query("machine_current_today_stored", ORACLES["machine_current_today"])
def machine_current_today_stored(spark, sf):
    return questions.machine_current_today(tb.stored(spark, sf, schemas.PERIODIC_GMAW), machine="M-3")


@query(
    "deviations_of_plant_day",
    with_tables(
        "dev",
        body="""SELECT business_date, deviation_label, count(*) AS events
        FROM (SELECT deviation_label, CAST(start_tm + INTERVAL 330 MINUTE AS DATE) AS business_date FROM dev) AS d
        WHERE business_date = (SELECT max(CAST(start_tm + INTERVAL 330 MINUTE AS DATE)) FROM dev) GROUP BY 1, 2""",
    ),
)
def deviations_of_plant_day(spark, sf):
    """Events that carry an instant only: the day is the plant's, five and a half hours ahead of UTC."""
    events = tb.deviations(spark, sf).drop("business_date").withColumn("start_tm", F.col("start_tm").cast("timestamp"))
    return questions.deviations_today({schemas.DEVIATION: events})
