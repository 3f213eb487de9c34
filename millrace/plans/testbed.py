"""Plant-shaped tables read off the driver's TPC-H-like tables.

Each function is a projection of one stored table, so scans stay pruned and the
work grows with the data. ``SQL`` holds the same projections for DuckDB.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators import derive
from millrace.plans import load
from millrace.session import scratch_folder
from millrace.sources import readers, schemas, sinks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def prop(c: str = "props") -> Column:
    """The number in ``{"k": n}``."""
    return F.get_json_object(c, "$.k").cast("bigint")


def periodic_gmaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    high_low = {
        f"{side}_{p}_threshold": F.lit(limit)
        for p, limits in derive.THRESHOLDS.items()
        for side, limit in zip(("high", "low"), limits)
    }
    return table(spark, sf_dir, "events").withColumn("k", prop()).select(
        F.col("event_id").cast("string").alias("pdid"),
        "event_id",
        "user_id",
        F.to_date("ts").alias("business_date"),
        derive.shift_of("ts").alias("shift_name"),
        F.lit("GMAW").alias("machine_type"),
        _named("M-", F.col("user_id") % 17).alias("machine_name"),
        _named("HW", F.col("user_id")).alias("hardware_id"),
        F.col("ts").alias("tm"),
        F.col("value").alias("weld_cur"),
        (F.col("user_id") % 40).cast("double").alias("weld_volt"),
        k.cast("double").alias("weld_gas"),
        (F.col("event_id") % 60).cast("double").alias("hs_temp"),
        F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 45) / 2).alias("amb_temp"),
        (F.col("value") * 2).alias("rpm"),
        (F.col("event_type") == "error").alias("is_idle"),
        (F.col("event_type") != "error").alias("is_welding"),
        F.when(F.col("event_type") == "click", "none")
        .when(F.col("event_type") == "view", "0")
        .when(F.col("event_type") == "purchase", "single")
        .when(F.col("event_type") == "signup", "2")
        .alias("current_deviation_flag"),
        F.when(k % 4 == 0, "sustained").when(k % 4 == 1, "1").otherwise("none").alias("voltage_deviation_flag"),
        F.when(k % 5 != 0, F.when(k % 2 == 0, "none").otherwise("single")).alias("gas_deviation_flag"),
        *[c.alias(n) for n, c in high_low.items()],
    )


def deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = periodic_gmaw(spark, sf_dir).withColumns(
        {
            "mid": F.col("user_id") % 17,
            "machine_type": F.when(F.col("user_id") % 5 == 0, "CLAD").otherwise("GMAW"),
            "start_tm": F.col("tm"),
            "span_seconds": (F.col("event_id") % 600) + F.lit(0.5),
        }
    )
    keep = ("event_id", "hardware_id", "mid", "machine_name", "machine_type", "business_date", "start_tm", "span_seconds")
    return derive.threshold_breaches(readings, keep=keep)


def work_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("business_date"),
        F.element_at(F.array(*[F.lit(s) for s in "ABC"]), (F.col("l_linenumber") % 3 + 1)).alias("shift_name"),
        F.when(F.col("l_returnflag") == "R", "CLAD").otherwise("GMAW").alias("machine_type"),
        _named("M-", F.col("l_suppkey") % 17).alias("machine_name"),
        F.col("l_orderkey").cast("string").alias("oid"),
        (F.col("l_quantity") * 10).alias("active"),
        (300 - F.col("l_quantity") * 10).alias("idle"),
        F.col("l_linenumber").cast("double").alias("inrepair"),
        (F.col("l_partkey") % 150).cast("double").alias("breakdown"),
        ((F.col("l_partkey") % 5) * 100).cast("double").alias("target_arc_time"),
        F.col("l_quantity").alias("deposit"),
        ((F.col("l_suppkey") % 4) * 25).cast("double").alias("target_deposit"),
    )
    return derive.derive_work_periods(lines)


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.to_date("l_shipdate").alias("business_date"),
            F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("B").alias("shift_name"),
            F.lit("GASCUTTING").alias("machine_type"),
            _named("GasCutting", F.col("l_suppkey") % 3).alias("machine_name"),
            F.col("l_shipdate").alias("on_time"),
            (F.col("l_quantity") * 12).alias("time_span_seconds"),
            (F.col("l_discount") >= 0.09).alias("timer_overflow"),
            derive.travel_outlier("l_extendedprice").alias("travel_outlier"),
            F.col("l_extendedprice").alias("net_travel_in_mm"),
            (F.col("l_extendedprice") / 100).alias("mm_per_min"),
            (F.col("l_tax") < 0.06).alias("speed_valid"),
            F.when(F.col("l_linestatus") != "O", F.col("l_quantity") / 2).alias("thickness"),
            F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_tax") * 100).alias("net_lpg_consumption"),
            (F.col("l_discount") * 100).alias("net_o2_consumption_meter1"),
            (F.col("l_tax") * 100).alias("net_o2_consumption_meter2"),
        )
        .withColumns(
            {
                "thickness_recorded": derive.recorded("thickness"),
                "lpg_below_detection": derive.below_detection("net_lpg_consumption"),
                "total_o2_consumption": derive.sum_of_meters("net_o2_consumption_meter1", "net_o2_consumption_meter2"),
            }
        )
    )


def heating_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = (F.col("o_custkey") % 40).cast("double")
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("business_date"),
        F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B").alias("shift_name"),
        _named("GasCutting", F.col("o_custkey") % 3).alias("machine_name"),
        seconds.alias("time_span_seconds"),
        derive.speed_unreliable(seconds).alias("speed_unreliable"),
        (F.col("o_totalprice") / 100).alias("total_lpg_cons"),
        (F.col("o_totalprice") / 1000).alias("total_heating_o2"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("business_date"),
        F.element_at(F.array(*[F.lit(s) for s in "ABC"]), (key % 3 + 1).cast("int")).alias("shift_name"),
        F.lit("CLAD").alias("machine_type"),
        F.when(F.col("o_custkey") % 8 == 0, "Rectifier1").otherwise("Rectifier2").alias("machine_name"),
        F.col("o_orderdate").alias("ontime"),
        ((F.col("o_custkey") % 900) + F.lit(0.5)).alias("time_span_seconds"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("is_instantaneous"),
        (price / 1000).alias("avg_weld_cur"),
        (F.col("o_custkey") % 12).cast("double").alias("avg_weld_volt"),
        F.when(key % 10 == 0, F.lit(None).cast("double")).when(key % 10 < 8, 0.0).otherwise(price / 100).alias("loss_weight"),
    )


def flow_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running gas counter per device that restarts every midnight."""
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        _named("HW", F.col("user_id")).alias("hardware_id"),
        F.to_date("ts").alias("business_date"),
        F.col("ts").alias("tm"),
        (second * (F.col("user_id") % 3 + 1) / 10).alias("total_lpg_consumption"),
        F.when(F.col("event_id") % 9 != 0, second * (F.col("user_id") % 3 + 1) / 10).alias("gappy_counter"),
    )


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("mid"),
        F.when(key % 4 == 0, _named(" M -", key)).when(key % 4 == 1, _named("M - ", key)).otherwise(_named("M-", key)).alias("name"),
        _named("HW", key).alias("hardware_id"),
        (F.col("s_nationkey") % 3 + 1).alias("mtid"),
        (F.col("s_acctbal") < 0).alias("deleted"),
    )


def raw_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User export as text, made from customer numbers only."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    host = (
        F.when(nation % 3 == 0, "@PLANT.example").when(nation % 3 == 1, "@Sub.plant.example").otherwise("@other.example")
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(key.cast("string"), F.lit(".0")).alias("uid"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("User"), key.cast("string"), host).alias("email"),
        F.when(key % 11 == 0, "9999999999").otherwise(F.concat((key + 7000000000).cast("string"), F.lit(".0"))).alias("phno"),
        F.concat((nation % 5).cast("string"), F.lit(".0")).alias("roleid"),
        F.when(F.col("c_acctbal") < 0, "t").otherwise("f").alias("deleted"),
        F.when(F.col("c_mktsegment") == "BUILDING", "f").otherwise("t").alias("active_status"),
        F.concat(F.lit("u"), key.cast("string")).alias("username"),
    )


def stored(spark: SparkSession, sf_dir: str, *names: str) -> load.StoredTables:
    """Facts written by day to a new folder, and read from there."""
    root = scratch_folder(spark)
    tables = PlantTables(spark, sf_dir)
    for name in names:
        sinks.write_table(tables[name], readers.table_path(root, name))
    return load.stored_tables(spark, root)


class PlantTables(Mapping):
    """The facts the question catalogue reads, each built when asked for."""

    BUILDERS = {
        schemas.PERIODIC_GMAW: periodic_gmaw,
        schemas.DEVIATION: deviations,
        schemas.DERIVED_GMAW: work_periods,
        schemas.SUMMARY_GASCUTTING: cuts,
        schemas.NONCUTTING: heating_passes,
        schemas.SUMMARY_CLAD: sessions,
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.source = (spark, sf_dir)

    def __getitem__(self, name: str) -> DataFrame:
        return self.BUILDERS[name](*self.source)

    def __iter__(self):
        return iter(self.BUILDERS)

    def __len__(self) -> int:
        return len(self.BUILDERS)


_SHIFT = "CASE WHEN hour(ts) >= 6 AND hour(ts) < 14 THEN 'A' WHEN hour(ts) >= 14 AND hour(ts) < 22 THEN 'B' ELSE 'C' END"
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_SECOND = "(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT))"


def _breach(parameter: str, high: float, low: float, unit: str) -> str:
    return f"""SELECT event_id, hardware_id, user_id % 17 AS mid, machine_name,
        CASE WHEN user_id % 5 = 0 THEN 'CLAD' ELSE 'GMAW' END AS machine_type, business_date,
        tm AS start_tm, event_id % 600 + 0.5 AS span_seconds, '{parameter}' AS parameter,
        CASE WHEN {parameter} > {high} THEN 'high' ELSE 'low' END AS type, {parameter} AS reading,
        '{parameter}_' || CASE WHEN {parameter} > {high} THEN 'high' ELSE 'low' END AS deviation_label,
        '{unit}' AS parameter_unit
        FROM per WHERE {parameter} > {high} OR {parameter} < {low}"""


# Common table expressions by name: (names needed first, definition).
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "per": (
        (),
        f"""SELECT CAST(event_id AS VARCHAR) AS pdid, event_id, user_id, CAST(ts AS DATE) AS business_date,
        {_SHIFT} AS shift_name, 'GMAW' AS machine_type, 'M-' || CAST(user_id % 17 AS VARCHAR) AS machine_name,
        'HW' || CAST(user_id AS VARCHAR) AS hardware_id, ts AS tm, value AS weld_cur,
        CAST(user_id % 40 AS DOUBLE) AS weld_volt, CAST({_K} AS DOUBLE) AS weld_gas,
        CAST(event_id % 60 AS DOUBLE) AS hs_temp,
        CASE WHEN event_id % 7 <> 0 THEN (event_id % 45) / 2.0 END AS amb_temp, value * 2 AS rpm,
        event_type = 'error' AS is_idle, event_type <> 'error' AS is_welding,
        CASE event_type WHEN 'click' THEN 'none' WHEN 'view' THEN '0' WHEN 'purchase' THEN 'single'
            WHEN 'signup' THEN '2' END AS current_deviation_flag,
        CASE {_K} % 4 WHEN 0 THEN 'sustained' WHEN 1 THEN '1' ELSE 'none' END AS voltage_deviation_flag,
        CASE WHEN {_K} % 5 <> 0 THEN CASE WHEN {_K} % 2 = 0 THEN 'none' ELSE 'single' END END AS gas_deviation_flag
        FROM events""",
    ),
    "dev": (
        ("per",),
        " UNION ALL ".join(
            _breach(p, *derive.THRESHOLDS[p], u) for p, u in (("weld_cur", "A"), ("weld_volt", "V"), ("weld_gas", "L/min"))
        ),
    ),
    "raw_periods": (
        (),
        """SELECT CAST(l_shipdate AS DATE) AS business_date, substr('ABC', CAST(l_linenumber % 3 + 1 AS INTEGER), 1) AS shift_name,
        CASE WHEN l_returnflag = 'R' THEN 'CLAD' ELSE 'GMAW' END AS machine_type,
        'M-' || CAST(l_suppkey % 17 AS VARCHAR) AS machine_name, CAST(l_orderkey AS VARCHAR) AS oid,
        CAST(l_quantity * 10 AS BIGINT) AS active, 300 - CAST(l_quantity * 10 AS BIGINT) AS idle,
        CAST(l_linenumber AS BIGINT) AS inrepair, l_partkey % 150 AS breakdown,
        (l_partkey % 5) * 100 AS target_arc_time, CAST(l_quantity AS BIGINT) AS deposit,
        (l_suppkey % 4) * 25 AS target_deposit FROM lineitem""",
    ),
    "periods": (
        ("raw_periods",),
        """SELECT *, active + idle + inrepair + breakdown AS total_accounted_minutes,
        active + idle + inrepair + breakdown <= 480 AND idle >= 0 AS time_allocation_valid,
        CASE WHEN target_arc_time <> 0
            THEN CAST((2 * active * 10000 + target_arc_time) // (2 * target_arc_time) AS DOUBLE) / 100 END AS arc_efficiency_pct,
        CASE WHEN target_deposit <> 0
            THEN CAST((2 * deposit * 10000 + target_deposit) // (2 * target_deposit) AS DOUBLE) / 100 END AS deposit_efficiency_pct
        FROM raw_periods""",
    ),
    "cuts": (
        (),
        """SELECT CAST(l_shipdate AS DATE) AS business_date, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END AS shift_name,
        'GasCutting' || CAST(l_suppkey % 3 AS VARCHAR) AS machine_name, l_shipdate AS on_time,
        l_quantity * 12 AS time_span_seconds, l_discount >= CAST(0.09 AS DOUBLE) AS timer_overflow,
        l_extendedprice > 100000 AS travel_outlier, l_extendedprice AS net_travel_in_mm,
        l_extendedprice / 100 AS mm_per_min, l_tax < CAST(0.06 AS DOUBLE) AS speed_valid,
        CASE WHEN l_linestatus <> 'O' THEN l_quantity / 2 END AS thickness, l_linestatus <> 'O' AS thickness_recorded,
        CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE l_tax * 100 END AS net_lpg_consumption,
        l_returnflag = 'N' OR l_tax = 0 AS lpg_below_detection,
        l_discount * 100 AS net_o2_consumption_meter1, l_tax * 100 AS net_o2_consumption_meter2,
        l_discount * 100 + l_tax * 100 AS total_o2_consumption FROM lineitem""",
    ),
    "valid_cuts": (("cuts",), "SELECT * FROM cuts WHERE NOT timer_overflow AND NOT travel_outlier"),
    "passes": (
        (),
        """SELECT CAST(o_orderdate AS DATE) AS business_date, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS shift_name,
        'GasCutting' || CAST(o_custkey % 3 AS VARCHAR) AS machine_name, o_custkey % 40 AS time_span_seconds,
        o_custkey % 40 < 5 AS speed_unreliable, o_totalprice / 100 AS total_lpg_cons,
        o_totalprice / 1000 AS total_heating_o2 FROM orders""",
    ),
    "sess": (
        (),
        """SELECT CAST(o_orderdate AS DATE) AS business_date, substr('ABC', CAST(o_orderkey % 3 + 1 AS INTEGER), 1) AS shift_name,
        CASE WHEN o_custkey % 8 = 0 THEN 'Rectifier1' ELSE 'Rectifier2' END AS machine_name, o_orderdate AS ontime,
        o_custkey % 900 + 0.5 AS time_span_seconds,
        CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS is_instantaneous,
        o_totalprice / 1000 AS avg_weld_cur, CAST(o_custkey % 12 AS DOUBLE) AS avg_weld_volt,
        CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 < 8 THEN 0.0 ELSE o_totalprice / 100 END AS loss_weight
        FROM orders""",
    ),
    "flow": (
        (),
        f"""SELECT event_id, 'HW' || CAST(user_id AS VARCHAR) AS hardware_id, CAST(ts AS DATE) AS business_date, ts AS tm,
        {_SECOND} * (user_id % 3 + 1) AS tenths,
        CASE WHEN event_id % 9 <> 0 THEN {_SECOND} * (user_id % 3 + 1) END AS gappy_tenths FROM events""",
    ),
    "mach": (
        (),
        """SELECT s_suppkey AS mid, CASE s_suppkey % 4 WHEN 0 THEN ' M -' WHEN 1 THEN 'M - ' ELSE 'M-' END
            || CAST(s_suppkey AS VARCHAR) AS raw_name, 'M-' || CAST(s_suppkey AS VARCHAR) AS name,
        'HW' || CAST(s_suppkey AS VARCHAR) AS hardware_id, s_nationkey % 3 + 1 AS mtid,
        CASE s_nationkey % 3 WHEN 0 THEN 'GMAW' WHEN 1 THEN 'CLAD' ELSE 'GASCUTTING' END AS machine_type_name,
        s_acctbal < 0 AS deleted FROM supplier""",
    ),
    "usr": (
        (),
        """SELECT CAST(c_custkey AS BIGINT) AS uid, c_name AS name, 'user' || CAST(c_custkey AS VARCHAR)
            || CASE c_nationkey % 3 WHEN 0 THEN '@plant.example' WHEN 1 THEN '@sub.plant.example' ELSE '@other.example' END AS email,
        c_nationkey % 3 < 2 AS is_company_email,
        CASE WHEN c_custkey % 11 = 0 THEN 9999999999 ELSE c_custkey + 7000000000 END AS phno,
        CAST(c_nationkey % 5 AS BIGINT) AS roleid,
        CASE c_nationkey % 5 WHEN 1 THEN 'Staff/Engineer' WHEN 3 THEN 'Operator' WHEN 4 THEN 'Admin/Manager' END AS role_name,
        'u' || CAST(c_custkey AS VARCHAR) AS username, c_acctbal < 0 AS deleted, c_mktsegment <> 'BUILDING' AS active_status,
        c_custkey % 11 = 0 OR c_nationkey % 3 = 2 AS is_test_account FROM customer""",
    ),
}


def with_tables(*names: str, body: str) -> str:
    """DuckDB query ``body`` over the named projections."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        needed, definition = SQL[name]
        for n in needed:
            add(n)
        ordered.setdefault(name, definition)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({d})" for n, d in ordered.items()) + "\n" + body


def sql_round(numerator: str, denominator: str, places: int) -> str:
    """Exact half-away rounding of numerator / (denominator * 10^6), in integers."""
    unit, scale = 10**places, 10**6
    top = f"(2 * abs({numerator}) * {unit} + ({denominator}) * {scale})"
    return (
        f"CASE WHEN ({denominator}) > 0 THEN CAST(sign({numerator}) * ({top} // (2 * ({denominator}) * {scale})) AS DOUBLE)"
        f" / {unit} END"
    )


def sql_sum(expression: str) -> str:
    return f"sum(CAST(round(({expression}) * 1000000) AS HUGEINT))"


def sql_mean(expression: str, places: int) -> str:
    return sql_round(sql_sum(expression), f"CAST(count({expression}) AS HUGEINT)", places)


def sql_total(expression: str, places: int, divisor: int = 1) -> str:
    return sql_round(sql_sum(expression), f"CAST({divisor} AS HUGEINT)", places)
