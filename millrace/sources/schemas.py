"""Star schema of the plant: three dimensions and seven facts.

Column names, types, lengths and required columns are fixed values: they must
equal those of the tables users already have. They are written as Spark DDL so
that Spark itself reads them; ``schema_of`` gives the parsed form.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import types as T

DIM_MACHINE_TYPE = "reference.dim_machine_type"
DIM_MACHINES = "reference.dim_machines"
DIM_USERS = "reference.dim_users"
DEVIATION = "gmaw.fact_deviation"
PERIODIC_GMAW = "gmaw.fact_periodic_gmaw"
DERIVED_GMAW = "gmaw.fact_machine_derived_gmaw"
PERIODIC_GASCUTTING = "gascutting.fact_periodic_gascutting"
SUMMARY_GASCUTTING = "gascutting.fact_summarize_gascutting"
NONCUTTING = "gascutting.fact_summarize_gascutting_noncutting"
SUMMARY_CLAD = "clad.fact_summarize_clad"

DDL = {
    DIM_MACHINE_TYPE: """
        mtid SMALLINT NOT NULL, machine_type_name VARCHAR(20) NOT NULL, is_active BOOLEAN NOT NULL,
        created_at TIMESTAMP, updated_at TIMESTAMP""",
    DIM_MACHINES: """
        mid SMALLINT NOT NULL, name VARCHAR(50) NOT NULL, hardware_id VARCHAR(20) NOT NULL, des VARCHAR(100),
        mtid SMALLINT NOT NULL, machine_type_name VARCHAR(20) NOT NULL,
        is_gmaw BOOLEAN NOT NULL, is_clad BOOLEAN NOT NULL, is_gascutting BOOLEAN NOT NULL,
        msid INT, hid INT, orgid INT, mcsid INT, mcid INT, rpm_multiplication_factor DOUBLE,
        notify BOOLEAN, deleted BOOLEAN NOT NULL, created_at TIMESTAMP, updated_at TIMESTAMP""",
    DIM_USERS: """
        uid INT NOT NULL, name VARCHAR(100) NOT NULL, email VARCHAR(150), is_company_email BOOLEAN, phno BIGINT,
        roleid SMALLINT, role_name VARCHAR(30), hid INT, orgid INT, certificate_id VARCHAR(50),
        identification_no VARCHAR(50), operator_rfid VARCHAR(50), username VARCHAR(100),
        deleted BOOLEAN NOT NULL, active_status BOOLEAN NOT NULL, is_test_account BOOLEAN NOT NULL,
        created_at TIMESTAMP, updated_at TIMESTAMP""",
    DEVIATION: """
        hardware_id VARCHAR(20), mid SMALLINT, machine_name VARCHAR(50), machine_type VARCHAR(20),
        oid VARCHAR(20), shid VARCHAR(20), start_tm TIMESTAMP, end_tm TIMESTAMP,
        span_seconds DOUBLE, span_raw DOUBLE, type VARCHAR(10), parameter VARCHAR(30),
        deviation_label VARCHAR(60), parameter_unit VARCHAR(10), is_gmaw BOOLEAN, is_clad BOOLEAN""",
    PERIODIC_GMAW: """
        pdid VARCHAR(50), business_date DATE, shift_name VARCHAR(10), machine_type VARCHAR(20),
        machine_name VARCHAR(50), hardware_id VARCHAR(20), job_name VARCHAR(100), tm TIMESTAMP,
        weld_cur DOUBLE COMMENT 'A', weld_volt DOUBLE COMMENT 'V', weld_gas DOUBLE COMMENT 'L/min',
        hs_temp DOUBLE COMMENT '°C', amb_temp DOUBLE COMMENT '°C', rpm DOUBLE COMMENT 'RPM',
        is_idle BOOLEAN, is_welding BOOLEAN, mstatus VARCHAR(20),
        current_deviation_flag VARCHAR(15), voltage_deviation_flag VARCHAR(15), gas_deviation_flag VARCHAR(15),
        network DOUBLE COMMENT 'dBm', oid VARCHAR(20),
        high_weld_cur_threshold DOUBLE, low_weld_cur_threshold DOUBLE,
        high_weld_volt_threshold DOUBLE, low_weld_volt_threshold DOUBLE,
        high_weld_gas_threshold DOUBLE, low_weld_gas_threshold DOUBLE,
        thickness DOUBLE COMMENT 'mm', cut_mm_mtr DOUBLE, type VARCHAR(20)""",
    DERIVED_GMAW: """
        business_date DATE, shift_name VARCHAR(10), machine_type VARCHAR(20), machine_name VARCHAR(50),
        oid VARCHAR(20), period_start_time VARCHAR(30), period_end_time VARCHAR(30),
        active DOUBLE COMMENT 'min', idle DOUBLE COMMENT 'min', inrepair DOUBLE COMMENT 'min',
        breakdown DOUBLE COMMENT 'min', target_arc_time DOUBLE COMMENT 'min',
        deposit DOUBLE COMMENT 'g', target_deposit DOUBLE COMMENT 'g',
        unknown_a DOUBLE, unknown_b DOUBLE, unknown_c DOUBLE,
        mid SMALLINT, machine_type_verified VARCHAR(20), total_accounted_minutes DOUBLE,
        time_allocation_valid BOOLEAN, arc_efficiency_pct DOUBLE, deposit_efficiency_pct DOUBLE""",
    PERIODIC_GASCUTTING: """
        pdid VARCHAR(50), business_date DATE, shift_name VARCHAR(10), machine_type VARCHAR(20),
        machine_name VARCHAR(50), hardware_id VARCHAR(20), job_name VARCHAR(100), tm TIMESTAMP,
        mstatus VARCHAR(20), lpg_flow DOUBLE COMMENT 'L/min', o2_flow_meter1 DOUBLE COMMENT 'L/min',
        o2_flow_meter2 DOUBLE COMMENT 'L/min', total_lpg_consumption DOUBLE COMMENT 'running counter, L',
        total_o2_consumption_meter1 DOUBLE COMMENT 'running counter, L',
        total_o2_consumption_meter2 DOUBLE COMMENT 'running counter, L',
        travel_in_mm DOUBLE COMMENT 'mm', position_x DOUBLE COMMENT 'mm', position_y DOUBLE COMMENT 'mm',
        is_cutting BOOLEAN, lpg_below_detection BOOLEAN, health_status_lpg_flow_meter VARCHAR(20),
        health_status_o2_flow_meter1 VARCHAR(20), health_status_o2_flow_meter2 VARCHAR(20),
        thickness DOUBLE COMMENT 'mm', cut_mm_mtr DOUBLE,
        high_weld_cur_threshold DOUBLE, low_weld_cur_threshold DOUBLE""",
    SUMMARY_GASCUTTING: """
        business_date DATE, shift_name VARCHAR(10), machine_type VARCHAR(20), machine_name VARCHAR(50),
        on_time TIMESTAMP, off_time TIMESTAMP, time_span VARCHAR(30), time_span_seconds DOUBLE,
        timer_overflow BOOLEAN, travel_outlier BOOLEAN, no_cutting BOOLEAN,
        net_travel_in_mm DOUBLE COMMENT 'mm', mm_per_min DOUBLE COMMENT 'mm/min', speed_valid BOOLEAN,
        thickness DOUBLE COMMENT 'mm', thickness_recorded BOOLEAN, cut_mm_mtr DOUBLE,
        net_lpg_consumption DOUBLE COMMENT 'L', lpg_below_detection BOOLEAN,
        net_o2_consumption_meter1 DOUBLE COMMENT 'L', net_o2_consumption_meter2 DOUBLE COMMENT 'L',
        total_o2_consumption DOUBLE COMMENT 'L'""",
    NONCUTTING: """
        business_date DATE, shift_name VARCHAR(10), machine_type VARCHAR(20), machine_name VARCHAR(50),
        operation_category VARCHAR(20), on_time TIMESTAMP, off_time TIMESTAMP,
        time_span VARCHAR(30), time_span_seconds DOUBLE,
        is_instantaneous BOOLEAN, timer_overflow BOOLEAN, no_movement BOOLEAN,
        net_travel_in_mm DOUBLE COMMENT 'mm', mm_per_min DOUBLE COMMENT 'mm/min', speed_unreliable BOOLEAN,
        total_lpg_cons DOUBLE COMMENT 'L', lpg_below_detection BOOLEAN, total_heating_o2 DOUBLE COMMENT 'L'""",
    SUMMARY_CLAD: """
        business_date DATE, shift_name VARCHAR(10), machine_type VARCHAR(20), machine_name VARCHAR(50),
        oid VARCHAR(20), ontime TIMESTAMP, offtime TIMESTAMP, time_span VARCHAR(30),
        time_span_seconds DOUBLE, computed_duration_sec DOUBLE, is_instantaneous BOOLEAN,
        avg_weld_cur DOUBLE COMMENT 'A', cur_range VARCHAR(15), avg_weld_volt DOUBLE COMMENT 'V',
        volt_range VARCHAR(15), loss_weight DOUBLE COMMENT 'g'""",
}

# Keys, references, defaults, expected sizes.
PRIMARY_KEYS = {DIM_MACHINE_TYPE: ["mtid"], DIM_MACHINES: ["mid"], DIM_USERS: ["uid"]}
UNIQUE_KEYS = {DIM_MACHINES: [["hardware_id"]]}
FOREIGN_KEYS = {
    DIM_MACHINES: [("mtid", DIM_MACHINE_TYPE, "mtid")],
    DEVIATION: [("mid", DIM_MACHINES, "mid")],
    DERIVED_GMAW: [("mid", DIM_MACHINES, "mid")],
}
# A default stands in for a column the input lacks, never for a NULL it holds.
DEFAULTS = {
    DIM_MACHINE_TYPE: {"is_active": True},
    DIM_MACHINES: {"is_gmaw": False, "is_clad": False, "is_gascutting": False, "deleted": False},
    DIM_USERS: {"deleted": False, "active_status": False, "is_test_account": False},
    PERIODIC_GMAW: {"machine_type": "GMAW"},
    DERIVED_GMAW: {"machine_type": "GMAW"},
    PERIODIC_GASCUTTING: {"machine_type": "GASCUTTING"},
    SUMMARY_GASCUTTING: {"machine_type": "GASCUTTING"},
    NONCUTTING: {"machine_type": "GASCUTTING", "operation_category": "non_cutting"},
    SUMMARY_CLAD: {"machine_type": "CLAD"},
}
EXPECTED_ROWS = {
    DIM_MACHINE_TYPE: 3,
    DIM_MACHINES: 17,
    DIM_USERS: 15,
    DEVIATION: 48_111,
    DERIVED_GMAW: 11,
    PERIODIC_GMAW: 79_126,
    SUMMARY_CLAD: 25_935,
    PERIODIC_GASCUTTING: 20_874,
    SUMMARY_GASCUTTING: 43_133,
    NONCUTTING: 29_547,
}

# The machine types and the order in which bare names are looked up.
MACHINE_TYPES = {1: "GMAW", 2: "CLAD", 3: "GASCUTTING"}
SEARCH_PATH = ("gmaw", "gascutting", "clad", "reference", "public")

# Admissible texts.
SHIFTS = ("A", "B", "C")
DEVIATION_FLAGS = ("none", "single", "sustained")
DIRECTIONS = ("high", "low")
RANGE_LABELS = ("zero", "low", "normal", "high", "very_high")
UNITS = ("A", "V", "L/min", "°C")
DOMAINS = {
    DEVIATION: {
        "machine_type": tuple(MACHINE_TYPES.values()),
        "type": DIRECTIONS,
        "parameter_unit": UNITS,
    },
    PERIODIC_GMAW: {
        "shift_name": SHIFTS,
        "current_deviation_flag": DEVIATION_FLAGS,
        "voltage_deviation_flag": DEVIATION_FLAGS,
        "gas_deviation_flag": DEVIATION_FLAGS,
    },
    DERIVED_GMAW: {"shift_name": SHIFTS, "machine_type": tuple(MACHINE_TYPES.values())},
    PERIODIC_GASCUTTING: {"shift_name": ("A", "B")},
    SUMMARY_GASCUTTING: {"shift_name": ("A", "B")},
    NONCUTTING: {"shift_name": ("A", "B")},
    SUMMARY_CLAD: {"shift_name": SHIFTS, "cur_range": RANGE_LABELS, "volt_range": RANGE_LABELS},
}

# Columns by position in the headerless exports. Names in
# parentheses are credentials or empty and are dropped on reading.
RAW_LAYOUTS = {
    "machine_type": ["mtid", "machine_type_name", "created_at", "updated_at"],
    "machines": [
        "mid", "name", "hardware_id", "des", "msid", "mtid", "hid", "orgid", "mcsid", "mcid",
        "rpm_multiplication_factor", "notify", "deleted", "created_at", "updated_at",
    ],
    "machine_derived": [
        "business_date", "shift_name", "machine_type", "machine_name", "oid", "period_start_time",
        "period_end_time", "active", "idle", "inrepair", "breakdown", "target_arc_time", "unknown_a",
        "deposit", "unknown_b", "target_deposit", "unknown_c",
    ],
    "user": [
        "uid", "name", "email", "phno", "roleid", "hid", "orgid", "certificate_id", "identification_no",
        "(password)", "(empty)", "operator_rfid", "deleted", "created_at", "updated_at", "username",
        "(session)", "active_status", "(reset1)", "(reset2)", "(reset3)", "(reset4)",
    ],
}


@cache
def schema_of(table: str) -> T.StructType:
    """Parsed schema; VARCHAR(n) and NOT NULL survive as checks for ``operators.quality``."""
    return T.StructType.fromDDL(DDL[table])


def plain_type(field: T.StructField) -> T.DataType:
    """Type a DataFrame column takes; declared lengths are checked, not enforced."""
    return T.StringType() if isinstance(field.dataType, (T.VarcharType, T.CharType)) else field.dataType


def required_columns(table: str) -> list[str]:
    return [f.name for f in schema_of(table) if not f.nullable]


def length_limits(table: str) -> dict[str, int]:
    return {f.name: f.dataType.length for f in schema_of(table) if isinstance(f.dataType, T.VarcharType)}


def dependents(table: str) -> list[str]:
    """Tables that refer to this one; replacing it leaves them to be re-checked, never emptied."""
    return [child for child, keys in FOREIGN_KEYS.items() if any(parent == table for _, parent, _ in keys)]
