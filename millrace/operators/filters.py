"""Row filters every report must apply, kept in one registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import text
from millrace.sources import schemas

# Flags a row must carry before it may enter a KPI.
MANDATORY = {
    schemas.PERIODIC_GMAW: {"is_welding": True},
    schemas.SUMMARY_GASCUTTING: {"timer_overflow": False, "travel_outlier": False},
    schemas.NONCUTTING: {"speed_unreliable": False},
    schemas.SUMMARY_CLAD: {"is_instantaneous": False},
    schemas.DIM_USERS: {"deleted": False, "is_test_account": False},
}

SAFE_USER_COLUMNS = (
    "uid", "name", "roleid", "role_name", "orgid", "hid", "operator_rfid", "username", "active_status",
)

# Efficiencies outside this range are artefacts.
EFFICIENCY_RANGE = (0, 200)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def is_valid(table: str) -> Column:
    """Mandatory condition of a table; an unknown flag fails it."""
    return all_of([F.col(c) == v for c, v in MANDATORY.get(table, {}).items()])


def valid_rows(df: DataFrame, table: str) -> DataFrame:
    return df.where(is_valid(table)) if table in MANDATORY else df


def safe_users(users: DataFrame) -> DataFrame:
    """The only user-facing projection: no e-mail, no phone."""
    return valid_rows(users, schemas.DIM_USERS).select(*SAFE_USER_COLUMNS)


def of_machine_type(df: DataFrame, machine_type: str) -> DataFrame:
    return df.where(F.col("machine_type") == machine_type)


def plausible_efficiency(c: Column | str = "arc_efficiency_pct") -> Column:
    """Inclusive; a missing efficiency does not pass."""
    return text.col(c).between(*EFFICIENCY_RANGE)


def differs(a: Column | str, b: Column | str) -> Column:
    """IS DISTINCT FROM."""
    return ~text.col(a).eqNullSafe(text.col(b))


def shows_fraction(c: Column | str) -> Column:
    """A number whose text carries a decimal point."""
    return text.col(c).cast("string").like("%.%")
