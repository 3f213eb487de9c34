"""The eight stored views, as functions of the base tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from millrace.operators import filters, kpis
from millrace.sources import schemas
from millrace.sources.catalog import register

Tables = Mapping[str, DataFrame]


def shift_efficiency(tables: Tables) -> DataFrame:
    """Work periods of the welding machines under report names."""
    periods = filters.of_machine_type(tables[schemas.DERIVED_GMAW], "GMAW")
    return periods.select(
        "business_date",
        "shift_name",
        "machine_name",
        F.col("active").alias("active_minutes"),
        F.col("idle").alias("idle_minutes"),
        F.col("breakdown").alias("breakdown_minutes"),
        "arc_efficiency_pct",
        "deposit",
        "target_deposit",
        "deposit_efficiency_pct",
    )


# Name of the view, table it reads, definition.
VIEWS: dict[str, tuple[str, Callable[[Tables], DataFrame]]] = {
    "reference.v_users_safe": (schemas.DIM_USERS, lambda t: filters.safe_users(t[schemas.DIM_USERS])),
    "gmaw.fact_deviation_gmaw": (
        schemas.DEVIATION,
        lambda t: filters.of_machine_type(t[schemas.DEVIATION], "GMAW"),
    ),
    "clad.fact_deviation_clad": (
        schemas.DEVIATION,
        lambda t: filters.of_machine_type(t[schemas.DEVIATION], "CLAD"),
    ),
    "gmaw.v_gmaw_shift_efficiency": (schemas.DERIVED_GMAW, shift_efficiency),
    "gmaw.v_gmaw_sensor_averages": (
        schemas.PERIODIC_GMAW,
        lambda t: kpis.sensor_averages(t[schemas.PERIODIC_GMAW]),
    ),
    "reference.v_deviation_summary": (
        schemas.DEVIATION,
        lambda t: kpis.deviation_summary(t[schemas.DEVIATION]),
    ),
    "gascutting.v_gascutting_productivity": (
        schemas.SUMMARY_GASCUTTING,
        lambda t: kpis.cutting_productivity(t[schemas.SUMMARY_GASCUTTING]),
    ),
    "clad.v_clad_session_summary": (
        schemas.SUMMARY_CLAD,
        lambda t: kpis.session_summary(t[schemas.SUMMARY_CLAD]),
    ),
}


def view(name: str, tables: Tables) -> DataFrame:
    return VIEWS[name][1](tables)


def all_views(tables: Tables) -> dict[str, DataFrame]:
    """Views whose base table is present, plus ``v_valid_<table>`` for every table
    with mandatory filters."""
    found = {name: define(tables) for name, (base, define) in VIEWS.items() if base in tables}
    for table in filters.MANDATORY:
        if table in tables:
            schema, bare = table.split(".")
            found[f"{schema}.v_valid_{bare}"] = filters.valid_rows(tables[table], table)
    return found


def register_all(tables: Tables) -> list[str]:
    """Register tables and views for SQL; returns every qualified name."""
    frames = {**tables, **all_views(tables)}
    register(frames)
    return list(frames)
