"""Views kept up by day: stored states of the aggregates, renewed only for the days that were loaded.

A view's states are a table by business day like the facts. After days of a fact
were loaded or patched, ``refresh`` reads these days alone and replaces their
states; ``read`` merges the states it needs, some rows a day instead of all
readings. Every day costs one small file, ten years some 3,650: where days have
few rows, computing a view from the fact is as good.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators import kpis, states
from millrace.operators.filters import valid_rows
from millrace.sources import readers, schemas, sinks

DAY = readers.DAY


@dataclass(frozen=True)
class DailyView:
    """A view over one fact: the rows it takes, the finest groups it is asked for, its measures."""

    table: str
    rows: Callable[[DataFrame], DataFrame]
    keys: Sequence[str]
    measures: Callable[[], list[states.Measure]]


VIEWS: dict[str, DailyView] = {
    "gmaw.v_gmaw_sensor_averages": DailyView(
        schemas.PERIODIC_GMAW, lambda df: valid_rows(df, schemas.PERIODIC_GMAW), kpis.SHIFT_KEYS, kpis.sensor_measures
    ),
    "reference.v_deviation_summary": DailyView(
        schemas.DEVIATION, lambda df: df.withColumnRenamed("type", "deviation_direction"), kpis.DEVIATION_KEYS, kpis.deviation_measures
    ),
    "gascutting.v_gascutting_productivity": DailyView(
        schemas.SUMMARY_GASCUTTING, lambda df: valid_rows(df, schemas.SUMMARY_GASCUTTING), kpis.SHIFT_KEYS, kpis.cutting_measures
    ),
    "clad.v_clad_session_summary": DailyView(schemas.SUMMARY_CLAD, lambda df: df, kpis.SHIFT_KEYS, kpis.session_measures),
}


def states_path(root: str, name: str) -> str:
    return readers.table_path(root, f"{name}__by_day")


def refresh(name: str, tables: Mapping[str, DataFrame], root: str, days: Sequence | None = None) -> int:
    """Bring a view's states up to date for ``days`` (None among them: rows without a day); returns the rows of states written.

    Without ``days``, or where no states are stored yet, all days are computed.
    Only the files of these days are read and only their states are replaced; a
    day that has no rows any more loses its states.
    """
    view = VIEWS[name]
    fact = tables[view.table]
    path = states_path(root, name)
    whole = days is None or not sinks.has_table(fact.sparkSession, path)
    rows = view.rows(fact if whole else sinks.of_days(fact, days))
    keys = [DAY, *[k for k in view.keys if k != DAY]]
    by_day = states.states(rows, keys, view.measures())
    return sinks.rewrite(by_day, path) if whole else sinks.rewrite_days(by_day, path, days)


def read(spark: SparkSession, name: str, root: str, keys: Sequence[str] | None = None, since=None) -> DataFrame:
    """The view from its stored states, by its own ``keys`` or coarser ones, optionally from a day on."""
    view = VIEWS[name]
    stored = readers.read_stored(spark, states_path(root, name))
    kept = stored if since is None else stored.where(F.col(DAY) >= F.lit(since))
    return states.finished(kept, view.keys if keys is None else keys, view.measures())
