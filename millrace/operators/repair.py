"""Repairs of loaded tables: unit lookups, keyed updates, column drops.

Files are immutable, so each repair is a new DataFrame; ``sources.sinks.rewrite``
puts it in place of the old one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions import text
from millrace.sources import schemas

# Unit by parameter, in both spellings the sources use.
UNIT_OF = {
    "current": "A",
    "voltage": "V",
    "gas": "L/min",
    "weld_cur": "A",
    "weld_volt": "V",
    "weld_gas": "L/min",
    "hs_temp": "°C",
    "amb_temp": "°C",
    "motor_cur": "A",
    "motor_volt": "V",
}
# The spellings the SQL repair knows.
SENSOR_UNIT_OF = {k: UNIT_OF[k] for k in ("weld_cur", "weld_volt", "weld_gas", "hs_temp", "amb_temp")}

# Columns that hold nothing and are dropped after loading.
OBSOLETE_COLUMNS = {
    schemas.PERIODIC_GMAW: (
        "motor_cur", "motor_volt", "weight", "dis", "health_status_lpg_flow_meter",
        "health_status_o2_flow_meter1", "health_status_o2_flow_meter2", "cut_mm_mtr", "type", "created_at",
    ),
    schemas.SUMMARY_CLAD: ("on_cur", "off_cur", "on_volt", "off_volt", "on_weight", "off_weight"),
    schemas.PERIODIC_GASCUTTING: (
        "high_weld_cur_threshold", "low_weld_cur_threshold", "type", "created_at",
    ),
}


def unit_for(parameter: Column | str, mapping: Mapping[str, str] = UNIT_OF) -> Column:
    """Unit of a parameter, ignoring case and surrounding whitespace; NULL when unknown."""
    return text.lookup(F.lower(text.strip(parameter)), mapping)


def fill_units(df: DataFrame, parameter: str = "parameter", unit: str = "parameter_unit") -> DataFrame:
    """Overwrite the unit column; unknown parameters lose their unit."""
    return df.withColumn(unit, unit_for(parameter))


def update_units(df: DataFrame, parameter: str = "parameter", unit: str = "parameter_unit") -> DataFrame:
    """As an UPDATE per known parameter: matched ignoring case only, other rows untouched."""
    return df.withColumn(unit, F.coalesce(text.lookup(F.lower(parameter), UNIT_OF), F.col(unit)))


def update_unit_counts(df: DataFrame, parameter: str = "parameter") -> DataFrame:
    """Rows each of those updates would touch."""
    known = F.lower(parameter).alias("parameter")
    return (
        df.select(known)
        .where(F.col("parameter").isin(*UNIT_OF))
        .groupBy("parameter")
        .agg(F.count("*").alias("rows_updated"))
    )


def label_units(
    df: DataFrame, parameter: str = "parameter", unit: str = "parameter_unit", other: str = "unknown"
) -> DataFrame:
    """Exact spellings only; everything else gets a label."""
    return df.withColumn(unit, F.coalesce(text.lookup(parameter, SENSOR_UNIT_OF), F.lit(other)))


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row that comes last within each key.

    Spark trims each key to one row per task before the shuffle (WindowGroupLimit).
    """
    rank = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).where("_rank <= 1").drop("_rank")


def keyed_update(
    target: DataFrame,
    patch: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    newest_first: Sequence[Column] | None = None,
    skip_null: bool = False,
    changed: str | None = None,
) -> DataFrame:
    """Replace ``columns`` of the target rows whose key occurs in the patch.

    One outer join instead of one UPDATE per row. The patch must hold a key once;
    otherwise pass ``newest_first`` and the newest row wins. ``changed`` adds a
    flag that is true only where a value really differs, so a second run of the
    same patch changes nothing. The join strategy is Spark's: small patches are
    broadcast from their measured size, large ones shuffle with skewed keys split.
    """
    if newest_first is not None:
        patch = last_per_key(patch, keys, newest_first)
    renamed = {c: f"_new_{c}" for c in columns}
    side = patch.select(*keys, *[F.col(c).alias(n) for c, n in renamed.items()], F.lit(True).alias("_hit"))
    joined = target.join(side, list(keys), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    new, differs = {}, F.lit(False)
    for c, n in renamed.items():
        use = hit & F.col(n).isNotNull() if skip_null else hit
        new[c] = F.when(use, F.col(n)).otherwise(F.col(c))
        differs = differs | (use & ~F.col(n).eqNullSafe(F.col(c)))
    out = [new.get(c, F.col(c)).alias(c) for c in target.columns]
    if changed:
        out.append(differs.alias(changed))
    return joined.select(*out)


def drop_obsolete(df: DataFrame, table: str) -> DataFrame:
    """Names the table does not have are ignored."""
    return df.drop(*OBSOLETE_COLUMNS.get(table, ()))
