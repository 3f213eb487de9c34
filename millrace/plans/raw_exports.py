"""From the headerless raw exports to the cleaned extracts the load plan reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import cleaning, derive
from millrace.sources import readers, schemas, sinks

# Cleaned users by bucket; only the first is loaded.
USER_EXTRACTS = {"main": "dim_users", "test": "dim_users_test", "deleted": "dim_users_deleted"}


def machine_types(raw: DataFrame) -> DataFrame:
    return cleaning.clean_table(raw, schemas.DIM_MACHINE_TYPE)


def machines(raw: DataFrame, types: DataFrame) -> DataFrame:
    """Tidy names, type name and flags from the type id, booleans from letters."""
    decoded = cleaning.decode_letters(cleaning.normalise_nulls(raw), ("notify", "deleted"))
    typed = cleaning.align(cleaning.tidy_machine_names(decoded, "name"), schemas.DIM_MACHINES)
    flagged = cleaning.add_type_flags(typed.drop("machine_type_name"), types)
    return flagged.select(*schemas.schema_of(schemas.DIM_MACHINES).fieldNames())


def work_periods(raw: DataFrame, known_machines: DataFrame) -> DataFrame:
    """Tidy names, machine id by name, totals, validity and efficiencies."""
    typed = cleaning.clean_table(cleaning.tidy_machine_names(raw), schemas.DERIVED_GMAW)
    verified = cleaning.add_verified_machine(typed, known_machines)
    derived = derive.derive_work_periods(verified)
    return derived.select(*schemas.schema_of(schemas.DERIVED_GMAW).fieldNames())


def clean_exports(spark: SparkSession, folder: str, company_domain: str) -> dict[str, DataFrame]:
    """Extract name to cleaned rows; credentials are never read from the user export."""
    raw = {name: readers.read_raw(spark, f"{folder}/{name}.csv", name) for name in schemas.RAW_LAYOUTS}
    types = machine_types(raw["machine_type"])
    known = machines(raw["machines"], types)
    users = cleaning.clean_users(raw["user"], company_domain).withColumn("bucket", cleaning.user_bucket())
    extracts = {
        "dim_machine_type": types,
        "dim_machines": known,
        "fact_machine_derived_gmaw": work_periods(raw["machine_derived"], known),
    }
    for bucket, name in USER_EXTRACTS.items():
        extracts[name] = users.where(users["bucket"] == bucket).drop("bucket")
    return extracts


def write_extracts(extracts: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in extracts.items():
        sinks.write_csv(df, f"{folder}/{name}.csv")
