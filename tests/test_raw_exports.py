"""Raw exports through cleaning, load and repair, on made-up machines and users."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import quality
from millrace.plans import load, raw_exports, repairs
from millrace.sources import readers, schemas, sinks

STAMP = "2031-11-05 09:08:07.65432+05:30"
RAW = {
    "machine_type": [f"1,GMAW,{STAMP},{STAMP}", f"2,CLAD,{STAMP},{STAMP}", f"3,GASCUTTING,{STAMP},{STAMP}"],
    "machines": [
        f"71,Torch -5,00QX9,WELDING,2,1,4,1,1,1,2.5,f,f,{STAMP},{STAMP}",
        f"72,Roller,00QX8,CLADDING,1,2,4,1,1,1,1,t,f,{STAMP},{STAMP}",
    ],
    "machine_derived": [
        "2031-11-06 00:00:00+05:30,C,GMAW,Torch -5,00900017,22:30:00+05:30,23:45:00+05:30,200,40,5,15,0,20,8,10,40,0",
        "2031-11-06 00:00:00+05:30,A,GMAW,Torch-6,00000009,07:00:00+05:30,08:30:00+05:30,90,10,0,50,30,4,6,2,0,0",
    ],
    "user": [
        ",".join([str(i), f"n{i}", f"N{i}@{host}.example", phone, "3", "4", "1", "", "", "secret", "", "", deleted, STAMP, STAMP, f"u{i}", "token", "t", "r", "r", "r", "r"])
        for i, host, phone, deleted in (
            (1, "Plant", "7000000001", "f"), (2, "plant", "9999999999", "f"), (3, "other", "7000000003", "t"),
        )
    ],
}


@pytest.fixture
def folders(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for name, lines in RAW.items():
        (raw / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(raw), str(tmp_path / "clean"), str(tmp_path / "tables")


def test_raw_to_stored_tables(spark, folders, values):
    raw, clean, root = folders
    extracts = raw_exports.clean_exports(spark, raw, "plant.example")
    assert "secret" not in str([r for df in extracts.values() for r in df.collect()])
    assert {n: extracts[n].count() for n in raw_exports.USER_EXTRACTS.values()} == {"dim_users": 1, "dim_users_test": 1, "dim_users_deleted": 1}
    raw_exports.write_extracts(extracts, clean)
    report = load.run_load(spark, clean, root)
    assert report.where("status = 'ok'").count() == 4 and report.where("errors > 0").count() == 0

    tables = load.stored_tables(spark, root)
    machine = tables[schemas.DIM_MACHINES].where("mid = 71").first()
    assert (machine.name, machine.hardware_id, machine.machine_type_name) == ("Torch-5", "00QX9", "GMAW")
    assert (machine.is_gmaw, machine.is_clad, machine.notify, machine.deleted) == (True, False, False, False)
    written = tables[schemas.DIM_MACHINES].select(F.unix_micros("created_at")).first()[0]
    assert written == int(dt.datetime(2031, 11, 5, 3, 38, 7, 654320, dt.UTC).timestamp() * 1_000_000)
    periods = values(
        tables[schemas.DERIVED_GMAW],
        "machine_name", "oid", "business_date", "mid", "machine_type_verified", "total_accounted_minutes", "arc_efficiency_pct", "deposit_efficiency_pct",
    )
    day = dt.date(2031, 11, 6)
    assert periods == [
        ("Torch-5", "00900017", day, 71, "GMAW", 260.0, None, 20.0),
        ("Torch-6", "00000009", day, None, None, 150.0, 300.0, None),
    ]
    for table, df in tables.items():
        assert quality.constraint_report(table, tables).where("violations > 0").count() == 0, table


def test_repairs(spark, folders, values):
    root = folders[2]
    rows = [("h", 1, "current", "x"), ("h", 2, "xyz", None), ("g", 3, " GAS ", None)]
    deviations = spark.createDataFrame(rows, "hardware_id string, mid int, parameter string, parameter_unit string")
    sinks.write_table(deviations, readers.table_path(root, schemas.DEVIATION))
    assert values(repairs.repair_units(spark, root)) == [("after", 3, 1), ("before", 3, 2)]
    # A key that repeats: its last row counts, and no stored row is multiplied.
    rows = [("h", "current", 8, 1), ("h", "current", 9, 2), ("h", "xyz", None, 3)]
    patch = spark.createDataFrame(rows, "hardware_id string, parameter string, mid int, line int")
    newest = [F.desc("line")]
    keys = ["hardware_id", "parameter"]
    assert repairs.apply_patch(spark, root, schemas.DEVIATION, patch, keys, ["mid"], newest) == 1
    assert repairs.apply_patch(spark, root, schemas.DEVIATION, patch, keys, ["mid"], newest) == 0
    assert values(readers.read_table(spark, schemas.DEVIATION, root), "mid", "parameter_unit") == [(2, None), (3, "L/min"), (9, "A")]
    status = {r.label: r.status for r in repairs.verify_repairs(spark, root).collect()}
    assert status["parameter_unit missing"] == "fail" and status["mid present"] == "found"

    assert repairs.all_passed(repairs.verify_repairs(spark, root)).first()[0] is False
    for table, rows, columns in (
        (schemas.DEVIATION, [("A", 1), ("V", 2), ("L/min", 3)], "parameter_unit string, mid int"),
        (schemas.DIM_USERS, [(7000000001,)], "phno long"),
    ):
        sinks.rewrite(spark.createDataFrame(rows, columns), readers.table_path(root, table))
    assert repairs.all_passed(repairs.verify_repairs(spark, root)).first()[0] is True

    readings = spark.createDataFrame([(1.0, 2.0, "x")], "weld_cur double, cut_mm_mtr double, type string")
    path = readers.table_path(root, schemas.PERIODIC_GMAW)
    sinks.write_table(readings, path)
    repairs.drop_obsolete_columns(spark, root)
    assert readers.read_stored(spark, path).columns == ["weld_cur"]
