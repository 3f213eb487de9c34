import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import cleaning, derive, filters
from millrace.sources import readers, schemas, sinks


def texts(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def test_schemas_are_complete(spark):
    sizes = {t: len(schemas.schema_of(t)) for t in schemas.DDL}
    assert sorted(sizes.values()) == [5, 16, 16, 18, 18, 19, 22, 23, 27, 31]
    assert schemas.dependents(schemas.DIM_MACHINES) == [schemas.DEVIATION, schemas.DERIVED_GMAW]
    assert schemas.schema_of(schemas.PERIODIC_GMAW)["weld_cur"].metadata["comment"] == "A"


def test_alignment(spark):
    df = texts(
        spark,
        [("2031-11-06 00:00:00+05:30", "00712345", "71.0", "True", "1234.5", "NaN", "surplus")],
        ["BUSINESS_DATE", "Oid", "mid", "time_allocation_valid", "arc_efficiency_pct", "shift_name", "other"],
    )
    clean = cleaning.clean_table(df, schemas.DERIVED_GMAW)
    assert clean.columns == schemas.schema_of(schemas.DERIVED_GMAW).fieldNames()
    row = clean.first()
    assert row.business_date == dt.date(2031, 11, 6)
    assert (row.oid, row.mid, row.time_allocation_valid, row.arc_efficiency_pct) == ("00712345", 71, True, 1234.5)
    assert row.shift_name is None and row.machine_type == "GMAW" and row.deposit is None
    assert cleaning.clean_table(df, schemas.DERIVED_GMAW, legacy_ids=True).first().oid == "712345"


def test_offsets_name_one_instant(spark):
    df = texts(
        spark,
        [("1", "2024-07-04 05:30:00+05:30"), ("2", "2024-07-04 00:00:00+00:00")],
        ["mtid", "created_at"],
    )
    rows = cleaning.clean_table(df, schemas.DIM_MACHINE_TYPE).collect()
    assert rows[0].created_at == rows[1].created_at


def test_default_replaces_absent_columns_only(spark):
    df = texts(spark, [("1", None)], ["mtid", "is_active"])
    assert cleaning.clean_table(df, schemas.DIM_MACHINE_TYPE).first().is_active is None
    assert cleaning.clean_table(df.drop("is_active"), schemas.DIM_MACHINE_TYPE).first().is_active is True


def test_aliases(spark):
    df = texts(spark, [("1", "True")], ["uid", "works_here"])
    row = cleaning.clean_table(df, schemas.DIM_USERS, aliases={"works_here": "is_company_email"}).first()
    assert row.is_company_email is True


def test_drift(spark, values):
    df = texts(spark, [("1", "x")], ["MTID", "colour"])
    found = values(cleaning.drift(df, schemas.DIM_MACHINE_TYPE), "column_name", "status")
    assert ("colour", "extra") in found and ("created_at", "missing") in found and len(found) == 5


def test_rejections(spark, values):
    columns = ["mid", "name", "hardware_id", "mtid", "machine_type_name", "is_gmaw", "is_clad", "is_gascutting", "deleted"]
    good = ["1.0", "M-1", "HW1", "1", "GMAW", "true", "false", "false", "false"]
    rows = [good, ["x", *good[1:]], [*good[:2], "H" * 21, *good[3:]], [good[0], "NULL", *good[2:]], [*good[:5], "maybe", *good[6:]]]
    checked = cleaning.with_rejections(texts(spark, rows, columns), schemas.DIM_MACHINES)
    assert sinks.accepted(checked).count() == 1
    assert sinks.accepted(checked).columns == schemas.schema_of(schemas.DIM_MACHINES).fieldNames()
    assert values(sinks.quarantined(checked), "rejected") == [("hardware_id",), ("is_gmaw",), ("mid",), ("name",)]
    assert "x" in [r.mid for r in sinks.quarantined(checked).collect()]


def test_type_flags_and_verified_machines(spark, values):
    machines = spark.createDataFrame([(1, "Torch -1", 1), (2, "R1", 2), (3, "T1", 3), (9, "Torch-1", 2)], "mid int, name string, mtid int")
    machines = cleaning.tidy_machine_names(cleaning.add_type_flags(machines, readers.machine_types(spark)), "name")
    assert values(machines, "mid", "is_gmaw", "is_clad", "is_gascutting")[0] == (1, True, False, False)
    facts = spark.createDataFrame([("Torch-1",), ("Torch-4",), (None,)], "machine_name string")
    found = values(cleaning.add_verified_machine(facts, machines), "machine_name", "mid", "machine_type_verified")
    assert found == sorted([("Torch-1", 1, "GMAW"), ("Torch-4", None, None), (None, None, None)], key=repr)


@pytest.fixture
def users(spark):
    columns = ["uid", "name", "email", "phno", "roleid", "deleted", "active_status", "username"]
    rows = [
        ("1.0", "a", "A@Plant.example", "7000000001.0", "1", "f", "t", "ua"),
        ("2.0", "b", "b@sub.plant.example", "9999999999", "3", "f", "t", "ub"),
        ("3.0", "c", "c@elsewhere.example", "7000000003", "4", "f", "f", "uc"),
        ("4.0", "d", "d@otherplant.example", "9999999999", "9", "t", "t", "ud"),
        ("5.0", "e", None, None, None, "f", "f", "ue"),
    ]
    return cleaning.clean_users(texts(spark, rows, columns), "plant.example")


def test_users(users, values):
    assert values(users, "uid", "is_company_email", "role_name", "is_test_account") == [
        (1, True, "Staff/Engineer", False),
        (2, True, "Operator", True),
        (3, False, "Admin/Manager", True),
        (4, False, None, True),
        (5, False, None, True),
    ]
    assert [r.phno for r in users.orderBy("uid").collect()][:3] == [7000000001, 9999999999, 7000000003]
    assert users.where("uid = 1").first().email == "a@plant.example"


def test_buckets_partition_the_users(users):
    split = users.withColumn("bucket", cleaning.user_bucket())
    assert {r.uid: r.bucket for r in split.collect()} == {1: "main", 2: "test", 3: "test", 4: "deleted", 5: "test"}
    assert split.count() == users.count()


def test_safe_users_hide_contact_data(users):
    safe = filters.safe_users(users)
    assert [r.uid for r in safe.collect()] == [1]
    assert not {"email", "phno"} & set(safe.columns)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "a")], "k int, v string")
    assert cleaning.drop_duplicate_rows(df).count() == 3
    assert tuple(cleaning.duplicate_report(df).first()) == (4, 3, 1)


# Invented work periods around each branch of the formulas:
# active, idle, inrepair, breakdown, target_arc_time, deposit, target_deposit → total, valid, arc %, deposit %
PERIODS = [
    (100, 200, 0, 100, 50, 30, 60, 400, True, 200.0, 50.0),  # all within the shift
    (240, 240, 0, 0, 480, 1, 3, 480, True, 50.0, 33.33),  # the shift exactly
    (241, 240, 0, 0, 480, 1, 3, 481, False, 50.21, 33.33),  # one minute too many
    (500, -60, 10, 5, 125, 0, 8, 455, False, 400.0, 0.0),  # negative idle time
    (10, 20, 30, 40, 0, 7, 0, 100, True, None, None),  # no targets
    (0, 0, 0, 0, 9, 9, 0, 0, True, 0.0, None),  # nothing happened
]


def test_work_periods(spark):
    names = ["active", "idle", "inrepair", "breakdown", "target_arc_time", "deposit", "target_deposit"]
    rows = [tuple(float(x) for x in g[:7]) for g in PERIODS]
    derived = derive.derive_work_periods(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)))
    got = {
        tuple(r[n] for n in names): (r.total_accounted_minutes, r.time_allocation_valid, r.arc_efficiency_pct, r.deposit_efficiency_pct)
        for r in derived.collect()
    }
    assert got == {tuple(float(x) for x in g[:7]): g[7:] for g in PERIODS}


def test_plausible_efficiency(spark):
    df = spark.createDataFrame([(0.0,), (200.0,), (200.01,), (-1.0,), (None,)], "arc_efficiency_pct double")
    assert sorted(r[0] for r in df.where(filters.plausible_efficiency()).collect()) == [0.0, 200.0]


def test_flags(spark):
    df = spark.createDataFrame([(0.0, 100_000.0, 4.9, None)], "zero double, far double, short double, none double")
    row = df.select(
        derive.below_detection("zero"), derive.travel_outlier("far"), derive.speed_unreliable("short"),
        derive.recorded("none"), derive.sum_of_meters("zero", "none"), derive.sum_of_meters("far", "none", missing_as_zero=True),
        derive.is_idle("zero"), derive.is_welding("zero"),
    ).first()
    assert tuple(row) == (True, False, True, False, None, 100_000.0, True, False)


def test_range_labels_and_shifts(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (20.0,), (21.0,), (None,)], "v double")
    labels = [r[0] for r in df.select(derive.range_label("v", 10, 15, 20)).collect()]
    assert labels == ["zero", "low", "normal", "high", "very_high", None]
    hours = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in (5, 6, 13, 14, 21, 22)], "t timestamp_ntz")
    assert [r[0] for r in hours.select(derive.shift_of("t")).collect()] == ["C", "A", "A", "B", "B", "C"]


def test_breaches(spark, values):
    df = spark.createDataFrame([(1, 271.0, 25.0), (2, 270.0, 19.9), (3, None, 31.0), (4, 220.0, 30.0)], "id int, weld_cur double, weld_volt double")
    df = df.withColumns({f"{s}_{p}_threshold": F.lit(v) for p in ("weld_cur", "weld_volt") for s, v in zip(("high", "low"), derive.THRESHOLDS[p])})
    found = derive.threshold_breaches(df, ("weld_cur", "weld_volt"), keep=("id",))
    assert values(found, "id", "deviation_label", "parameter_unit", "reading") == [
        (1, "weld_cur_high", "A", 271.0),
        (2, "weld_volt_low", "V", 19.9),
        (3, "weld_volt_high", "V", 31.0),
    ]


def test_business_day_in_zone(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 20:00:00Z' AS t")
    assert readers.with_business_day(df, "t", "+05:30").first().business_date == dt.date(2024, 1, 2)
    assert readers.with_business_day(df, "t").first().business_date == dt.date(2024, 1, 1)
