"""Tables laid out by day: the latest day without a scan, updates of touched days, events across midnight."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import derive, repair
from millrace.plans import load, questions, repairs
from millrace.sources import readers, schemas, sinks

DAYS = [dt.date(2024, 3, d) for d in (1, 2, 3)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def spoil(path, day):
    for name in files(f"{path}/business_date={day}"):
        open(name, "wb").write(b"not parquet")


@pytest.fixture
def periods(spark, tmp_path):
    """The last day has no row of the welding machines."""
    rows = [(d, s, m, k, 100 + i, 10.0 * i) for i, (d, s, m, k) in enumerate([(DAYS[0], "A", "M-1", "GMAW"), (DAYS[1], "A", "M-1", "GMAW"), (DAYS[1], "B", "M-2", "GMAW"), (DAYS[2], "A", "C-1", "CLAD")])]
    columns = "business_date date, shift_name string, machine_name string, machine_type string, active int, arc_efficiency_pct double"
    more = ", ".join(f"cast(1 as double) AS {c}" for c in ("idle", "breakdown", "deposit", "target_deposit", "deposit_efficiency_pct"))
    df = spark.createDataFrame(rows, columns).selectExpr("*", more.split(", ")[0], *more.split(", ")[1:])
    sinks.write_table(df, readers.table_path(str(tmp_path), schemas.DERIVED_GMAW))
    return str(tmp_path), df


def test_latest_day_reads_no_other_day(spark, periods, values):
    root, df = periods
    expected = values(questions.efficiency_today({schemas.DERIVED_GMAW: df}))
    assert len(expected) == 2
    path = readers.table_path(root, schemas.DERIVED_GMAW)
    tables = load.stored_tables(spark, root)
    assert tables.days(schemas.DERIVED_GMAW) == DAYS[::-1]
    spoil(path, DAYS[0])
    assert values(questions.efficiency_today(tables)) == expected
    plan = questions.efficiency_today(tables)._jdf.queryExecution().toString()
    assert "2024-03-02" in plan and "Subquery" not in plan


def test_latest_day_of_a_whole_table_opens_no_file(spark, periods):
    root, _ = periods
    tables = load.stored_tables(spark, root)
    for day in DAYS:
        spoil(readers.table_path(root, schemas.DERIVED_GMAW), day)
    fact = schemas.DERIVED_GMAW
    assert spark.range(1).select(questions.latest_day(tables[fact], tables, fact)).first()[0] == DAYS[2]


def test_latest_day_of_nothing(spark, periods):
    root, _ = periods
    tables = load.stored_tables(spark, root)
    none = tables[schemas.DERIVED_GMAW].where("machine_type = 'X'")
    assert questions.on_day(none, tables, schemas.DERIVED_GMAW).count() == 0


@pytest.fixture
def readings(spark, tmp_path):
    rows = [(i, f"m{i % 3}", i % 5, [*DAYS, None][i % 4]) for i in range(80)]
    df = spark.createDataFrame(rows, "pdid int, machine_name string, mid int, business_date date")
    sinks.write_table(df, readers.table_path(str(tmp_path), schemas.PERIODIC_GMAW))
    return str(tmp_path), df


def patched(spark, readings, rows, columns=("mid",)):
    root, df = readings
    path = readers.table_path(root, schemas.PERIODIC_GMAW)
    patch = spark.createDataFrame(rows, "pdid int, mid int, business_date date, line int")
    before = files(path)
    changed = repairs.apply_patch(spark, root, schemas.PERIODIC_GMAW, patch, ["pdid"], columns, [F.desc("line")])
    whole = repair.keyed_update(df, patch, ["pdid"], columns, [F.desc("line")], skip_null=True)
    after = files(path)
    same = {os.path.dirname(f)[-10:] for f, t in before.items() if after.get(f) == t}
    return changed, sorted(map(repr, readers.read_stored(spark, path).select(*whole.columns).collect())) == sorted(map(repr, whole.collect())), same


def test_patch_leaves_other_days(spark, readings):
    # Rows 0 and 4 lie on the first day; 5 keeps its value, 999 is in no table, 8 repeats.
    rows = [(0, 9, None, 1), (4, 7, None, 1), (5, 0, None, 1), (999, 1, None, 1), (8, 1, None, 1), (8, 6, None, 2), (9, None, None, 1)]
    changed, equal, same = patched(spark, readings, rows)
    assert (changed, equal) == (3, True)
    assert {"2024-03-02", "2024-03-03"} <= same and "2024-03-01" not in same


def test_patch_of_rows_without_a_day(spark, readings):
    changed, equal, same = patched(spark, readings, [(3, 9, None, 1)])
    assert (changed, equal) == (1, True) and {str(d) for d in DAYS} <= same


def test_patch_that_changes_nothing(spark, readings):
    changed, equal, same = patched(spark, readings, [(0, 0, None, 1)])
    assert (changed, equal) == (0, True) and {str(d) for d in DAYS} <= same


def test_patch_that_moves_rows_to_another_day(spark, readings):
    rows = [(i, None, DAYS[1], 1) for i in range(0, 80, 4)]
    changed, equal, same = patched(spark, readings, rows, ("mid", "business_date"))
    assert (changed, equal) == (20, True) and "2024-03-03" in same
    root = readings[0]
    # All rows of the first day moved; its folder is gone.
    assert readers.stored_days(spark, readers.table_path(root, schemas.PERIODIC_GMAW)) == DAYS[:0:-1]


def test_replacing_days_again_changes_nothing(spark, readings, tmp_path):
    root, df = readings
    path = readers.table_path(root, schemas.PERIODIC_GMAW)
    staged = df.where(F.col("business_date") == DAYS[0]).withColumn("mid", F.lit(77))
    for _ in range(2):
        sinks.write_table(staged, str(tmp_path / "staged"))
        sinks.replace_days(spark, path, str(tmp_path / "staged"), [DAYS[0]])
        assert readers.read_stored(spark, path).where("mid = 77").count() == 20 and readers.read_stored(spark, path).count() == 80


# Deviation events


def events_by_hand(rows):
    out, by_key = [], {}
    for key, tm, n, value in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by_key.setdefault(key, []).append((tm, value))
    for key, held in by_key.items():
        run = None
        for tm, value in held:
            if value is None:
                continue
            side = "high" if value > 30 else "low" if value < 20 else "none"
            if run and run[0] == side:
                run[1].append((tm, value))
            else:
                run = (side, [(tm, value)])
                out.append((key, run))
    return sorted(
        (k, s, r[0][0], r[-1][0], (r[-1][0] - r[0][0]).total_seconds(), len(r), (max if s == "high" else min)(v for _, v in r), "sustained" if len(r) > 1 else "single")
        for k, (s, r) in out
        if s != "none"
    )


def test_events_equal_a_walk_over_the_readings(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 3, 1, 20, 0)
    rows = [(f"h{rng.choice([0, 0, 0, 1])}", start + dt.timedelta(minutes=rng.choice([7, 7, 400]) * i), i, rng.choice([25.0, 31.0, 32.0, 32.0, 10.0, None])) for i in range(600)]
    # A run across three midnights, with a missing reading inside.
    rows += [("long", start + dt.timedelta(hours=5 * i), 1000 + i, None if i == 3 else 40.0 + i) for i in range(16)]
    df = spark.createDataFrame(rows, "hardware_id string, tm timestamp, n int, weld_volt double")
    df = df.withColumns({"high_weld_volt_threshold": F.lit(30.0), "low_weld_volt_threshold": F.lit(20.0)})
    columns = ["hardware_id", "type", "start_tm", "end_tm", "span_seconds", "readings", "worst", "flag"]
    expected = events_by_hand(rows)
    for chunk in (None, F.date_trunc("hour", "tm"), F.date_trunc("year", "tm")):
        found = derive.deviation_events(df, ["hardware_id"], ["tm", "n"], ["weld_volt"], chunk)
        assert sorted(map(tuple, found.select(*columns).collect())) == expected
    assert ("long", "high", rows[-16][1], rows[-1][1], 75 * 3600.0, 15, 55.0, "sustained") in expected


def test_events_of_readings_without_limits_or_time(spark):
    rows = [("h", None, 50.0, 30.0), ("h", dt.datetime(2024, 1, 1), 50.0, None), ("h", dt.datetime(2024, 1, 2), None, 30.0)]
    df = spark.createDataFrame(rows, "hardware_id string, tm timestamp, weld_volt double, high_weld_volt_threshold double").withColumn("low_weld_volt_threshold", F.lit(None).cast("double"))
    assert derive.deviation_events(df, ["hardware_id"], ["tm"], ["weld_volt"]).count() == 0
