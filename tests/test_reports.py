"""Reports, checks and rankings on small hand-made tables."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import filters, kpis, ordering, quality
from millrace.plans import questions, views
from millrace.sources import catalog, schemas

DAY = dt.date(2024, 7, 4)


def sessions(spark):
    rows = [
        (DAY, "A", "R1", False, 80.0, 8.0, 2.0, 120.0),
        (DAY, "A", "R1", None, 90.0, 9.0, 3.0, 60.0),
        (DAY, "A", "R1", True, 10.0, 1.0, 0.0, 0.0),
        (DAY, "B", "R2", True, 10.0, 1.0, None, 0.0),
        (DAY - dt.timedelta(1), "B", "R2", False, 70.0, 7.0, 0.0, 30.0),
    ]
    return spark.createDataFrame(
        rows,
        "business_date date, shift_name string, machine_name string, is_instantaneous boolean, avg_weld_cur double, "
        "avg_weld_volt double, loss_weight double, time_span_seconds double",
    )


def test_sessions_count_all_and_measure_the_valid(spark, values):
    assert values(kpis.session_summary(sessions(spark))) == [
        (DAY - dt.timedelta(1), "B", "R2", 1, 1, 70.0, 7.0, 0.0, 0.5),
        (DAY, "A", "R1", 3, 1, 80.0, 8.0, 2.0, 2.0),
        (DAY, "B", "R2", 1, 0, None, None, None, None),
    ]
    assert values(kpis.session_efficiency(sessions(spark))) == [("R1", 3, 1, 33.33), ("R2", 2, 1, 50.0)]
    assert values(kpis.session_means(sessions(spark)), "machine_name", "shift_name", "total_loss_weight_g") == [
        ("R1", "A", 2.0),
        ("R2", "B", None),
    ]


def test_sensor_averages_skip_idle_rows(spark):
    rows = [(DAY, "A", "M-1", 200.0, True, "single"), (DAY, "A", "M-1", 0.0, False, "none"), (DAY, "A", "M-1", 100.0, True, None), (DAY, "A", "M-1", 100.0, True, "0")]
    df = spark.createDataFrame(
        rows, "business_date date, shift_name string, machine_name string, weld_cur double, is_welding boolean, current_deviation_flag string"
    )
    for c in ("weld_volt", "weld_gas", "hs_temp", "amb_temp", "rpm"):
        df = df.withColumn(c, F.lit(None).cast("double"))
    df = df.withColumn("voltage_deviation_flag", F.lit("2")).withColumn("gas_deviation_flag", F.lit(None).cast("string"))
    row = kpis.sensor_averages(df).first()
    assert (row.sample_count, row.avg_weld_cur_a, row.avg_weld_volt_v) == (3, 133.33, None)
    assert (row.current_deviation_events, row.voltage_deviation_events, row.gas_deviation_events) == (1, 3, 0)


def test_productivity_needs_valid_cuts(spark):
    rows = [
        (DAY, "A", "T", False, False, True, 100.0, 10.0, True, 1500.0, 0.0, True, 5.0),
        (DAY, "A", "T", False, False, False, 900.0, None, False, 500.0, 3.0, False, 1.0),
        (DAY, "A", "T", True, False, True, 900.0, 10.0, True, 500.0, 9.0, False, 1.0),
        (DAY, "A", "T", None, False, True, 900.0, 10.0, True, 500.0, 9.0, False, 1.0),
    ]
    df = spark.createDataFrame(
        rows,
        "business_date date, shift_name string, machine_name string, timer_overflow boolean, travel_outlier boolean, speed_valid boolean, "
        "mm_per_min double, thickness double, thickness_recorded boolean, net_travel_in_mm double, net_lpg_consumption double, "
        "lpg_below_detection boolean, total_o2_consumption double",
    )
    assert tuple(kpis.cutting_productivity(df).first())[3:] == (2, 1, 100.0, 10.0, 2.0, 3.0, 6.0)


def test_missing_keys_form_groups(spark, values):
    rows = [("GMAW", "M-1", "weld_cur", None, "high", "weld_cur_high", 60.0, 1), ("GMAW", "M-1", "weld_cur", None, "high", "weld_cur_high", 30.0, 2)]
    df = spark.createDataFrame(
        rows, "machine_type string, machine_name string, parameter string, parameter_unit string, type string, deviation_label string, span_seconds double, start_tm int"
    )
    assert values(kpis.deviation_summary(df)) == [("GMAW", "M-1", "weld_cur", None, "high", "weld_cur_high", 2, 45.0, 1.5, 1, 2)]
    assert kpis.chart_feed(df).columns == ["PARAMETER_TYPE", "COUNT"]
    assert kpis.distribution(df, "parameter_unit").count() == 1
    assert kpis.distribution(df, "parameter_unit", keep_null=False).count() == 0


def test_unknown_flags_are_not_valid(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "is_instantaneous boolean")
    assert filters.valid_rows(df, schemas.SUMMARY_CLAD).count() == 1
    assert filters.valid_rows(df, schemas.PERIODIC_GASCUTTING).count() == 3


def test_order_of_missing_values(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "v int")
    assert [r.v for r in df.orderBy(ordering.ascending("v")).collect()] == [1, 2, None]
    assert [r.v for r in df.orderBy(ordering.descending("v")).collect()] == [None, 2, 1]
    assert ordering.any_rows(df, 2).count() == 2


def test_preview(spark):
    assert ordering.preview(spark.range(0))["notice"] == "no rows"
    shown = ordering.preview(spark.range(30))
    assert (len(shown["rows"]), shown["row_count"], shown["notice"]) == (20, 30, "... and 10 more rows")
    assert ordering.preview(spark.range(300))["row_count"] == 200


def test_day_anchors(spark):
    t = {schemas.SUMMARY_CLAD: sessions(spark)}
    assert questions.on_day(t[schemas.SUMMARY_CLAD]).count() == 4
    assert questions.last_days(t[schemas.SUMMARY_CLAD], 1).count() == 4
    assert questions.last_days(t[schemas.SUMMARY_CLAD], 2).count() == 5
    assert [r.shift_name for r in questions.last_shift(t[schemas.SUMMARY_CLAD]).collect()] == ["B"]
    assert questions.ask("B14", t, machine="R2").first().avg_current_a == 70.0
    assert len(questions.QUESTIONS) == 21


def test_views_follow_the_tables_present(spark):
    found = views.all_views({schemas.SUMMARY_CLAD: sessions(spark)})
    assert sorted(found) == ["clad.v_clad_session_summary", "clad.v_valid_fact_summarize_clad"]
    assert len(views.VIEWS) == 8


def test_row_counts(spark, values):
    checked = quality.row_count_check({"a": spark.range(98), "b": spark.range(97), "c": spark.range(1)}, {"a": 100, "b": 100})
    assert values(checked, "table_name", "actual", "expected", "ok") == [("a", 98, 100, True), ("b", 97, 100, False)]
    assert tuple(quality.row_count_verdict(checked).first()) == (195, False)


def test_checks(spark, values):
    df = spark.createDataFrame([("A",), ("A",), (None,)], "u string")
    got = quality.run_checks(df, [("none", F.col("u").isNull(), 0), ("A", F.col("u") == "A", None), ("V", F.col("u") == "V", None), ("two", F.col("u") == "A", 2)])
    assert values(got, "label", "actual", "status") == [("A", 2, "found"), ("V", 0, "none"), ("none", 1, "fail"), ("two", 2, "pass")]


def test_keys_and_references(spark, values):
    child = spark.createDataFrame([(1,), (1,), (7,), (7,), (None,)], "mid int")
    parent = spark.createDataFrame([(1,)], "mid int")
    assert tuple(quality.key_report(child, ["mid"]).first()) == (5, 1, 2, 2)
    assert values(quality.orphans(child, "mid", parent, "mid")) == [(7, 2)]
    assert quality.orphan_rows(child, "mid", parent, "mid").count() == 2


def test_constraint_report(spark):
    columns = "mtid smallint, machine_type_name string, is_active boolean"
    types = spark.createDataFrame([(1, "GMAW", True), (1, "X" * 21, None)], columns)
    found = {r.check: r.violations for r in quality.constraint_report(schemas.DIM_MACHINE_TYPE, {schemas.DIM_MACHINE_TYPE: types}).collect()}
    assert found["not_null:is_active"] == 1 and found["length:machine_type_name"] == 1 and found["unique:mtid"] == 1


def test_profiles(spark, values):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "p string, q string")
    assert values(kpis.column_profile(df, ("p", "q"))) == [("p", 3, 0, 2), ("q", 3, 2, 1)]
    assert values(quality.null_counts(df, ("p", "q"))) == [("p", 0), ("q", 2)]
    assert values(quality.domain_violations(df, {"p": ("a",), "q": ("y",)})) == [("p", 1), ("q", 1)]
    assert values(quality.length_violations(df, {"p": 0})) == [("p", 3)]


def test_catalog(spark, values):
    frames = {"gmaw.t": spark.range(2), "clad.t": spark.range(3), "clad.u": spark.range(1)}
    assert values(catalog.column_counts(frames)) == [("clad", "t", 1), ("clad", "u", 1), ("gmaw", "t", 1)]
    catalog.register(frames)
    assert spark.table("t").count() == 2
    sql = catalog.qualify("SELECT count(*) AS n FROM clad.t", list(frames))
    assert spark.sql(sql).first().n == 3


def test_sketches_merge_to_a_profile(spark):
    rows = [(i % 3, f"n{i % 500}", float(i), None if i % 4 else i) for i in range(20_000)] + [(0, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "part int, name string, v double, k int")
    sketches = kpis.column_sketches(df, ["name", "v", "k"], ["part"])
    assert sketches.count() == 9
    profile = {r.column_name: r for r in kpis.sketched_profile(sketches, [0.5, 0.9]).collect()}
    assert [(profile[c].rows, profile[c].null_rows) for c in ("name", "v", "k")] == [(20_001, 1), (20_001, 0), (20_001, 15_001)]
    assert abs(profile["name"].distinct_values - 500) <= 25 and abs(profile["v"].distinct_values - 20_001) <= 1000
    assert profile["name"].quantiles is None
    assert [abs(profile["v"].quantiles[i] - q * 20_000) <= 600 for i, q in enumerate([0.5, 0.9])] == [True, True]
    plan = sketches._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([(None, None)], "name string, v double")
    for given in (df, df.limit(0)):
        rows = kpis.sketched_profile(kpis.column_sketches(given, ["name", "v"])).collect()
        assert sorted((r.column_name, r.null_rows == r.rows, r.distinct_values, r.quantiles) for r in rows) == [("name", True, 0, None), ("v", True, 0, None)]
