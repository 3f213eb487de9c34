"""States by day, filters on keys, copies by digest, cut points from data."""

import datetime
import glob

import pytest
from pyspark.sql import functions as F

from millrace.functions import numeric
from millrace.operators import cleaning, derive, key_bits, states
from millrace.operators.states import Measure
from millrace.plans import daily
from millrace.sources import readers, schemas, sinks

MEASURES = [("n", "count"), ("mean", "mean"), ("total", "total"), ("least", "min"), ("most", "max")]


def measures():
    return [Measure(name, kind, None if kind == "count" else F.col("v")) for name, kind in MEASURES] + [Measure("high", "count", F.col("v") > 1)]


@pytest.mark.parametrize(
    "numbers",
    [
        [0.1, 0.2, 0.3, 0.005, -7.125, None],
        [1e17, 0.5, -3.25],
        [float("nan"), 1.0],
        [float("inf"), 2.0],
        [float("inf"), float("-inf")],
        [1e-9, 1 / 3, 2 / 3, 1e15 / 7],
        [None, None],
    ],
)
def test_states_equal_the_rows(spark, numbers):
    rows = [(i % 3, i % 2, v) for i, v in enumerate(numbers * 4)]
    df = spark.createDataFrame(rows, "day int, k int, v double")
    whole = states.aggregate(df, ["k"], measures()).orderBy("k").collect()
    parts = states.states(df, ["day", "k"], measures())
    assert repr(states.finished(parts, ["k"], measures()).orderBy("k").collect()) == repr(whole)
    # States of states, as a coarser store would hold them, are not needed: any finer groups merge.
    assert repr(states.finished(states.states(df, ["day", "k", "v"], measures()), ["k"], measures()).orderBy("k").collect()) == repr(whole)


def test_states_of_nothing(spark):
    df = spark.createDataFrame([], "day int, k int, v double")
    assert states.finished(states.states(df, ["day", "k"], measures()), ["k"], measures()).count() == 0


def test_unknown_measure():
    with pytest.raises(ValueError):
        Measure("x", "median").of_rows()


def sessions(spark, rows):
    columns = "business_date date, shift_name string, machine_name string, is_instantaneous boolean, avg_weld_cur double, avg_weld_volt double, loss_weight double, time_span_seconds double"
    return spark.createDataFrame([(d, "A", "M-1", False, v, v, v, v) for d, v in rows], columns)


def test_refresh_reads_and_writes_touched_days_only(spark, tmp_path):
    one, two = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    root, name = str(tmp_path), "clad.v_clad_session_summary"
    path = daily.states_path(root, name)
    daily.refresh(name, {schemas.SUMMARY_CLAD: sessions(spark, [(one, 1.0), (two, 2.0), (None, 9.0)])}, root)

    def files(day):
        return set(glob.glob(f"{readers.versions(spark, path)[0]}/business_date={day}/*.parquet"))

    before, undated = files(one), files("__HIVE_DEFAULT_PARTITION__")
    later = {schemas.SUMMARY_CLAD: sessions(spark, [(one, 50.0), (two, 3.0), (two, 4.0), (None, 8.0)])}
    daily.refresh(name, later, root, [two])
    assert before and files(one) == before and files("__HIVE_DEFAULT_PARTITION__") == undated
    got = {r.business_date: (r.total_sessions, r.avg_current_a) for r in daily.read(spark, name, root).collect()}
    # The first day was not refreshed and keeps what was known of it.
    assert got == {one: (1, 1.0), two: (2, 3.5), None: (1, 9.0)}
    assert [r.business_date for r in daily.read(spark, name, root, since=two).collect()] == [two]
    daily.refresh(name, later, root, [None])
    by_machine = daily.read(spark, name, root, ["machine_name"]).collect()
    assert [(r.total_sessions, r.avg_current_a) for r in by_machine] == [(4, 4.0)]
    # A day that lost its rows loses its states.
    daily.refresh(name, {schemas.SUMMARY_CLAD: sessions(spark, [(one, 1.0)])}, root, [two])
    assert {r.business_date for r in daily.read(spark, name, root).collect()} == {one, None}


def test_refresh_scans_the_days_alone(spark, tmp_path):
    days = [datetime.date(2024, 1, d) for d in (1, 2, 3)]
    path = readers.table_path(str(tmp_path), schemas.SUMMARY_CLAD)
    sinks.write_table(sessions(spark, [(d, 1.0) for d in days]), path)
    touched = sinks.of_days(readers.read_stored(spark, path), days[1:2])
    plan = states.states(touched, ["business_date"], [Measure("n", "count")])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "2024-01-02" in plan.split("PartitionFilters")[1][:200]


def test_filter_on_keys_loses_none(spark):
    small = spark.range(0, 200_000, 1000).select(F.col("id").alias("k"))
    large = spark.range(200_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    kept = key_bits.may_match(large, small, ["k"])
    assert kept.join(small, "k").count() == 200
    # What is left to be shuffled.
    assert kept.count() <= 220 and kept.columns == ["k", "v"]
    assert key_bits.may_match(large, small.limit(0), ["k"]).count() == 0


def test_filter_on_keys_of_any_kind(spark):
    a = spark.createDataFrame([(1, "x", 0.0), (2, None, float("nan")), (None, "z", 1.0)], "a int, b string, c double")
    b = spark.createDataFrame([(1, "x", -0.0), (2, None, float("nan"))], "a int, b string, c double")
    assert sorted(r.a for r in key_bits.may_match(a, b, ["a", "b", "c"]).collect()) == [1, 2]
    # Hashes of different types differ, so nothing may be left out.
    longs = b.withColumn("a", F.col("a").cast("long"))
    assert key_bits.may_match(a, longs, ["a"]).count() == 3


def test_insert_shuffles_few_stored_keys(spark):
    stored = spark.range(100_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    new = spark.createDataFrame([(5, 1), (100_005, 2), (100_005, 1), (None, 3)], "k long, v long")
    added = sinks.insert_new(stored, new, ["k"], [F.asc("v")])
    assert [tuple(r) for r in added.collect()] == [(100_005, 1)]


def test_copies_by_digest(spark):
    rows = [(1, "a", 0.0), (1, "a", -0.0), (1, None, 2.0), (None, "a", 2.0), (1, None, 2.0), (2, "b", float("nan")), (2, "b", float("nan"))]
    df = spark.createDataFrame(rows * 3 + [(7, "once", 1.0)], "`k.1` int, s string, v double")
    got = cleaning.drop_copies_by_digest(df)
    assert got.columns == df.columns and got.count() == df.distinct().count() == 5
    assert got.exceptAll(df.distinct()).count() == 0
    assert cleaning.drop_copies_by_digest(df.limit(0)).count() == 0


def test_rows_without_copies_are_not_shuffled(spark):
    df = spark.range(50_000).select("id", F.concat(F.lit("row"), "id").alias("s")).unionAll(spark.createDataFrame([(3, "row3")], "id long, s string"))
    columns = [F.xxhash64("id", "s")]
    repeated = df.select(columns[0].alias("d")).groupBy("d").count().where("count > 1")
    again = key_bits.marked(df, columns, key_bits.built(repeated, [F.col("d")]), "again").where("again")
    assert again.count() == 2 and cleaning.drop_copies_by_digest(df).count() == 50_000


def test_cut_points_within_their_error(spark):
    rows = [(f, float(v), 1.0 + v % 3) for f in ("a", "b") for v in range(1, 4001)]
    extra = [("a", 0.0, 5.0), ("a", None, 5.0), ("a", -3.0, 5.0), ("b", float("nan"), 1.0), ("b", 7.0, None), ("c", 0.0, 1.0), (None, 2.0, 1.0)]
    df = spark.createDataFrame(rows + extra, "f string, v double, w double")
    cuts = {r.f: r for r in derive.range_cuts(derive.value_bins(df, ["f"], "v", "w"), ["f"]).collect()}
    assert set(cuts) == {"a", "b", None} and abs(cuts[None].low - 2) <= 0.02
    heavy = sorted((v, 1.0 + v % 3) for v in range(1, 4001))
    total = sum(w for _, w in heavy)
    for name, rank in derive.CUT_RANKS.items():
        upto, exact = 0.0, None
        for v, w in heavy:
            upto += w
            if upto >= rank * total - 1e-9:
                exact = v
                break
        assert abs(cuts["a"][name] - exact) <= derive.CUT_ERROR * exact + 1e-9
    # Bins of parts add up to the same cut points.
    parts = derive.value_bins(df.withColumn("day", F.col("v").cast("int") % 5), ["f", "day"], "v", "w")
    assert {r.f: r for r in derive.range_cuts(parts, ["f"]).collect()} == cuts


def test_labels_by_cut_points(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(101)] + [("c", 0.0), ("a", None)], "f string, v double")
    cuts = derive.range_cuts(derive.value_bins(df, ["f"], "v"), ["f"])
    counts = {(r.f, r.label): r["count"] for r in derive.with_range(df, cuts, ["f"], "v", "label").groupBy("f", "label").count().collect()}
    assert counts[("a", "zero")] == 1 and counts[("a", None)] == 1 and counts[("c", None)] == 1
    assert abs(counts[("a", "low")] - 9) <= 1 and abs(counts[("a", "normal")] - 81) <= 2 and abs(counts[("a", "high")] - 9) <= 2


def test_states_hold_the_exact_sum(spark):
    df = spark.createDataFrame([(i % 4, 0.1) for i in range(1000)], "day int, v double")
    merged = df.groupBy("day").agg(numeric.sum_state("v").alias("s")).agg(numeric.total_of_states("s", 6).alias("t"))
    assert merged.first().t == 100.0
