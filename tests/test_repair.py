from pyspark.sql import functions as F

from millrace.operators import filters, repair
from millrace.sources import schemas, sinks


def test_units(spark):
    rows = [("current", "x"), (" Voltage ", None), ("GAS", None), ("weld_cur", None), ("xyz", "x")]
    df = spark.createDataFrame(rows, "parameter string, parameter_unit string")
    units = lambda d: [r.parameter_unit for r in d.collect()]
    assert units(repair.fill_units(df)) == ["A", "V", "L/min", "A", None]
    assert units(repair.update_units(df)) == ["A", None, "L/min", "A", "x"]
    assert units(repair.label_units(df)) == ["unknown", "unknown", "unknown", "A", "unknown"]
    counted = {r.parameter: r.rows_updated for r in repair.update_unit_counts(df).collect()}
    assert counted == {"current": 1, "gas": 1, "weld_cur": 1}


def test_keyed_update(spark, values):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (None, "d", 4)], "k int, other string, v int")
    patch = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, None, 1), (9, 99, 1)], "k int, v int, seq int")
    newest = [F.desc("seq")]
    done = repair.keyed_update(target, patch, ["k"], ["v"], newest, changed="changed")
    assert values(done) == sorted([(1, "a", 11, True), (2, "b", None, False), (3, "c", 3, False), (None, "d", 4, False)], key=repr)
    again = repair.keyed_update(done.drop("changed"), patch, ["k"], ["v"], newest, changed="changed")
    assert again.where("changed").count() == 0


def test_empty_patch_cells(spark, values):
    target = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    patch = spark.createDataFrame([(1, None), (2, 7)], "k int, v int")
    assert values(repair.keyed_update(target, patch, ["k"], ["v"])) == [(1, None), (2, 7)]
    assert values(repair.keyed_update(target, patch, ["k"], ["v"], skip_null=True)) == [(1, 5), (2, 7)]


def test_composite_key(spark, values):
    target = spark.createDataFrame([("h", 1, None), ("h", 2, 8), ("g", 1, 9)], "hardware_id string, start int, mid int")
    patch = spark.createDataFrame([("h", 1, 4), ("h", 2, 8)], "hardware_id string, start int, mid int")
    done = repair.keyed_update(target, patch, ["hardware_id", "start"], ["mid"], changed="changed")
    assert values(done) == [("g", 1, 9, False), ("h", 1, 4, True), ("h", 2, 8, False)]


def test_insert_ignore_is_idempotent(spark, values):
    old = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a")], "k int, v string")
    added = sinks.insert_new(old, new, ["k"], [F.asc("v")])
    assert values(added) == [(2, "a")]
    assert sinks.insert_new(old.unionByName(added), new, ["k"], [F.asc("v")]).count() == 0


def test_obsolete_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "tm int, cut_mm_mtr int, type int")
    assert repair.drop_obsolete(df, schemas.PERIODIC_GMAW).columns == ["tm"]
    assert repair.drop_obsolete(df, schemas.SUMMARY_CLAD).columns == df.columns


def test_null_safe_difference(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(filters.differs("a", "b")).collect()] == [False, True, False]


def test_fractions_as_text(spark):
    df = spark.createDataFrame([(7.5,), (7.0,)], "d double")
    assert df.where(filters.shows_fraction("d")).count() == 2
    assert df.where(filters.shows_fraction(F.col("d").cast("bigint"))).count() == 0
