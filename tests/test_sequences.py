"""Order-dependent operators against a plain loop, with one key holding most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import sequences

KEYS, ORDER = ["k"], ["t", "id"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made, level = [], {}
    for i in range(3000):
        key = 0 if rng.random() < 0.6 else rng.choice([1, 2, 3, None])
        level[key] = 0 if rng.random() < 0.02 else level.get(key, 0) + rng.randrange(4)
        made.append((key, i // 5, i, None if rng.random() < 0.1 else float(level[key])))
    rng.shuffle(made)
    return made


@pytest.fixture(scope="module")
def readings(spark, rows):
    return spark.createDataFrame(rows, "k int, t int, id int, v double").repartition(6)


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def increases(group):
    before = None
    for r in group:
        step = None
        if r[3] is not None:
            if before is not None:
                step = r[3] - before if r[3] >= before else r[3]
            before = r[3]
        yield r, step


def test_long_keys_span_chunks(readings):
    spans = sequences.in_chunks(readings, ORDER).groupBy("k").agg(F.countDistinct(sequences.CHUNK).alias("n"))
    assert spans.agg(F.max("n")).first()[0] > 2


def test_consumption(readings, rows, values):
    expected = []
    for key, group in by_key(rows).items():
        present = [r for r in group if r[3] is not None]
        expected.append((key, len(present), sum(s or 0 for _, s in increases(present))))
    got = sequences.counter_consumption(readings, KEYS, ORDER, "v")
    assert values(got, "k", "readings", "consumption") == sorted(expected, key=repr)


def test_steps(readings, rows):
    expected = {r[2]: step for group in by_key(rows).values() for r, step in increases(group)}
    got = {r.id: r.step for r in sequences.counter_steps(readings, KEYS, ORDER, "v").collect()}
    assert got == expected


def test_running_last(readings, rows):
    expected = {}
    for group in by_key(rows).values():
        seen = None
        for r in group:
            expected[r[2]] = seen
            if r[3] == 0:
                seen = r[1]
    got = sequences.running_last(readings, KEYS, ORDER, F.when(F.col("v") == 0, F.col("t")), "seen")
    assert {r.id: r.seen for r in got.collect()} == expected


def test_tail_and_latest(readings, rows):
    groups = by_key(rows)
    kept = {r.id for r in sequences.tail(readings, KEYS, ORDER, 7).collect()}
    assert kept == {r[2] for g in groups.values() for r in g[-7:]}
    last = {r.id for r in sequences.latest_per_key(readings, KEYS, ORDER).collect()}
    assert last == {g[-1][2] for g in groups.values()}


def test_tail_is_cut_before_the_shuffle(readings):
    plan = sequences.tail(readings, KEYS, ORDER, 7)._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 7, Partial" in plan


def test_rows_are_shuffled_once(readings):
    for df in (
        sequences.counter_consumption(readings, KEYS, ORDER, "v"),
        sequences.counter_steps(readings, KEYS, ORDER, "v"),
        sequences.running_last(readings, KEYS, ORDER, F.col("t"), "seen"),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Summaries are pre-aggregated; the rows themselves move for the window only.
        exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning(k" in line]
        assert sum("_chunk" in line for line in exchanges) <= 2 and "rangepartitioning" not in plan
        assert "Scan ExistingRDD" in plan or "LocalTableScan" in plan


def test_steps_over_days_and_hours(spark):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i + k), float(i * 3 % 11)) for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, t timestamp, v double")
    expected = {}
    for k in (1, 2):
        before = None
        for _, t, v in sorted(r for r in rows if r[0] == k):
            expected[(k, t)] = None if before is None else (v - before if v >= before else v)
            before = v
    for chunk in (None, F.date_trunc("hour", "t")):
        got = sequences.counter_steps(df, ["k"], ["t"], "v", chunk)
        assert {(r.k, r.t): r.step for r in got.collect()} == expected


def test_empty_input(readings):
    none = readings.where("id < 0")
    assert sequences.counter_consumption(none, KEYS, ORDER, "v").count() == 0
    assert sequences.counter_steps(none, KEYS, ORDER, "v").count() == 0


def test_long_chunks_are_cut(spark):
    # One key and day with most of the rows, most of them in one minute, many at one instant.
    crowd = spark.range(60_000).select(
        F.lit("hot").alias("k"),
        F.when(F.col("id") % 3 == 0, F.timestamp_micros(F.col("id") * 1_000_000)).when(F.col("id") % 3 == 1, F.timestamp_micros(3_600_000_000 + F.col("id"))).otherwise(F.timestamp_micros(F.lit(7_200_000_000))).alias("tm"),
        "id",
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 1000).cast("double")).alias("c"),
    )
    few = spark.range(50).select(F.lit(None).cast("string").alias("k"), F.timestamp_micros(F.col("id") * 10**10).alias("tm"), (F.col("id") + 10**6).alias("id"), F.lit(1.0).alias("c"))
    rows = crowd.unionByName(few)
    cut = sequences.in_chunks(rows, ["tm", "id"], keys=["k"], most_rows=4000)
    sizes = [r["count"] for r in cut.where("k = 'hot'").groupBy(sequences.CHUNK).count().collect()]
    # 20,000 rows share an instant; all other parts are short.
    assert sum(sizes) == 60_000 and sorted(sizes)[-2] <= 6000 and len(sizes) >= 10
    assert cut.where("k IS NULL").groupBy(sequences.CHUNK).count().agg(F.max("count")).first()[0] <= 10
    plain = sequences.counter_steps(rows, ["k"], ["tm", "id"], "c")
    parts = sequences.counter_steps(rows, ["k"], ["tm", "id"], "c", most_rows=4000)
    assert parts.columns == plain.columns
    assert parts.exceptAll(plain).count() == 0 and plain.exceptAll(parts).count() == 0
    one = [sequences.counter_consumption(rows, ["k"], ["tm", "id"], "c", most_rows=m).collect() for m in (None, 4000, 100)]
    assert sorted(one[0], key=repr) == sorted(one[1], key=repr) == sorted(one[2], key=repr)
