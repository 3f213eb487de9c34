"""Shape of the physical plans."""

import os
from contextlib import ExitStack

import pytest

from millrace.operators import cleaning, kpis, sequences
from millrace.plans import registered, testbed
from millrace.session import setting

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    registered.load_all()
    return {name: plan_of(query(spark, SF_DIR)) for name, query in registered.QUERIES.items()}


def test_no_python_and_no_cross_joins(plans):
    for name, plan in plans.items():
        for banned in ("PythonUDF", "EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert banned not in plan, (name, banned)


def test_reports_shuffle_once(plans):
    for name in ("shift_sensor_averages", "cutting_productivity", "session_summary", "deviation_summary"):
        assert plans[name].count("Exchange hashpartitioning") == 1, name
        assert "partial_" in plans[name]


def test_scans_are_pruned_and_filtered(spark):
    per = testbed.periodic_gmaw(spark, SF_DIR).where("event_id < 5")
    plan = plan_of(kpis.welding_averages(per))
    assert "props" not in plan.split("ReadSchema")[1]
    assert "LessThan(event_id,5)" in plan
    assert "EqualTo(event_type,error)" in plan


def test_no_job_runs_while_plans_are_built(spark):
    registered.load_all()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans are built")
    tables = {f.__name__: f for f in (testbed.periodic_gmaw, testbed.machines, testbed.work_periods, testbed.deviations)}
    for table in tables.values():
        table(spark, SF_DIR)
    before = len(tracker.getJobIdsForGroup("plans"))
    facts = spark.range(10).selectExpr("concat('m', id % 3) AS machine_name")
    machines = spark.range(5).selectExpr("concat('m', id) AS name", "CAST(id AS INT) AS mid", "'GMAW' AS machine_type_name")
    joined = cleaning.add_verified_machine(facts, machines)
    rows = spark.range(10).selectExpr("id % 2 AS k", "id AS t", "CAST(id AS DOUBLE) AS v")
    steps = sequences.counter_steps(rows, ["k"], ["t"], "v")
    assert len(tracker.getJobIdsForGroup("plans")) == before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert joined.count() == 10 and steps.count() == 10


def test_a_frequent_lookup_key_is_split(spark):
    facts = spark.range(0, 300_000, 1, 8).selectExpr("CASE WHEN id % 10 < 8 THEN 'hot' ELSE concat('m', id % 500) END AS machine_name", "sha2(CAST(id AS STRING), 256) AS pad")
    machines = spark.range(2000).selectExpr("concat('m', id) AS name", "CAST(id AS INT) AS mid", "repeat('GMAW', 40) AS machine_type_name")
    machines = machines.unionAll(spark.sql("SELECT 'hot', 9999, 'GMAW'"))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    with ExitStack() as stack:
        for key, value in small.items():
            stack.enter_context(setting(spark, key, value))
        joined = cleaning.add_verified_machine(facts, machines)
        assert joined.where("mid IS NULL").count() == 0
        assert len(joined.collect()) == 300_000
        assert "skew=true" in plan_of(joined)
