"""CSV extracts to tables, views and SQL; repairs in place; the same on a stream."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from millrace.operators import gateway, quality, repair
from millrace.plans import load, views
from millrace.sources import catalog, readers, schemas, sinks
from millrace.streaming import readings as streams

TYPES = "mtid,machine_type_name,is_active\n1,GMAW,True\n2.0,CLAD,True\n3,GASCUTTING,true\n"
MACHINES = (
    "mid,name,hardware_id,mtid,machine_type_name,is_gmaw,is_clad,is_gascutting,deleted,extra\n"
    "1.0,Torch-1,00HW1,1,GMAW,True,False,False,False,x\n"
    "oops,Torch-2,HW2,1,GMAW,True,False,False,False,x\n"
)
PERIODIC = "pdid,business_date,SHIFT_NAME,machine_name,tm,weld_cur,weld_volt,is_welding,current_deviation_flag\n" + "".join(
    f"p{i},2024-07-0{1 + i % 3} 00:00:00+05:30,{'ABC'[i % 3]},Torch-{i % 2},2024-07-0{1 + i % 3} 08:{i % 60:02d}:00+05:30,{100 + i}.5,{20 + i % 5},{i % 4 != 0},none\n"
    for i in range(60)
)


@pytest.fixture
def folders(tmp_path):
    source, root = tmp_path / "csv", tmp_path / "tables"
    source.mkdir()
    (source / "dim_machine_type.csv").write_text(TYPES)
    (source / "dim_machines.csv").write_text(MACHINES)
    (source / "fact_periodic_gmaw.csv").write_text(PERIODIC)
    return str(source), str(root)


def test_load(spark, folders):
    source, root = folders
    report = {r.table_name: r for r in load.run_load(spark, source, root).collect()}
    assert len(report) == 10
    assert report[schemas.DIM_USERS].status == "file not found"
    machines = report[schemas.DIM_MACHINES]
    assert (machines.rows_in, machines.rows_loaded, machines.errors, machines.status) == (2, 1, 1, "1 rejected")
    rejected = spark.read.parquet(f"{readers.table_path(root, schemas.DIM_MACHINES)}__rejected").first()
    assert (rejected.mid, rejected.rejected) == ("oops", "mid")
    tables = load.stored_tables(spark, root)
    assert sorted(tables) == sorted([schemas.DIM_MACHINE_TYPE, schemas.DIM_MACHINES, schemas.PERIODIC_GMAW])
    assert tables[schemas.DIM_MACHINES].first().hardware_id == "00HW1"
    assert tables[schemas.PERIODIC_GMAW].schema["business_date"].dataType.simpleString() == "date"
    checked = {r.table_name: r.ok for r in load.verify(spark, root).collect()}
    assert checked == {schemas.DIM_MACHINE_TYPE: True, schemas.DIM_MACHINES: False, schemas.PERIODIC_GMAW: False}
    total = load.load_total(spark.createDataFrame(list(report.values()), load.REPORT)).first()
    assert (total.total_rows, total.total_errors) == (64, 1)

    names = views.register_all(tables)
    sql = "SELECT machine_name, sum(sample_count) AS n FROM gmaw.v_gmaw_sensor_averages GROUP BY machine_name ORDER BY 1"
    answer = gateway.execute_sql(spark, sql, names=names)
    assert answer.rows == [{"machine_name": "Torch-0", "n": 15}, {"machine_name": "Torch-1", "n": 30}]
    assert spark.table("v_valid_fact_periodic_gmaw").count() == 45

    catalog.publish(spark, root)
    assert spark.table("gmaw.fact_periodic_gmaw").count() == 60
    constraints = quality.constraint_report(schemas.DIM_MACHINES, tables)
    assert constraints.where("violations > 0").count() == 0


def test_lines_with_too_many_cells_are_rejected(spark, folders):
    source, root = folders
    target = f"{readers.table_path(root, schemas.DIM_MACHINE_TYPE)}"
    with open(f"{source}/dim_machine_type.csv", "w") as f:
        f.write('mtid,machine_type_name,is_active,created_at\n1,GMAW,True,\n2,CLAD,true,,EXTRA,MORE\n3,"GAS,CUTTING",True\n')
    report = load.run_load(spark, source, root, only="dim_machine_type").first()
    assert (report.rows_loaded, report.errors, report.status) == (2, 1, "1 rejected")
    assert {r.mtid: r.machine_type_name for r in readers.read_stored(spark, target).collect()} == {1: "GMAW", 3: "GAS,CUTTING"}
    row = spark.read.parquet(f"{target}__rejected").first()
    assert (row.rejected, row[readers.SURPLUS]) == ("line", "2,CLAD,true,,EXTRA,MORE")
    # A clean load replaces what the last one rejected.
    with open(f"{source}/dim_machine_type.csv", "w") as f:
        f.write(TYPES)
    assert load.run_load(spark, source, root, only="dim_machine_type").first().errors == 0
    assert not sinks.exists(spark, f"{target}__rejected")


def test_report_names_drift_and_broken_rules(spark, folders):
    source, root = folders
    with open(f"{source}/dim_machines.csv", "a") as f:
        f.write("1,Torch-9,HW1X,9,GMAW,True,False,False,False,x\n")
    report = {r.table_name: r for r in load.run_load(spark, source, root).collect()}
    machines = report[schemas.DIM_MACHINES]
    assert machines.extra_columns == "extra" and "created_at" in machines.missing_columns.split(",")
    # The key 1 twice, and a type that does not exist.
    assert machines.violations == 2 and report[schemas.DIM_MACHINE_TYPE].violations == 0


def test_folders_with_exchanged_columns_are_an_error(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text("k,v\n1,x\n")
    (tmp_path / "a" / "2.csv").write_text("v,k\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv_lines(spark, str(tmp_path / "a")).collect()


def test_plan_selection():
    assert [s.table for s in load.load_plan("dim_users")] == [schemas.DIM_USERS]
    assert [s.table for s in load.load_plan(schemas.SUMMARY_CLAD)] == [schemas.SUMMARY_CLAD]
    assert [s.table for s in load.load_plan()][:3] == [schemas.DIM_MACHINE_TYPE, schemas.DIM_MACHINES, schemas.DIM_USERS]
    with pytest.raises(ValueError):
        load.load_plan("nothing")


def test_day_filter_prunes_partitions(spark, folders):
    source, root = folders
    load.run_load(spark, source, root, only="fact_periodic_gmaw")
    fact = readers.read_table(spark, schemas.PERIODIC_GMAW, root).where(F.col("business_date") == dt.date(2024, 7, 2))
    assert fact.count() == 20
    plan = fact._jdf.queryExecution().executedPlan().toString()
    assert "business_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_rewrite_reads_and_replaces_one_table(spark, tmp_path):
    path = str(tmp_path / "dev")
    sinks.write_table(spark.createDataFrame([("weld_cur", None), ("xyz", None)], "parameter string, parameter_unit string"), path)
    for _ in range(2):
        assert sinks.rewrite(repair.label_units(readers.read_stored(spark, path)), path) == 2
    assert {tuple(r) for r in readers.read_stored(spark, path).collect()} == {("weld_cur", "A"), ("xyz", "unknown")}
    assert readers.read_stored(spark, path, previous=True).count() == 2


def test_failed_rewrite_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.rewrite(spark.range(3), path)

    def fail(*_):
        raise OSError("stopped before the switch")

    monkeypatch.setattr(sinks, "switch", fail)
    with pytest.raises(OSError):
        sinks.rewrite(spark.range(5), path)
    assert readers.read_stored(spark, path).count() == 3
    with pytest.raises(Exception):
        sinks.rewrite(spark.range(5).selectExpr("raise_error('bad') AS id"), path)
    assert readers.read_stored(spark, path).count() == 3


def test_csv_round_trip(spark, tmp_path, values):
    rows = [("a,b", None), ('say "x"', "00012"), ("°C", "-")]
    df = spark.createDataFrame(rows, "p string, q string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert values(readers.read_csv(spark, str(tmp_path / "out"))) == sorted(rows, key=repr)
    assert readers.read_csv(spark, str(tmp_path / "out"), ["q"]).columns == ["q"]


def test_raw_layouts_drop_credentials(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(",".join(f"c{i}" for i in range(22)) + "\n")
    raw = readers.read_raw(spark, str(tmp_path / "raw.csv"), "user")
    row = raw.first().asDict()
    assert len(row) == 15 and row["operator_rfid"] == "c11" and row["active_status"] == "c17"
    assert [len(v) for v in schemas.RAW_LAYOUTS.values()] == [4, 15, 17, 22]


def test_repair_checks(spark, values):
    df = spark.createDataFrame([("current", 1), ("xyz", None)], "parameter string, mid int").withColumn("parameter_unit", F.lit(None).cast("string"))
    fixed = repair.fill_units(df)
    assert values(quality.null_change(df, fixed, "parameter_unit")) == [("after", 2, 1), ("before", 2, 2)]
    status = {r.label: r.status for r in quality.run_checks(fixed, load.repair_checks()).collect()}
    assert status["parameter_unit missing"] == "fail" and status["parameter_unit A"] == "found" and status["parameter_unit V"] == "none"


def test_stream(spark, folders, tmp_path):
    source = tmp_path / "incoming"
    source.mkdir()
    header = schemas.schema_of(schemas.PERIODIC_GMAW).fieldNames()
    row = dict.fromkeys(header, "") | {"business_date": "2024-07-01", "machine_name": "Torch-1", "weld_cur": "100.5", "is_welding": "True"}

    def drop_file(name, hours):
        lines = [",".join((row | {"tm": f"2024-07-01 {h:02d}:00:00+00:00"}).values()) for h in hours]
        (source / name).write_text("\n".join([",".join(header), *lines]) + "\n")

    target, state = str(tmp_path / "stored"), str(tmp_path / "state")
    for name, hours, stored in (("1.csv", (7, 8), 2), ("2.csv", (15, 23), 4)):
        drop_file(name, hours)
        streams.load_new_files(spark, str(source), schemas.PERIODIC_GMAW, target, state).awaitTermination()
        assert spark.read.parquet(target).count() == stored

    # An unreadable cell and an overlong line are set aside, exchanged columns are an error.
    bad = row | {"tm": "2024-07-02 01:00:00+00:00", "weld_cur": "much"}
    long = row | {"tm": "2024-07-02 02:00:00+00:00"}
    (source / "3.csv").write_text("\n".join([",".join(header), ",".join(bad.values()), ",".join(long.values()) + ",more,cells"]) + "\n")
    streams.load_new_files(spark, str(source), schemas.PERIODIC_GMAW, target, state).awaitTermination()
    assert spark.read.parquet(target).count() == 4
    assert sorted(r.rejected for r in spark.read.parquet(f"{target}__rejected").collect()) == ["line", "weld_cur"]
    other = tmp_path / "exchanged"
    other.mkdir()
    (other / "1.csv").write_text(",".join([header[1], header[0], *header[2:]]) + "\n" + ",".join(row.values()) + "\n")
    with pytest.raises(StreamingQueryException):
        streams.load_new_files(spark, str(other), schemas.PERIODIC_GMAW, str(tmp_path / "o"), str(tmp_path / "os")).awaitTermination()

    averages = streams.welding_averages(streams.stream_clean(spark, str(source), schemas.PERIODIC_GMAW))
    query = averages.writeStream.format("memory").queryName("averages").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    done = spark.table("averages").orderBy("start").collect()
    assert [(r.start.hour, r.sample_count, r.avg_weld_cur_a) for r in done] == [(6, 2, 100.5), (14, 1, 100.5)]


def test_cells_with_line_breaks(spark, tmp_path, values):
    rows = [(1, "one\ntwo"), (2, 'say "no",\n\nthen'), (3, "plain"), (4, None)]
    df = spark.createDataFrame(rows, "k int, note string")
    sinks.write_csv(df, str(tmp_path / "out"))
    expected = sorted([(str(k), n) for k, n in rows], key=repr)
    assert values(readers.read_csv(spark, str(tmp_path / "out"))) == expected
    lines = readers.read_csv_lines(spark, str(tmp_path / "out"))
    assert values(lines.drop(readers.SURPLUS)) == expected and not any(r[readers.SURPLUS] for r in lines.collect())
    (tmp_path / "more.csv").write_text('k,note\n1,"a\nb",more\n2,"c\nd, e"\n')
    surplus = readers.read_csv_lines(spark, str(tmp_path / "more.csv"))
    assert values(surplus, "k", "note") == [("1", "a\nb"), ("2", "c\nd, e")]
    assert [r.k for r in surplus.where(f"{readers.SURPLUS} IS NOT NULL").collect()] == ["1"]


def test_rewritten_tables_stay_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(3), path)
    first = readers.read_stored(spark, path)
    sinks.rewrite(spark.range(5), path)
    # A DataFrame made before the rewrite still finds its files.
    assert first.count() == 3 and readers.read_stored(spark, path).count() == 5
