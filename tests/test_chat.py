import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import gateway, transcripts


@pytest.fixture
def history(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c in (1, 2) for t in range(45)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_history_is_cut_to_forty(history):
    kept = transcripts.session_tail(history).groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    assert {(r.conv_id, r.n, r["first"]) for r in kept.collect()} == {(1, 40, 5), (2, 40, 5)}


def test_append_and_clear(history, spark):
    new = spark.createDataFrame([(1, 45, "user", "new")], history.schema)
    longer = transcripts.append_turns(history, new)
    assert longer.where("conv_id = 1").agg(F.min("turn"), F.max("turn")).first()[:] == (6, 45)
    assert transcripts.clear_sessions(longer, 1).select("conv_id").distinct().collect() == [(2,)]


def test_context(history, spark):
    asked = spark.createDataFrame([(1, "why?"), (3, "hello")], "conv_id bigint, text string")
    context = {r.conv_id: r.messages for r in transcripts.model_context(history, asked, "sys").collect()}
    assert len(context[1]) == 18 and tuple(context[1][0]) == ("system", "sys") and tuple(context[1][-1]) == ("user", "why?")
    assert [m.text for m in context[1][1:-1]] == [f"m{t}" for t in range(29, 45)]
    assert [tuple(m) for m in context[3]] == [("system", "sys"), ("user", "hello")]


def test_topics(spark):
    df = spark.createDataFrame([("Any HR news?",), ("Hourly rate of M-1",), ("SHARE PRICE",), (None,)], "q string")
    assert [r[0] for r in df.select(transcripts.topic_label("q")).collect()] == ["out_of_scope", None, "out_of_scope", None]


def test_categories(spark):
    rows = [
        ("payroll?", '{"category":"general"}'),
        ("q", '```json\n{"category":"general","machine_types":["CLAD"]}\n```'),
        ("q", 'I think {"category":"ambiguous"} fits'),
        ("q", '{"category": "brok'),
        ("q", None),
    ]
    labels = transcripts.classify("q", "r")
    got = spark.createDataFrame(rows, "q string, r string").select(labels["category"].alias("c"), labels["machine_types"].alias("m"))
    assert [tuple(r) for r in got.collect()] == [
        ("out_of_scope", []),
        ("general", ["CLAD"]),
        ("ambiguous", ["ALL"]),
        ("data_query", ["ALL"]),
        ("data_query", ["ALL"]),
    ]


def test_cooldown_lasts_sixty_seconds(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("g", at(0), "ok"), ("g", at(1), "HTTP 429"), ("g", at(61), "ok"), ("g", at(62), "ok"), ("h", at(2), "Quota exceeded"), ("h", at(3), "ok")]
    log = spark.createDataFrame(rows, "provider string, ts timestamp_ntz, message string")
    got = {(r.provider, r.ts.second + 60 * r.ts.minute): r.in_cooldown for r in transcripts.cooldowns(log).collect()}
    assert got == {("g", 0): False, ("g", 1): False, ("g", 61): True, ("g", 62): False, ("h", 2): False, ("h", 3): True}


GUARDED = {
    "SELECT 1": "ok",
    "  with a as (select 1) select * from a": "ok",
    "SELECT created_at FROM t": "ok",
    "select 'copy'": "blocked_word",
    "DROP TABLE t": "blocked_word",
    "-- note\nSELECT 1": "not_select",
    "EXPLAIN SELECT 1": "not_select",
    "": "not_select",
}


def test_guard(spark):
    df = spark.createDataFrame([(s,) for s in GUARDED], "s string")
    assert {r.s: r.label for r in df.select("s", gateway.guard_label("s").alias("label")).collect()} == GUARDED
    for sql, label in GUARDED.items():
        assert gateway.is_readable(sql) == (label == "ok")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM parquet.`{file}`",
        "SELECT * FROM `text`.`{file}`",
        "SELECT * FROM text/**/.`{file}`",
        "SELECT * FROM `TEXT` -- note\n . `{file}`",
        "SELECT (SELECT max(value) FROM `text`.`{file}`) AS v",
        "WITH a AS (SELECT * FROM `text`.`{file}`) SELECT * FROM a",
        "SELECT 1 WHERE EXISTS (SELECT 1 FROM `csv`.`{file}`) OR 1 IN (SELECT 1 FROM `json`.`{file}`)",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home')",
        "SELECT upper(`java_method`/**/('java.lang.System', 'getProperty', 'user.home'))",
        "WITH a AS (SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') AS p) SELECT p FROM a",
        "SELECT id FROM range(3) ORDER BY `reflect`('java.lang.System', 'getProperty', 'user.home')",
        "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM range(3)",
        "SELECT own_function(1)",
    ],
)
def test_foreign_code_and_files_are_refused(spark, tmp_path, sql):
    (tmp_path / "secret.txt").write_text("hidden")
    answer = gateway.execute_sql(spark, sql.format(file=tmp_path / "secret.txt"))
    assert answer.error and "Only SELECT" in answer.error and not answer.rows


def test_ordinary_queries_pass(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    for sql in (
        "WITH a AS (SELECT id FROM numbers), b AS (SELECT max(id) AS m FROM a) SELECT count(*) AS n FROM a JOIN b ON a.id <= b.m",
        "SELECT CAST(id AS STRING) || 'x' AS s, CASE WHEN id BETWEEN 1 AND 2 THEN 1 END AS c, row_number() OVER (ORDER BY id) AS r FROM numbers",
        "SELECT id FROM numbers WHERE id IN (SELECT id FROM numbers WHERE id > 2) AND NOT EXISTS (SELECT 1 FROM numbers n WHERE n.id > 99)",
        "SELECT * FROM range(3)",
    ):
        assert gateway.execute_sql(spark, sql).error is None, sql


def test_execute_sql(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    answer = gateway.execute_sql(spark, "SELECT id FROM numbers ORDER BY id;")
    assert (answer.columns, answer.row_count, answer.truncated, answer.error) == (["id"], 100, True, None)
    assert answer.rows[0] == {"id": 0}
    assert gateway.execute_sql(spark, "SELECT id FROM numbers ORDER BY id LIMIT 300").row_count == 200
    assert gateway.execute_sql(spark, "SELECT id FROM numbers", cap=7).row_count == 7
    assert gateway.execute_sql(spark, "SELECT id FROM numbers WHERE id < 100").truncated is False
    assert gateway.execute_sql(spark, "DELETE FROM numbers").error == gateway.REFUSED
    assert "missing_table" in gateway.execute_sql(spark, "SELECT * FROM missing_table").error
    assert gateway.execute_sql(spark, "SELECT 1/0").error
    assert gateway.execute_sql(spark, "SELECT FROM WHERE").error
    assert gateway.row_limit("SELECT id FROM numbers") == 100
    assert gateway.row_limit("SELECT max(id) FROM numbers") == gateway.row_limit("SELECT 1 LIMIT 5") == 200


LINTED = {
    "SELECT avg(weld_cur) FROM gmaw.fact_periodic_gmaw": "missing_filter_fact_periodic_gmaw,unrounded_average",
    "SELECT round(avg(weld_cur), 2) FROM gmaw.fact_periodic_gmaw WHERE is_welding = TRUE": "",
    "SELECT round(avg(weld_cur), 2) FROM gmaw.fact_periodic_gmaw WHERE is_welding": "",
    "SELECT round(avg(weld_cur), 2) FROM gmaw.fact_periodic_gmaw p WHERE p.is_welding AND weld_cur > 1": "",
    "SELECT round(avg(weld_cur), 2) FROM gmaw.fact_periodic_gmaw WHERE is_welding IS TRUE": "",
    "SELECT count(is_welding) FROM gmaw.fact_periodic_gmaw": "missing_filter_fact_periodic_gmaw",
    "SELECT count(*) FROM gascutting.fact_summarize_gascutting WHERE timer_overflow = false": "missing_filter_fact_summarize_gascutting",
    "SELECT count(*) FROM gascutting.fact_summarize_gascutting_noncutting WHERE NOT n.speed_unreliable": "",
    "SELECT sum(total_lpg_consumption) FROM gascutting.fact_periodic_gascutting WHERE travel_outlier = FALSE": "forbidden_filter,counter_sum",
    "SELECT * FROM reference.dim_users WHERE deleted = FALSE AND is_test_account = FALSE": "no_limit",
    "SELECT max(arc_efficiency_pct) FROM clad.v WHERE arc_efficiency_pct BETWEEN 0 AND 200 AND shift_name = 'Shift B'": "shift_literal,efficiency_table",
    "SELECT lag(x) OVER (ORDER BY y) FROM a.b UNION ALL SELECT 1 LIMIT 3": "window_in_union",
    "```sql SELECT 1 LIMIT 1```": "markdown",
}


def test_lint(spark):
    df = spark.createDataFrame([(s,) for s in LINTED], "s string")
    assert {r.s: r.b for r in df.select("s", gateway.broken_rules("s").alias("b")).collect()} == LINTED
