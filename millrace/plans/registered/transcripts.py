"""Transcripts, stored replies, query texts and provider logs (G1–G11, W1–W2)."""

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import gateway, kpis, ordering, transcripts
from millrace.plans import testbed as tb
from millrace.plans.registered import query
from millrace.plans.testbed import sql_mean, with_tables


def _messages(spark, sf):
    return tb.table(spark, sf, "conversations")


@query(
    "session_tail",
    """SELECT conv_id, turn, role, text FROM conversations
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""",
)
def session_tail(spark, sf):
    """Three messages instead of forty, because sessions in the data are short."""
    return transcripts.session_tail(_messages(spark, sf), 3)


@query(
    "append_and_clear",
    """SELECT conv_id, turn, role, text FROM (
    SELECT conv_id, turn, role, text FROM conversations UNION ALL
    SELECT conv_id, turn + 100, 'assistant', 'reply to ' || text FROM conversations WHERE role = 'user') WHERE conv_id NOT IN (3, 5)
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""",
)
def append_and_clear(spark, sf):
    history = _messages(spark, sf)
    replies = history.where("role = 'user'").select(
        "conv_id",
        (F.col("turn") + 100).alias("turn"),
        F.lit("assistant").alias("role"),
        F.concat(F.lit("reply to "), "text").alias("text"),
    )
    return transcripts.clear_sessions(transcripts.append_turns(history, replies, 4), 3, 5)


@query(
    "model_context",
    """SELECT q.conv_id, 'system:Be brief.' || chr(10) || coalesce(h.past || chr(10), '') || 'user:' || q.text AS context,
    coalesce(h.n, 0) + 2 AS messages FROM
    (SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) q
    LEFT JOIN (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS past, count(*) AS n FROM
        (SELECT * FROM conversations WHERE conv_id % 5 > 0
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4) GROUP BY 1) h ON q.conv_id = h.conv_id""",
)
def model_context(spark, sf):
    messages = _messages(spark, sf)
    questions = transcripts.session_tail(messages, 1).select("conv_id", "text")
    context = transcripts.model_context(messages.where("conv_id % 5 > 0"), questions, "Be brief.", 4)
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    return context.select(
        "conv_id", F.array_join(lines, "\n").alias("context"), F.size("messages").cast("bigint").alias("messages")
    )


# Every user's events as one long session, so that the usual lengths take effect.
_SESSIONS = "(SELECT user_id % 7 AS conv_id, event_id AS turn, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, event_type || ' ' || props AS text FROM events)"


def _sessions(spark, sf):
    return tb.table(spark, sf, "events").select(
        (F.col("user_id") % 7).alias("conv_id"),
        F.col("event_id").alias("turn"),
        F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat_ws(" ", "event_type", "props").alias("text"),
    )


@query(
    "session_tail_usual",
    f"""SELECT conv_id, turn, role, text FROM {_SESSIONS}
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 40""",
)
def session_tail_usual(spark, sf):
    return transcripts.session_tail(_sessions(spark, sf))


@query(
    "append_and_clear_usual",
    f"""SELECT conv_id, turn, role, text FROM (
    SELECT * FROM {_SESSIONS} WHERE turn % 3 > 0 UNION ALL SELECT conv_id, turn, role, 'late ' || text FROM {_SESSIONS} WHERE turn % 3 = 0) WHERE conv_id <> 3
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 40""",
)
def append_and_clear_usual(spark, sf):
    whole = _sessions(spark, sf)
    late = whole.where("turn % 3 = 0").withColumn("text", F.concat(F.lit("late "), "text"))
    return transcripts.clear_sessions(transcripts.append_turns(whole.where("turn % 3 > 0"), late), 3)


@query(
    "model_context_usual",
    f"""SELECT conv_id, 'system:Be brief.' || chr(10) || string_agg(role || ':' || text, chr(10) ORDER BY turn) || chr(10) || 'user:what now' AS context,
    count(*) + 2 AS messages FROM (SELECT * FROM {_SESSIONS} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 16) GROUP BY 1""",
)
def model_context_usual(spark, sf):
    sessions = _sessions(spark, sf)
    questions = sessions.select("conv_id").distinct().withColumn("text", F.lit("what now"))
    context = transcripts.model_context(sessions, questions, "Be brief.")
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    return context.select(
        "conv_id", F.array_join(lines, "\n").alias("context"), F.size("messages").cast("bigint").alias("messages")
    )


_TOPICS = ("", " weather today", " HR desk", " thr", " Share Price")
_TOPIC_LIST = ", ".join(f"'{t}'" for t in _TOPICS)
_QUESTION = f"text || list_extract([{_TOPIC_LIST}], CAST((conv_id + turn) % {len(_TOPICS)} + 1 AS BIGINT))"
_KEYWORDS = "|".join(transcripts.OUT_OF_SCOPE)


def _question():
    topics = F.array(*[F.lit(t) for t in _TOPICS])
    return F.concat("text", F.element_at(topics, ((F.col("conv_id") + F.col("turn")) % len(_TOPICS) + 1).cast("int")))


@query(
    "topic_label",
    f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower({_QUESTION}), '{_KEYWORDS}') THEN 'out_of_scope' END AS topic FROM conversations""",
)
def topic_label(spark, sf):
    return _messages(spark, sf).select("conv_id", "turn", transcripts.topic_label(_question()).alias("topic"))


@query(
    "keyword_documents",
    """SELECT doc_id, contains(lower(text), 'the ') OR contains(lower(text), 'aux') AS found FROM documents""",
)
def keyword_documents(spark, sf):
    """Whole texts against a caller's keywords."""
    return tb.table(spark, sf, "documents").select("doc_id", text.contains_any("text", ("the ", "aux")).alias("found"))


_REPLY_KIND = "(conv_id + turn) % 6"


def _reply():
    """Model replies around the stored texts: fenced, with prose, broken, empty."""
    kind = (F.col("conv_id") + F.col("turn")) % 6
    return (
        F.when(kind == 0, F.concat(F.lit('```json\n{"category":"general","machine_types":["GMAW","CLAD"]}\n``` '), F.regexp_replace("text", "[{}]", "")))
        .when(kind == 1, F.concat(F.regexp_replace("text", "[{}]", ""), F.lit(' {"category":"ambiguous"} so be it')))
        .when(kind == 2, F.lit('{"category": "gener'))
        .when(kind == 3, F.lit('{"machine_types":["GASCUTTING"]}'))
        .when(kind == 4, F.regexp_replace("text", "[{}]", ""))
    )


@query(
    "category_label",
    f"""SELECT conv_id, turn, CASE WHEN outside THEN 'out_of_scope' WHEN kind = 0 THEN 'general' WHEN kind = 1 THEN 'ambiguous' ELSE 'data_query' END AS category,
    CASE WHEN outside THEN '' WHEN kind = 0 THEN 'GMAW,CLAD' WHEN kind = 3 THEN 'GASCUTTING' ELSE 'ALL' END AS machine_types
    FROM (SELECT conv_id, turn, {_REPLY_KIND} AS kind, regexp_matches(lower({_QUESTION}), '{_KEYWORDS}') AS outside FROM conversations)""",
)
def category_label(spark, sf):
    labels = transcripts.classify(_question(), _reply())
    return _messages(spark, sf).select(
        "conv_id",
        "turn",
        labels["category"].alias("category"),
        F.concat_ws(",", labels["machine_types"]).alias("machine_types"),
    )


@query(
    "strip_fences",
    f"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(
    CASE {_REPLY_KIND} WHEN 0 THEN '```sql' || chr(10) || text || chr(10) || '```' WHEN 1 THEN text || ' ``` ' || text ELSE '  ' || text || chr(10) END,
    '```(?:sql|json)?\\s*', '', 'g'), '\\s*```', '', 'g'), '^\\s+|\\s+$', '', 'g') AS bare FROM conversations""",
)
def strip_fences(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % 6
    fenced = (
        F.when(kind == 0, F.concat(F.lit("```sql\n"), "text", F.lit("\n```")))
        .when(kind == 1, F.concat("text", F.lit(" ``` "), "text"))
        .otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    )
    return _messages(spark, sf).select("conv_id", "turn", text.strip_fences(fenced).alias("bare"))


_SQL_TEXT = """CASE (conv_id + turn) % 9
    WHEN 0 THEN 'SELECT role, ' || chr(39) || 'x' || chr(39) || ' FROM t -- ' || text
    WHEN 1 THEN 'with c as (select 1) select * from c -- ' || text
    WHEN 2 THEN 'DROP TABLE t -- ' || text
    WHEN 3 THEN 'select ' || chr(39) || 'copy' || chr(39) || ' -- ' || text
    WHEN 4 THEN 'SELECT created_at FROM t -- ' || text
    WHEN 5 THEN '-- note' || chr(10) || 'SELECT 1 -- ' || text
    WHEN 6 THEN text
    WHEN 7 THEN 'Here it is: ' || chr(10) || 'Select a from b -- ' || text
    ELSE 'SELECT a FROM b; delete from b -- ' || text END"""


def _sql_text():
    """Query texts around the stored messages."""
    kind = (F.col("conv_id") + F.col("turn")) % 9
    starts = [
        "SELECT role, 'x' FROM t -- ",
        "with c as (select 1) select * from c -- ",
        "DROP TABLE t -- ",
        "select 'copy' -- ",
        "SELECT created_at FROM t -- ",
        "-- note\nSELECT 1 -- ",
        "",
        "Here it is: \nSelect a from b -- ",
        "SELECT a FROM b; delete from b -- ",
    ]
    return F.concat(F.element_at(F.array(*[F.lit(s) for s in starts]), (kind + 1).cast("int")), "text")


@query(
    "sql_guard_label",
    rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(sql, '(?i)\b(INSERT|UPDATE|DELETE|DROP|TRUNCATE|ALTER|CREATE|GRANT|REVOKE|COPY)\b') THEN 'blocked_word'
    WHEN NOT regexp_matches(sql, '(?i)^\s*(SELECT|WITH)\b') THEN 'not_select' ELSE 'ok' END AS label
    FROM (SELECT conv_id, turn, {_SQL_TEXT} AS sql FROM conversations)""",
)
def sql_guard_label(spark, sf):
    return _messages(spark, sf).select("conv_id", "turn", gateway.guard_label(_sql_text()).alias("label"))


@query(
    "extract_sql",
    rf"""SELECT conv_id, turn, CASE WHEN found <> '' THEN found ELSE regexp_replace(sql, '^\s+|\s+$', '', 'g') END AS sql
    FROM (SELECT conv_id, turn, sql, regexp_replace(regexp_extract(sql, '(?is)((?:WITH|SELECT)\b.*)', 1), '^\s+|\s+$', '', 'g') AS found
    FROM (SELECT conv_id, turn, {_SQL_TEXT} AS sql FROM conversations))""",
)
def extract_sql(spark, sf):
    return _messages(spark, sf).select("conv_id", "turn", text.extract_sql(_sql_text()).alias("sql"))


@query(
    "extract_json",
    """SELECT event_id, CASE WHEN event_id % 3 < 2 THEN props END AS found, CASE WHEN event_id % 3 < 2 THEN
    CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""",
)
def extract_json(spark, sf):
    """JSON inside prose; one text in three has none."""
    kind = F.col("event_id") % 3
    reply = (
        F.when(kind == 0, F.concat(F.lit("Sure! ```json\n"), "props", F.lit("\n``` as asked")))
        .when(kind == 1, F.concat(F.lit("so "), "props"))
        .otherwise("no braces here")
    )
    found = tb.table(spark, sf, "events").select("event_id", text.extract_json(reply).alias("found"))
    return found.withColumn("k", F.from_json("found", "k bigint")["k"])


def _lint_statement(kind):
    return {
        0: "SELECT machine_name, ROUND(AVG(weld_cur)) FROM gmaw.fact_periodic_gmaw GROUP BY 1 -- ",
        1: "SELECT SUM(p.total_lpg_consumption) FROM gascutting.fact_periodic_gascutting p WHERE timer_overflow = FALSE -- ",
        2: "SELECT arc_efficiency_pct FROM gmaw.v_gmaw_shift_efficiency WHERE shift_name = 'Shift A' LIMIT 5 -- ",
        3: "SELECT COUNT(*) FROM clad.fact_summarize_clad WHERE NOT is_instantaneous -- ",
        4: "SELECT * FROM fact_summarize_gascutting WHERE timer_overflow = false AND travel_outlier=FALSE -- ",
        5: "SELECT valid_sessions / total_sessions FROM clad.v_clad_session_summary LIMIT 3 -- ",
        6: "SELECT arc_efficiency_pct, ```x``` FROM clad.v_x WHERE arc_efficiency_pct BETWEEN 0 AND 200 LIMIT 3 -- ",
        7: "SELECT AVG(x) FROM gmaw.a UNION ALL SELECT SUM(x) OVER (PARTITION BY y) FROM gmaw.b -- ",
        8: "SELECT AVG(reading) FROM clad.fact_summarize_clad -- WHERE NOT is_instantaneous ROUND( ",
        9: "/* FROM fact_x avg( */ SELECT 'sum(total_lpg_consumption) -- FROM fact_y', \"valid_sessions /\" FROM gmaw.t LIMIT 2 -- 'shift a' avg(",
        10: "SELECT m FROM gmaw.t WHERE note = 'it''s over ( union all' AND s = 'Shift B' LIMIT 1 -- ",
        11: "SELECT COUNT(*) FROM gascutting.fact_summarize_gascutting WHERE timer_overflow = FALSE -- AND travel_outlier = FALSE ",
    }[kind]


_LINTED = {
    0: "missing_filter_fact_periodic_gmaw",
    1: "forbidden_filter,counter_sum",
    2: "shift_literal,efficiency_range",
    3: "",
    4: "unqualified_table,no_limit",
    5: "unguarded_ratio",
    6: "efficiency_table,markdown",
    7: "window_in_union,unrounded_average",
    8: "missing_filter_fact_summarize_clad,unrounded_average",
    9: "",
    10: "shift_literal",
    11: "missing_filter_fact_summarize_gascutting",
}


@query(
    "sql_lint",
    "SELECT conv_id, turn, CASE (conv_id + turn) % 12 "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _LINTED.items())
    + " END AS broken FROM conversations",
)
def sql_lint(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % len(_LINTED)
    statements = F.array(*[F.lit(_lint_statement(k)) for k in _LINTED])
    # What users wrote follows as a comment, whatever it holds.
    sql = F.concat(F.element_at(statements, (kind + 1).cast("int")), F.translate("text", "\n", " "))
    return _messages(spark, sf).select(
        "conv_id", "turn", gateway.broken_rules(sql).alias("broken")
    )


_LOG = """(SELECT event_id, 'provider' || CAST(user_id % 3 AS VARCHAR) AS provider, ts, event_type = 'error' AS rate_limited FROM events)"""


@query(
    "provider_cooldown",
    f"""SELECT event_id, provider, rate_limited, last_rate_limit,
    coalesce(date_diff('microsecond', last_rate_limit, ts) <= 900000000, FALSE) AS in_cooldown
    FROM (SELECT *, max(CASE WHEN rate_limited THEN ts END) OVER (PARTITION BY provider ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_rate_limit FROM {_LOG})""",
)
def provider_cooldown(spark, sf):
    """Fifteen minutes instead of one, because events in the data are sparse."""
    message = F.when(F.col("event_type") == "error", F.concat(F.lit("HTTP 429: Too Many Requests "), "props")).otherwise("done")
    log = tb.table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("provider"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        "ts",
        message.alias("message"),
    )
    marked = transcripts.cooldowns(log, ("ts", "event_id"), seconds=900)
    return marked.select("event_id", "provider", "rate_limited", "last_rate_limit", "in_cooldown")


@query("health", with_tables("per", body="SELECT 'ok' AS status, count(*) AS gmaw_rows FROM per"))
def health(spark, sf):
    return transcripts.health(tb.periodic_gmaw(spark, sf))


@query(
    "readonly_sql",
    with_tables("per", body="SELECT shift_name, is_welding, count(*) AS readings, min(weld_cur) AS lowest FROM per GROUP BY 1, 2"),
)
def readonly_sql(spark, sf):
    """A user's query through the guard, over a registered table."""
    tb.periodic_gmaw(spark, sf).createOrReplaceTempView("fact_periodic_gmaw")
    sql = """SELECT shift_name, is_welding, count(*) AS readings, min(weld_cur) AS lowest
    FROM fact_periodic_gmaw GROUP BY shift_name, is_welding"""
    return gateway.read_frame(spark, sql)


@query(
    "readonly_sql_capped",
    with_tables(
        "per",
        body=f"""SELECT hardware_id, {sql_mean('weld_cur', 2)} AS avg_weld_cur_a FROM per GROUP BY 1 ORDER BY 1 LIMIT 20""",
    ),
)
def readonly_sql_capped(spark, sf):
    """Preview of a sorted result: its first twenty rows."""
    readings = tb.periodic_gmaw(spark, sf).withColumn("is_welding", F.lit(True))
    kpis.sensor_averages(readings, ("hardware_id",)).createOrReplaceTempView("device_averages")
    sql = "SELECT hardware_id, avg_weld_cur_a FROM device_averages ORDER BY hardware_id"
    return gateway.read_frame(spark, sql, ordering.PREVIEW_ROWS)


@query(
    "readonly_sql_row_cap",
    with_tables("per", body="SELECT event_id, hardware_id FROM per ORDER BY event_id LIMIT 200"),
)
def readonly_sql_row_cap(spark, sf):
    """A text that asks for more than the cap gets the cap's 200 rows."""
    tb.periodic_gmaw(spark, sf).createOrReplaceTempView("capped_readings")
    return gateway.read_frame(spark, "SELECT event_id, hardware_id FROM capped_readings ORDER BY event_id LIMIT 1000")
