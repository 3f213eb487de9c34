"""Checks Q1–Q12 and catalog counts."""

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import filters, quality
from millrace.plans import testbed as tb
from millrace.plans.registered import query
from millrace.plans.testbed import with_tables
from millrace.sources import catalog

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
EXPECTED = {"nation": 25, "region": 6, "customer": 1500, "supplier": 102, "part": 2100, "orders": 15_000}


def _frames(spark, sf, names=TABLES):
    return {n: tb.table(spark, sf, n) for n in names}


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES))
def table_counts(spark, sf):
    return quality.table_counts(_frames(spark, sf))


@query(
    "table_sizes",
    """SELECT 'tpch.customer' AS table_name, 5 AS column_count, count(*) AS rows FROM customer
    UNION ALL SELECT 'tpch.lineitem', 11, count(*) FROM lineitem UNION ALL SELECT 'tpch.orders', 6, count(*) FROM orders
    UNION ALL SELECT 'stream.events', 6, count(*) FROM events UNION ALL SELECT 'chat.conversations', 4, count(*) FROM conversations""",
)
def table_sizes(spark, sf):
    """Column counts from the catalog next to exact row counts."""
    names = {"tpch": ("customer", "lineitem", "orders"), "stream": ("events",), "chat": ("conversations",)}
    frames = {f"{s}.{n}": tb.table(spark, sf, n) for s, listed in names.items() for n in listed}
    columns = catalog.column_counts(frames).select(
        F.concat("table_schema", F.lit("."), "table_name").alias("table_name"), F.col("column_count").cast("int")
    )
    return quality.table_counts(frames).join(columns, "table_name")


_COUNT_CHECK = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS actual, CAST({n} AS BIGINT) AS expected, count(*) >= {n} * 0.98 AS ok FROM {t}"
    for t, n in EXPECTED.items()
)


@query("rowcount_check", _COUNT_CHECK)
def rowcount_check(spark, sf):
    return quality.row_count_check(_frames(spark, sf), EXPECTED)


@query(
    "rowcount_verdict",
    f"SELECT CAST(sum(actual) AS BIGINT) AS total_rows, bool_and(ok) AS all_ok FROM ({_COUNT_CHECK})",
)
def rowcount_verdict(spark, sf):
    return quality.row_count_verdict(quality.row_count_check(_frames(spark, sf), EXPECTED))


@query(
    "expected_zero_checks",
    with_tables(
        "dev",
        body="""SELECT label, actual, expected, CASE WHEN expected IS NOT NULL THEN CASE WHEN actual = expected THEN 'pass' ELSE 'fail' END
        WHEN actual > 0 THEN 'found' ELSE 'none' END AS status FROM (
        SELECT 'unit missing' AS label, count(*) FILTER (WHERE parameter_unit IS NULL) AS actual, CAST(0 AS BIGINT) AS expected FROM dev
        UNION ALL SELECT 'unit A', count(*) FILTER (WHERE parameter_unit = 'A'), NULL FROM dev
        UNION ALL SELECT 'unit °C', count(*) FILTER (WHERE parameter_unit = '°C'), NULL FROM dev
        UNION ALL SELECT 'whole reading', count(*) FILTER (WHERE reading <> floor(reading)), CAST(0 AS BIGINT) FROM dev
        UNION ALL SELECT 'mid shows a fraction', count(*) FILTER (WHERE event_id % 2 = 0), CAST(0 AS BIGINT) FROM dev
        UNION ALL SELECT 'whole mid shows a fraction', 0, CAST(0 AS BIGINT))""",
    ),
)
def expected_zero_checks(spark, sf):
    unit = F.col("parameter_unit")
    # As an extract may hold it: every other id written as a float.
    written = F.concat(F.col("mid").cast("string"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise(""))
    return quality.run_checks(
        tb.deviations(spark, sf).withColumn("written_mid", written),
        [
            ("unit missing", unit.isNull(), 0),
            ("unit A", unit == "A", None),
            ("unit °C", unit == "°C", None),
            ("whole reading", F.col("reading") != F.floor("reading"), 0),
            ("mid shows a fraction", filters.shows_fraction("written_mid"), 0),
            ("whole mid shows a fraction", filters.shows_fraction("mid"), 0),
        ],
    )


@query(
    "null_change",
    with_tables(
        "per",
        body="""SELECT 'before' AS stage, count(*) AS rows, count(*) - count(gas_deviation_flag) AS null_rows FROM per
        UNION ALL SELECT 'after', count(*), count(*) FILTER (WHERE gas_deviation_flag IS NULL AND hs_temp < 30) FROM per""",
    ),
)
def null_change(spark, sf):
    before = tb.periodic_gmaw(spark, sf)
    filled = F.when(F.col("hs_temp") < 30, F.col("gas_deviation_flag")).otherwise(F.coalesce("gas_deviation_flag", F.lit("none")))
    return quality.null_change(before, before.withColumn("gas_deviation_flag", filled), "gas_deviation_flag")


@query(
    "missing_values",
    """SELECT count(*) FILTER (WHERE event_id % 4 = 0 OR event_id % 4 = 1) AS missing, count(*) FILTER (WHERE event_id % 4 = 0) AS null_rows FROM events""",
)
def missing_values(spark, sf):
    """NaN and NULL both count as missing, only NULL as null."""
    cell = F.when(F.col("event_id") % 4 == 1, F.lit(float("nan"))).when(F.col("event_id") % 4 > 1, F.col("value"))
    cells = tb.table(spark, sf, "events").select(cell.alias("v"))
    return cells.agg(
        F.count_if(text.is_missing("v")).alias("missing"), F.count_if(F.col("v").isNull()).alias("null_rows")
    )


_KEYS = """SELECT '{name}' AS key_name, CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(CASE WHEN incomplete THEN n END), 0) AS BIGINT) AS null_key_rows,
    count(*) FILTER (WHERE NOT incomplete AND n > 1) AS repeated_keys,
    CAST(coalesce(sum(CASE WHEN NOT incomplete THEN n - 1 END), 0) AS BIGINT) AS surplus_rows
    FROM (SELECT count(*) AS n, {test} AS incomplete FROM {table} GROUP BY {keys})"""


@query(
    "key_reports",
    " UNION ALL ".join(
        [
            _KEYS.format(name="orders", test="o_orderkey IS NULL", table="orders", keys="o_orderkey"),
            _KEYS.format(
                name="lineitem",
                test="l_orderkey IS NULL OR l_linenumber IS NULL",
                table="lineitem",
                keys="l_orderkey, l_linenumber",
            ),
            _KEYS.format(
                name="flag",
                test="bucket IS NULL",
                table="(SELECT CASE WHEN user_id % 3 > 0 THEN user_id END AS bucket FROM events)",
                keys="bucket",
            ),
        ]
    ),
)
def key_reports(spark, sf):
    flagged = tb.table(spark, sf, "events").select(F.when(F.col("user_id") % 3 > 0, F.col("user_id")).alias("bucket"))
    reports = {
        "orders": quality.key_report(tb.table(spark, sf, "orders"), ["o_orderkey"]),
        "lineitem": quality.key_report(tb.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]),
        "flag": quality.key_report(flagged, ["bucket"]),
    }
    labelled = [r.select(F.lit(n).alias("key_name"), "*") for n, r in reports.items()]
    return labelled[0].unionByName(labelled[1]).unionByName(labelled[2])


@query(
    "foreign_key_orphans",
    """SELECT l_suppkey AS key, count(*) AS rows FROM (SELECT CASE WHEN l_suppkey % 7 > 0 THEN l_suppkey END AS l_suppkey FROM lineitem)
    WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""",
)
def foreign_key_orphans(spark, sf):
    lines = tb.table(spark, sf, "lineitem").select(F.when(F.col("l_suppkey") % 7 > 0, F.col("l_suppkey")).alias("key"))
    suppliers = tb.table(spark, sf, "supplier").where("s_acctbal > 0")
    return quality.orphans(lines, "key", suppliers, "s_suppkey")


@query(
    "foreign_key_orphan_rows",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def foreign_key_orphan_rows(spark, sf):
    orders = tb.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return quality.orphan_rows(orders, "o_custkey", tb.table(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey")


@query(
    "required_columns",
    with_tables(
        "per",
        body=" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_rows FROM per"
            for c in ("pdid", "amb_temp", "gas_deviation_flag")
        ),
    ),
)
def required_columns(spark, sf):
    return quality.null_counts(tb.periodic_gmaw(spark, sf), ("pdid", "amb_temp", "gas_deviation_flag"))


@query(
    "domain_violations",
    with_tables(
        "per",
        body="""SELECT 'shift_name' AS column_name, count(*) FILTER (WHERE shift_name NOT IN ('A', 'B')) AS rows FROM per
        UNION ALL SELECT 'gas_deviation_flag', count(*) FILTER (WHERE gas_deviation_flag NOT IN ('none')) FROM per
        UNION ALL SELECT 'voltage_deviation_flag', count(*) FILTER (WHERE voltage_deviation_flag NOT IN ('none', 'single', 'sustained')) FROM per""",
    ),
)
def domain_violations(spark, sf):
    return quality.domain_violations(
        tb.periodic_gmaw(spark, sf),
        {"shift_name": ("A", "B"), "gas_deviation_flag": ("none",), "voltage_deviation_flag": ("none", "single", "sustained")},
    )


@query(
    "length_violations",
    """SELECT 'text' AS column_name, count(*) FILTER (WHERE length(text) > 300) AS rows FROM documents
    UNION ALL SELECT 'source', count(*) FILTER (WHERE length(source) > 4) FROM documents""",
)
def length_violations(spark, sf):
    return quality.length_violations(tb.table(spark, sf, "documents"), {"text": 300, "source": 4})
