"""Read-only SQL access and checks on tables of query texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import text
from millrace.operators.filters import MANDATORY
from millrace.operators.ordering import DEFAULT_LIMIT, ROW_CAP
from millrace.session import setting
from millrace.sources.catalog import qualify

# A text holding one of these words is refused, wherever the word stands.
BLOCKED = r"(?i)\b(INSERT|UPDATE|DELETE|DROP|TRUNCATE|ALTER|CREATE|GRANT|REVOKE|COPY)\b"
READS = r"(?i)^\s*(SELECT|WITH)\b"
# Spark only: built-in functions that run foreign code or read files.
CATALYST = "org.apache.spark.sql.catalyst"
FOREIGN_FUNCTIONS = frozenset(("reflect", "java_method", "try_reflect", "from_protobuf", "to_protobuf"))
LIMITED = r"\blimit\s+\d+"
AGGREGATES = r"\b(count|sum|avg|min|max)\s*\("
REFUSED = "Only SELECT queries are allowed."


def guard_label(sql: Column | str) -> Column:
    """``blocked_word``, ``not_select`` or ``ok`` for a column of query texts."""
    c = text.col(sql)
    return F.when(c.rlike(BLOCKED), "blocked_word").when(~c.rlike(READS), "not_select").otherwise("ok")


def is_readable(sql: str) -> bool:
    """The same rule for one text."""
    return not re.search(BLOCKED, sql) and bool(re.match(READS, sql))


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def parsed_names(spark: SparkSession, sql: str) -> tuple[list[list[str]], list[list[str]], set[str], set[str]]:
    """Relations, functions, names of common table expressions and kinds of nodes in the parsed, unresolved plan.

    Quoting, comments and nesting make no difference to a tree.
    """
    gateway = spark._sc._gateway
    relations, functions, own, kinds = [], [], set(), set()
    open_ = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while open_:
        node = open_.pop()
        kind = node.getClass().getSimpleName()
        kinds.add(kind)
        if kind == "UnresolvedRelation":
            relations.append(_items(node.multipartIdentifier()))
        elif kind == "UnresolvedFunction":
            functions.append(_items(node.nameParts()))
        elif kind == "UnresolvedTableValuedFunction":
            functions.append(_items(node.name()))
        elif kind == "UnresolvedWith":
            for relation in _items(node.cteRelations()):
                own.add(relation._1().lower())
                open_.append(relation._2())
        open_.extend(_items(node.children()))
        if is_instance_of(gateway, node, f"{CATALYST}.plans.QueryPlan"):
            open_.extend(_items(node.expressions()))
        elif is_instance_of(gateway, node, f"{CATALYST}.expressions.PlanExpression"):
            open_.append(node.plan())
    return relations, functions, own, kinds


def refuse_foreign(spark: SparkSession, sql: str) -> None:
    """Allow known tables and Spark's own functions only, except those that run foreign code; no scripts."""
    relations, functions, own, kinds = parsed_names(spark, sql)
    built_in = {r[0] for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} - FOREIGN_FUNCTIONS
    for name in functions:
        if name[-1].lower() not in built_in or len(name) > 1:
            raise ValueError(f"{REFUSED} Function {'.'.join(name)} is not available.")
    for name in relations:
        known = len(name) == 1 or spark.catalog.tableExists(".".join(f"`{part}`" for part in name))
        if not known and name[0].lower() not in own:
            raise ValueError(f"{REFUSED} There is no table {'.'.join(name)}.")
    if any("Script" in kind or kind.endswith("Command") for kind in kinds):
        raise ValueError(REFUSED)


@dataclass
class Answer:
    columns: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    row_count: int = 0
    truncated: bool = False
    error: str | None = None


def read_frame(
    spark: SparkSession, sql: str, cap: int | None = ROW_CAP, names: Iterable[str] = ()
) -> DataFrame:
    """Lazy form; ``cap=None`` leaves the result whole. ``names`` lists registered
    tables that the text may call ``schema.table``. Files are no tables here."""
    if not is_readable(sql.strip()):
        raise ValueError(REFUSED)
    text_ = qualify(sql.strip().rstrip(";"), list(names))
    with setting(spark, "spark.sql.runSQLOnFiles", "false"):
        refuse_foreign(spark, text_)
        df = spark.sql(text_)
    return df if cap is None else df.limit(cap)


def row_limit(sql: str) -> int:
    """Rows shown: fewer for texts that neither limit nor aggregate."""
    open_ended = not re.search(LIMITED, sql.lower()) and not re.search(AGGREGATES, sql.lower())
    return DEFAULT_LIMIT if open_ended else ROW_CAP


def execute_sql(spark: SparkSession, sql: str, cap: int | None = None, names: Iterable[str] = ()) -> Answer:
    """Run one query; at most ``cap`` + 1 rows reach the driver, errors are returned as data.
    By default the cap is that of ``row_limit``."""
    cap = row_limit(sql) if cap is None else cap
    try:
        df = read_frame(spark, sql, cap + 1, names)
        rows = [r.asDict(recursive=True) for r in df.collect()]
    except (ValueError, PySparkException) as problem:
        return Answer(error=str(problem))
    return Answer(df.columns, rows[:cap], min(len(rows), cap), len(rows) > cap)


# What comes first in a text decides what the rest is part of: a dash within a
# literal opens no comment, a quote within a comment no literal.
LITERAL, QUOTED, COMMENT = r"'(?:[^']|'')*+(?:'|\z)", r'"(?:[^"]|"")*+(?:"|\z)', r"--[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"


def without_comments(sql: Column) -> Column:
    """Comments become a blank; literals and quoted names stay."""
    return F.regexp_replace(sql, f"({LITERAL}|{QUOTED})|{COMMENT}", "$1 ")


def code_only(sql: Column) -> Column:
    """The text with comments, literals and quoted names blanked; texts without any are not searched."""
    quiet = ~(sql.contains("'") | sql.contains('"') | sql.contains("--") | sql.contains("/*"))
    literals = F.regexp_replace(without_comments(sql), f"({LITERAL})|({QUOTED})", " '' ")
    return F.when(quiet, sql).otherwise(literals)


def lint_rules(sql: Column | str) -> Mapping[str, Column]:
    """Rule id to the condition under which a query text breaks it.

    Rules see code only: comments, literals and quoted names are blanked first,
    but for the one about literals and the one about markup. Each rule starts with
    a plain substring search, so patterns run only on texts that can break it.
    """
    raw = F.lower(text.col(sql))
    c = code_only(raw)

    def has(word: str, pattern: str | None = None) -> Column:
        return c.contains(word) & c.rlike(pattern or rf"\b{word}\b")

    rules = {}
    for table, flags in MANDATORY.items():
        name = table.split(".")[-1]
        missing = F.lit(False)
        for column, value in flags.items():
            wanted = str(value).lower()
            bare = rf"\bnot\s+(\w+\.)?{column}\b" if value is False else rf"\b(where|and|or)\s*\(*\s*(\w+\.)?{column}\s*(\)|;|$|\b(and|or|group|order|limit|having|union)\b)"
            missing = missing | ~c.rlike(rf"\b{column}\s*=\s*{wanted}\b|\b{column}\s+is\s+{wanted}\b|{bare}")
        rules[f"missing_filter_{name}"] = has(name) & missing
    filtered = c.rlike(r"\b(timer_overflow|travel_outlier)\b") & ~has("fact_summarize_gascutting")
    rules["forbidden_filter"] = has("fact_periodic_gascutting") & filtered
    rules["counter_sum"] = has(
        "_consumption", r"\bsum\s*\(\s*(\w+\.)?(total_lpg_consumption|total_o2_consumption_meter[12])\b"
    )
    rules["shift_literal"] = raw.contains("'shift") & without_comments(raw).rlike(r"'shift\s+[abc]'")
    efficiency = has("arc_efficiency_pct")
    rules["efficiency_range"] = efficiency & ~c.rlike(r"\barc_efficiency_pct\s+between\s+0\s+and\s+200\b")
    rules["efficiency_table"] = efficiency & c.rlike(r"\b(clad|gascutting)\.")
    bare = r"\b(from|join)\s+(fact_|dim_|v_)\w+"
    rules["unqualified_table"] = (c.contains("from") | c.contains("join")) & c.rlike(bare)
    windowed = has("over", r"\bover\s*\(") & ~c.rlike(r"^\s*with\b")
    rules["window_in_union"] = has("union", r"\bunion\s+all\b") & windowed
    rules["unrounded_average"] = has("avg", r"\bavg\s*\(") & ~c.rlike(r"\bround\s*\(")
    rules["unguarded_ratio"] = has("valid_sessions", r"\bvalid_sessions\b[^/]*/") & ~c.rlike(r"\bnullif\s*\(")
    rules["no_limit"] = ~c.rlike(LIMITED) & ~c.rlike(AGGREGATES)
    rules["markdown"] = raw.contains("```")
    return rules


def broken_rules(sql: Column | str) -> Column:
    """Ids of the broken rules in rule order, comma-separated."""
    return F.concat_ws(",", *[F.when(bad, F.lit(rule)) for rule, bad in lint_rules(sql).items()])
