"""Batch operators over chat transcripts, stored model replies and provider logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import text
from millrace.operators.sequences import CONTEXT_LENGTH, SESSION_LENGTH, running_last, tail

# Topics outside the plant. "hr " ends with a blank on purpose.
OUT_OF_SCOPE = (
    "salary", "payroll", "hr ", "human resources", "leave", "holiday", "recruitment", "appraisal", "finance",
    "stock market", "share price", "weather", "news", "sports", "politics", "recipe", "joke",
)

# Texts by which a provider reports a rate limit, and the pause after one.
RATE_LIMIT_TEXTS = (
    "rate limit", "rate_limit", "429", "too many requests", "quota", "resource exhausted", "tokens per",
    "requests per",
)
COOLDOWN_SECONDS = 60

# Answer used when a reply cannot be read.
DEFAULT_CATEGORY = "data_query"
DEFAULT_MACHINE_TYPES = ("ALL",)

TURN_ORDER = ("turn",)


def topic_label(question: Column | str, keywords: Sequence[str] = OUT_OF_SCOPE) -> Column:
    """``out_of_scope`` when a keyword occurs, else NULL."""
    return F.when(text.contains_any(question, keywords), "out_of_scope")


def classify(question: Column | str, reply: Column | str, keywords: Sequence[str] = OUT_OF_SCOPE) -> Mapping[str, Column]:
    """Category and machine types: keywords first, then the stored reply, then the defaults."""
    outside = topic_label(question, keywords)
    parsed = F.from_json(text.extract_json(reply), "category string, machine_types array<string>")
    nothing = F.array().cast("array<string>")
    everything = F.array(*[F.lit(t) for t in DEFAULT_MACHINE_TYPES])
    return {
        "category": F.coalesce(outside, parsed["category"], F.lit(DEFAULT_CATEGORY)),
        "machine_types": F.when(outside.isNotNull(), nothing).otherwise(
            F.coalesce(parsed["machine_types"], everything)
        ),
    }


def session_tail(messages: DataFrame, n: int = SESSION_LENGTH) -> DataFrame:
    return tail(messages, ["conv_id"], TURN_ORDER, n)


def append_turns(history: DataFrame, turns: DataFrame, n: int = SESSION_LENGTH) -> DataFrame:
    """Add new messages and keep the last ``n`` of each session."""
    return session_tail(history.unionByName(turns), n)


def clear_sessions(history: DataFrame, *conv_ids: int) -> DataFrame:
    return history.where(~F.col("conv_id").isin(*conv_ids))


def model_context(
    history: DataFrame, questions: DataFrame, system_text: str, n: int = CONTEXT_LENGTH
) -> DataFrame:
    """Per question: the system message, the session's last ``n`` turns, the question.

    ``questions`` holds (conv_id, text) once per session. The list is bounded by
    ``n`` + 2 because the history is cut before it is collected; sessions without
    history keep an empty middle part.
    """
    past = (
        session_tail(history, n)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("past"))
    )
    message = "struct<role:string,text:string>"
    spoken = F.transform("past", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    opening = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_text).alias("text")))
    question = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text")))
    return questions.join(past, "conv_id", "left").select(
        "conv_id",
        F.concat(
            opening.cast(f"array<{message}>"),
            F.coalesce(spoken, F.array()).cast(f"array<{message}>"),
            question.cast(f"array<{message}>"),
        ).alias("messages"),
    )


def is_rate_limited(message: Column | str) -> Column:
    return text.contains_any(message, RATE_LIMIT_TEXTS)


def cooldowns(log: DataFrame, order: Sequence[str] = ("ts",), seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """Provider log (provider, ts, message) with the time of the provider's previous
    rate limit and whether the provider was pausing when the row was written."""
    limited = log.withColumn("rate_limited", F.coalesce(is_rate_limited("message"), F.lit(False)))
    marked = running_last(
        limited, ["provider"], order, F.when(F.col("rate_limited"), F.col("ts")), "last_rate_limit"
    )
    age = F.timestamp_diff("MICROSECOND", "last_rate_limit", "ts")
    return marked.withColumn("in_cooldown", F.coalesce(age <= seconds * 1_000_000, F.lit(False)))


def health(readings: DataFrame) -> DataFrame:
    """One row: the store answers and holds this many readings."""
    return readings.agg(F.count("*").alias("gmaw_rows")).select(F.lit("ok").alias("status"), "gmaw_rows")
