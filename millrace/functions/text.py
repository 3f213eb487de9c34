"""Text-level expressions: token decoding, casts and pattern extraction."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

# Cell texts that mean "missing" (the writer's own set and the
# defaults of the CSV reader that runs before it).
NULL_TOKENS = (
    "", "None", "NaN", "nan", "NULL", "null", "<NA>",
    "NA", "N/A", "n/a", "#N/A", "#N/A N/A", "#NA", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN",
)

# The only spellings read as booleans.
TRUE_TOKENS = ("True", "true", "TRUE")
FALSE_TOKENS = ("False", "false", "FALSE")

WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DAY = r"^\d{4}-"



def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_token(c: Column | str, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Whole-cell match only: ``NIL`` and padded texts stay."""
    return F.when(~col(c).isin(*tokens), col(c))


def to_boolean(
    c: Column | str, true: Iterable[str] = TRUE_TOKENS, false: Iterable[str] = FALSE_TOKENS
) -> Column:
    """Listed spellings only; a cast would also accept ``t``, ``1`` and ``yes``."""
    return F.when(col(c).isin(*true), True).when(col(c).isin(*false), False)


def flag_letter(c: Column | str) -> Column:
    """Raw exports write booleans as ``t`` and ``f``."""
    return to_boolean(c, ("t",), ("f",))


def to_integer(c: Column | str, as_type: str = "bigint") -> Column:
    """Read ``14.0`` as 14, truncating toward zero; unreadable text becomes NULL.

    Plain digits are cast directly: the detour through double would lose digits
    beyond 2^53. The pattern decides beforehand, because a failing ``try_cast``
    raises and catches inside the JVM and is some twenty times slower.
    """
    text = col(c).cast("string")
    number = text.rlike(NUMBER)
    whole = text.rlike(WHOLE_NUMBER)
    return F.when(whole, text.try_cast(as_type)).when(number, text.try_cast("double").try_cast(as_type))


def to_double(c: Column | str) -> Column:
    """Decimal text to double without raising on junk."""
    text = col(c).cast("string")
    return F.when(text.rlike(NUMBER), text.cast("double"))


def is_missing(c: Column | str) -> Column:
    """NULL or NaN: Spark keeps the two apart, the checks do not."""
    return col(c).isNull() | F.isnan(col(c).cast("double"))


def strip(c: Column | str) -> Column:
    """Remove all surrounding whitespace, line breaks included."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def tidy_name(c: Column | str) -> Column:
    """``Torch -1`` and ``Torch-1`` are the same machine."""
    return F.regexp_replace(F.trim(col(c)), r"\s*-\s*", "-")


def lookup(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup as a literal map; unmapped values give NULL."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), col(c))


def first_of_pair(c: Column | str) -> Column:
    return to_double(F.try_element_at(F.split(col(c), ","), F.lit(1)))


def second_of_pair(c: Column | str) -> Column:
    return to_double(F.try_element_at(F.split(col(c), ","), F.lit(2)))


def contains_any(c: Column | str, keywords: Iterable[str]) -> Column:
    """True when the lower-cased text holds one of the keywords as a substring.

    A chain of substring searches; an alternation of 17 words is three times slower.
    """
    lowered = F.lower(col(c))
    return reduce(lambda found, k: found | lowered.contains(k), keywords, F.lit(False))


# Patterns of code fences, of the first SQL query and of the JSON object in a reply.
FENCE_OPEN, FENCE_CLOSE = r"```(?:sql|json)?\s*", r"\s*```"
FIRST_SQL = r"(?is)((?:WITH|SELECT)\b.*)"
JSON_OBJECT = r"(?s)\{.*\}"


def strip_fences(c: Column | str) -> Column:
    """Drop code fences from a stored model reply."""
    opened = F.regexp_replace(col(c), FENCE_OPEN, "")
    return strip(F.regexp_replace(opened, FENCE_CLOSE, ""))


def extract_sql(c: Column | str) -> Column:
    """From the first WITH or SELECT to the end; texts without one come back whole."""
    text = strip_fences(c)
    found = strip(F.regexp_extract(text, FIRST_SQL, 1))
    return F.when(found != "", found).otherwise(text)


def extract_json(c: Column | str) -> Column:
    """From the first ``{`` to the last ``}``; NULL when there is none."""
    found = F.regexp_extract(strip_fences(c), JSON_OBJECT, 0)
    return F.when(found != "", found)
