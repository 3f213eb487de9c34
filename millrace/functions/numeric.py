"""Exact, order-independent sums and the rounding rule of the reports.

Sums of doubles depend on the order in which partitions arrive, so a value that
sits on a rounding tie can change between two runs. Here a reading is cut into
whole numbers that are added as bigints: exact, codegen-friendly and mergeable
map-side. Readings with up to six decimals, which is what sensors report, are
added as the decimals they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Decimal places that are added as decimals; what a reading holds beyond them is
# added in units of 2**-24 and 2**-48 of the last place.
READING_PLACES = 6
REST_UNITS = float(1 << 24)
# A quotient or product of decimals lies within so many shares of its size of the decimal it stands for.
RESIDUE = 2.0**-51
# From this size on doubles have no fraction; such readings are added as doubles.
WIDE = float(1 << 53)
LOW_BITS = 24


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pieces(c: Column | str, places: int) -> dict[str, Column]:
    """A reading as whole numbers that add up exactly, and under ``wide`` what is no ordinary number."""
    value = _col(c).cast("double")
    usual = F.when(F.abs(value) < WIDE, value)
    unit = float(10**places)
    whole = F.floor(usual)
    part = F.rint((usual - whole) * unit)
    beyond = (usual - whole) * unit - part
    # A reading that is a decimal, but for the last places of a double, has no rest:
    # it would pull a sum that lies on a rounding tie to one side.
    residue = (whole + part / unit == usual) | (F.abs(beyond) <= F.abs(usual) * (unit * RESIDUE))
    rest = F.when(residue, F.lit(0.0)).otherwise(beyond)
    coarse = F.floor(rest * REST_UNITS)
    fine = F.rint((rest * REST_UNITS - coarse) * REST_UNITS).cast("bigint")
    return {
        "high": F.shiftright(whole, LOW_BITS),
        "low": whole.bitwiseAND(F.lit((1 << LOW_BITS) - 1).cast("bigint")),
        "part": part.cast("bigint"),
        "coarse": F.when(usual.isNotNull(), coarse),
        "fine": F.when(usual.isNotNull(), fine),
        "wide": F.when(F.isnan(value) | (F.abs(value) >= WIDE), value),
    }


def _joined(sums: dict[str, Column], places: int) -> tuple[Column, Column]:
    """(exact sum, sum of what is no ordinary number) from the sums of all ``_pieces``."""
    unit = float(10**places)
    beyond = (sums["coarse"].cast("double") + sums["fine"].cast("double") / REST_UNITS) / (REST_UNITS * unit)
    scale = F.lit(10**places).cast("decimal(10,0)")
    exact = (
        (sums["high"].cast("decimal(24,0)") * F.lit(1 << LOW_BITS).cast("decimal(8,0)") + sums["low"].cast("decimal(24,0)")).cast("decimal(38,16)")
        + (sums["part"].cast("decimal(24,0)") / scale).cast("decimal(38,16)")
        + beyond.cast("decimal(38,16)")
    ).cast("decimal(38,16)")
    return exact, sums["wide"]


def _sums(c: Column | str, places: int) -> tuple[Column, Column]:
    """(exact sum as DECIMAL(38,16), sum of what is no ordinary number), each NULL without such values.

    The second one takes NaN, infinities and readings of 2**53 and more. Only for
    those does the result follow the rules, and the rounding, of doubles. The
    bigints hold more than ten billion readings of the largest size per group,
    and some 10**12 of usual ones; beyond, the sum fails rather than wraps.
    """
    return _joined({name: F.sum(piece) for name, piece in _pieces(c, places).items()}, places)


def exact_sum(c: Column | str, places: int = READING_PLACES) -> Column:
    """Sum of a double column as a double; NULL when no value is present, NaN when one is NaN."""
    exact, wide = _sums(c, places)
    return F.when(wide.isNull(), exact.cast("double")).otherwise(wide + F.coalesce(exact.cast("double"), F.lit(0.0)))


def round_half_up(c: Column, places: int) -> Column:
    """Round half away from zero and hand back a double."""
    return F.round(c, places).cast("double")


def _mean(exact: Column, wide: Column, n: Column, places: int) -> Column:
    usual = round_half_up(F.try_divide(exact, n.cast("decimal(20,0)")), places)
    return F.when(wide.isNull(), usual).otherwise(F.round((wide + F.coalesce(exact.cast("double"), F.lit(0.0))) / n, places))


def _total(exact: Column, wide: Column, places: int, divisor: int) -> Column:
    unit = F.lit(divisor).cast("decimal(10,0)")
    usual = round_half_up(exact / unit if divisor != 1 else exact, places)
    return F.when(wide.isNull(), usual).otherwise(F.round((wide + F.coalesce(exact.cast("double"), F.lit(0.0))) / divisor, places))


def mean(c: Column | str, places: int) -> Column:
    """Exact average of the non-null values, rounded."""
    value = _col(c)
    return _mean(*_sums(value, READING_PLACES), F.count(value), places)


def total(c: Column | str, places: int, divisor: int = 1) -> Column:
    """Exact sum, optionally converted to a larger unit, rounded."""
    return _total(*_sums(c, READING_PLACES), places, divisor)


def sum_state(c: Column | str) -> Column:
    """Aggregate that keeps a sum and its count unfinished: a struct of numbers that add up exactly, to be stored and merged."""
    value = _col(c)
    return F.struct(*[F.sum(piece).alias(name) for name, piece in _pieces(value, READING_PLACES).items()], F.count(value).alias("n"))


def _merged(state: str) -> tuple[Column, Column]:
    names = ("high", "low", "part", "coarse", "fine", "wide")
    return _joined({name: F.sum(F.col(state)[name]) for name in names}, READING_PLACES)


def mean_of_states(state: str, places: int) -> Column:
    """``mean`` of all rows behind the states in a column; equal to it in every digit, however the rows were parted."""
    return _mean(*_merged(state), F.sum(F.col(state)["n"]), places)


def total_of_states(state: str, places: int, divisor: int = 1) -> Column:
    """``total`` of all rows behind the states in a column."""
    return _total(*_merged(state), places, divisor)


def count_where(condition: Column) -> Column:
    """Rows where the condition is true; unknown does not count."""
    return F.count_if(condition)


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """``part / whole * 100`` of two aggregates, exact; a zero or missing whole gives NULL."""
    ratio = F.try_divide(part.cast("decimal(24,6)") * 100, whole.cast("decimal(24,6)"))
    return round_half_up(ratio, places)


def row_percent(part: Column, whole: Column, places: int = 2) -> Column:
    """The same within a row, in doubles. Multiplying first leaves one rounding, so
    whole numbers come out as exactly as in decimals at half the cost."""
    return F.round(F.try_divide(part * 100, whole), places)
