import math
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import numeric, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column).first()[0]


def test_null_tokens(spark, values):
    df = spark.createDataFrame([(v,) for v in ["", "None", "NaN", "nan", "NULL", "null", "<NA>", "NIL", " NULL"]], "c string")
    kept = df.select(text.null_if_token("c").alias("c")).where("c is not null")
    assert values(kept) == [(" NULL",), ("NIL",)]


def test_boolean_spellings(spark):
    cases = {"True": True, "true": True, "False": False, "FALSE": False, "t": None, "1": None, "yes": None, None: None}
    for cell, expected in cases.items():
        assert one(spark, text.to_boolean("c"), cell) is expected


def test_integers(spark):
    cases = {
        "71.0": 71, "-3.9": -3, "007": 7, " 5 ": 5, "1e3": 1000, "": None, "x": None, "1.2.3": None,
        "9007199254740993": 9007199254740993, "99999999999999999999": None, None: None,
    }
    for cell, expected in cases.items():
        assert one(spark, text.to_integer("c"), cell) == expected
    assert one(spark, text.to_integer("c", "smallint"), "99999") is None


def test_integer_decoding_is_idempotent(spark):
    twice = text.to_integer(text.to_integer("c").cast("string"))
    for cell in ("71.0", "-3.9", "x", None):
        assert one(spark, twice, cell) == one(spark, text.to_integer("c"), cell)


def test_doubles(spark):
    for cell, expected in {"1.5": 1.5, "-2": -2.0, ".5": 0.5, "1e-3": 0.001, "abc": None, None: None}.items():
        assert one(spark, text.to_double("c"), cell) == expected


def test_names_and_pairs(spark):
    assert one(spark, text.tidy_name("c"), " Torch -1") == "Torch-1"
    assert one(spark, text.first_of_pair("c"), "1.5,-2") == 1.5
    assert one(spark, text.second_of_pair("c"), "1.5, -2") == -2.0
    assert one(spark, text.second_of_pair("c"), "1.5") is None


def test_strip_removes_line_breaks(spark):
    assert one(spark, text.strip("c"), "\n\t a b \r\n") == "a b"


def test_replies(spark):
    assert one(spark, text.strip_fences("c"), "```sql\nSELECT 1\n```") == "SELECT 1"
    assert one(spark, text.extract_sql("c"), "Sure:\nwith a as (select 1)\nselect * from a\n") == "with a as (select 1)\nselect * from a"
    assert one(spark, text.extract_sql("c"), "no statement") == "no statement"
    assert one(spark, text.extract_json("c"), 'x {"a":\n{"b":1}} y') == '{"a":\n{"b":1}}'
    assert one(spark, text.extract_json("c"), "none") is None


def test_missing(spark):
    assert one(spark, text.is_missing("c"), float("nan"), "double") is True
    assert one(spark, text.is_missing("c"), None, "double") is True
    assert one(spark, text.is_missing("c"), 0.0, "double") is False


def test_rounding_of_ties(spark):
    df = spark.createDataFrame([(1.01,), (1.02,)], "v double")
    assert df.agg(numeric.mean("v", 2)).first()[0] == 1.02
    negative = df.select((-F.col("v")).alias("v"))
    assert negative.agg(numeric.mean("v", 2)).first()[0] == -1.02


def test_derived_decimals_on_a_tie(spark):
    # Quotients and products that are decimals but for the last places of a double: sums on ties stay on them.
    rows = [(c / 100.0, (c * 3) * 0.01) for c in range(100_001, 104_001)]
    df = spark.createDataFrame(rows, "q double, p double")
    cents = sum(range(100_001, 104_001))
    exact = Decimal(cents) / 100 / 4000
    half = lambda x: float(x.quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert exact * 1000 % 10 == 5
    assert df.agg(numeric.mean("q", 2), numeric.mean("p", 2)).first()[:] == (half(exact), half(exact * 3))
    # One kept residue of 1e-13 would already do harm; readings that are no decimals keep theirs.
    third = spark.createDataFrame([(1 / 3,), (2 / 3,), (0.1 + 2.0**-30,)], "v double")
    assert third.agg(numeric.exact_sum("v")).first()[0] == pytest.approx(1.1 + 2.0**-30, rel=1e-15)


def test_sums_do_not_depend_on_order(spark):
    df = spark.range(30_000).select(((F.col("id") * 7919 % 1000) / 100 + 0.1).alias("v"))
    one_way = df.agg(numeric.exact_sum("v")).first()[0]
    other = df.repartition(7).orderBy(F.rand(3)).agg(numeric.exact_sum("v")).first()[0]
    assert one_way == other


@pytest.mark.parametrize(
    "numbers, expected",
    [
        ([1 / 3] * 3, 1.0), ([0.1] * 10, 1.0), ([1e19, -1e19, 2.5], 2.5), ([-0.1, -0.2, 0.3], 0.0), ([-1.5, 2.25, 1e15, 0.1], 1000000000000000.85),
        ([2.0**53 - 1, 0.5], 2.0**53 - 0.5), ([float("inf"), 1.0], float("inf")), ([1e300, 1.0], 1e300), ([1e-20] * 4, 4e-20), ([-4e-7] * 5, -2e-6),
    ],
)
def test_sums_of_any_reading(spark, numbers, expected):
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    assert df.agg(numeric.exact_sum("v")).first()[0] == pytest.approx(expected, rel=1e-15, abs=1e-19)


def test_sums_with_undefined_readings(spark):
    for numbers in ([1.0, float("nan")], [float("inf"), -float("inf")]):
        df = spark.createDataFrame([(v,) for v in numbers], "v double")
        row = df.agg(numeric.exact_sum("v"), numeric.mean("v", 2), numeric.total("v", 2)).first()
        assert all(math.isnan(v) for v in row)


def test_small_readings_add_up(spark):
    df = spark.range(10_000_000).select(F.lit(4e-7).alias("v"))
    assert df.agg(numeric.exact_sum("v"), numeric.total("v", 2)).first()[0] == pytest.approx(4.0, rel=1e-14)


def test_empty_groups(spark):
    df = spark.createDataFrame([(None,)], "v double")
    row = df.agg(numeric.mean("v", 2), numeric.total("v", 2), numeric.count_where(F.col("v") > 0)).first()
    assert tuple(row) == (None, None, 0)


def test_percent_of_nothing(spark):
    df = spark.createDataFrame([(5.0, 0.0), (1.0, 8.0)], "a double, b double")
    assert [r[0] for r in df.select(numeric.row_percent(F.col("a"), F.col("b"))).collect()] == [None, 12.5]
    assert [r[0] for r in df.select(numeric.percent(F.col("a"), F.col("b"))).collect()] == [None, 12.5]
