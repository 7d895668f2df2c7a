import pytest
from pyspark.sql import functions as F

from quotewright.functions.tags import matches_tag, split_tags
from quotewright.functions.values import fixed_cents, number, plain_number, to_number, truthy


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, value", [
    ("1", 1.0), (" 1.5 ", 1.5), ("-.5", -0.5), ("2.", 2.0), ("1e3", 1000.0), ("+4E-1", 0.4),
    ("", None), ("1,000", None), ("1d", None), ("0x1A", None), ("TBC", None), ("NaN", None),
    ("Inf", None), ("1e999", None), ("1 2", None), (None, None),
])
def test_to_number(spark, text, value):
    assert one(spark, to_number(F.lit(text).cast("string"))) == value


def test_number_of_a_double_column_drops_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(number(df, "x")).collect()] == [1.0, None, None]


@pytest.mark.parametrize("values, kind, expected", [
    (["TRUE", "t", "Yes", "y", "1", "N", "false", " yes", "1.0", None], "string",
     [True] * 5 + [False] * 5),
    ([1.0, 0.0, 2.0, None], "double", [True, False, False, False]),
    ([True, False, None], "boolean", [True, False, False]),
])
def test_truthy(spark, values, kind, expected):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    assert [r[0] for r in df.select(truthy(df, "x")).collect()] == expected


@pytest.mark.parametrize("text, pieces", [
    ("A", ["A"]), ("A; B", ["A", " B"]), ("A;B;", ["A", "B"]), ("A;;B", ["A", "", "B"]),
    ("A;;", ["A", ""]), (";", [""]), ("", []), ("A;\n", ["A", "\n"]),
])
def test_split_tags(spark, text, pieces):
    assert one(spark, split_tags(F.lit(text))) == pieces


def test_matches_tag(spark):
    tags = F.array(F.lit("A"), F.lit(" B"))
    assert one(spark, matches_tag(tags, "A", "W"))
    assert one(spark, matches_tag(tags, "All", "W"))
    assert one(spark, matches_tag(tags, F.lit("All"), "W"))
    assert not one(spark, matches_tag(tags, "B", "W"))
    assert one(spark, matches_tag(F.array(F.lit("W")), "B", "W"))
    assert not one(spark, matches_tag(F.array().cast("array<string>"), "B", "W"))


@pytest.mark.parametrize("x, text", [
    (15.0, "15"), (0.07 * 100, "7"), (12.5, "12.5"), (100.0, "100"), (0.0, "0"), (1e5, "100000"), (1e17, "100000000000000000"), (1e18, "1" + "0" * 18),
    (1e37, "1" + "0" * 37), (1e300, "1.0E300"),
])
def test_plain_number(spark, x, text):
    assert one(spark, plain_number(F.lit(x))) == text


@pytest.mark.parametrize("x", [0.125, 0.145, 2.675, 1234567.891, -3.5, 0.0, 1e9 + 0.005])
def test_fixed_cents_rounds_like_printf(spark, x):
    assert one(spark, fixed_cents(F.lit(x))) == f"{x:.2f}"
    assert one(spark, fixed_cents(F.lit(x), grouped=True)) == f"{x:,.2f}"
