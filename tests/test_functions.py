"""Column helpers, with values worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from staffcast.functions import calendar, codes, numeric


def values(spark, rows, ddl, expression):
    return [r[0] for r in spark.createDataFrame(rows, ddl).selectExpr(expression).collect()]


def test_round2_ties_and_extremes(spark):
    given = [2.675, 0.145, 1.005, -2.675, 0.004999, 1e15 + 0.5, 1e31, None]
    expected = [2.68, 0.15, 1.01, -2.68, 0.0, 1e15 + 0.5, 1e31, None]
    assert values(spark, [(v,) for v in given], "x double", numeric.round2("x")) == expected


def test_safe_div_and_or_zero(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (None, 1.0), (0.0, 0.0)]
    assert values(spark, rows, "a double, b double", numeric.safe_div("a", "b")) == [
        0.5, None, None, None,
    ]
    rows = [(None,), (float("nan"),), (3.0,)]
    assert values(spark, rows, "x double", numeric.or_zero("x")) == [0.0, 0.0, 3.0]


def test_parse_number(spark):
    rows = [("2",), (" 2.5 ",), ("",), ("x",), ("NaN",), (None,)]
    assert values(spark, rows, "x string", numeric.parse_number("x")) == [
        2.0, 2.5, None, None, None, None,
    ]


def test_strict_and_lenient_aggregates(spark):
    df = spark.createDataFrame(
        [("a", 1.0, "e1"), ("a", 1.0, "e1"), ("a", 4.0, None),
         ("b", 1.0, "e1"), ("b", None, "e2")],
        "k string, x double, e string",
    )
    result = df.groupBy("k").agg(
        F.expr(numeric.strict_sum("x")), F.expr(numeric.strict_avg("x")),
        F.expr(numeric.strict_sum_distinct("x")), F.expr(numeric.lenient_sum("x")),
        F.expr(numeric.distinct_with_missing("e")),
    )
    assert {r[0]: tuple(r[1:]) for r in result.collect()} == {
        "a": (6.0, 2.0, 5.0, 6.0, 2), "b": (None, None, None, 1.0, 2),
    }


@pytest.mark.parametrize("text, expected", [
    ("2021/8/1", dt.date(2021, 8, 1)),
    ("2021-08-01", dt.date(2021, 8, 1)),
    (" 2021/12/31 ", dt.date(2021, 12, 31)),
    ("2021-13-01", None),
    ("2021", None),
    ("soon", None),
    ("", None),
    (None, None),
])
def test_parse_day(spark, text, expected):
    assert values(spark, [(text,)], "x string", calendar.parse_day("x")) == [expected]


def test_epoch_day(spark):
    assert values(spark, [(18840.0,)], "x double", calendar.epoch_day("x")) == [
        dt.date(2021, 8, 1)
    ]


@pytest.mark.parametrize("month, start, expected", [
    ("2021-08-01", "2021-08-01", 1.0),
    ("2021-08-01", "2021-08-16", 1 - 16 / 31),
    ("2021-08-01", "2021-08-31", 0.0),
    ("2020-02-01", "2020-02-10", 1 - 10 / 29),
    ("2021-08-01", "2021-07-31", 1.0),
    ("2021-08-01", "2021-09-01", 0.0),
    ("2021-08-01", None, None),
])
def test_start_share(spark, month, start, expected):
    rows = [(dt.date.fromisoformat(month), start and dt.date.fromisoformat(start))]
    actual = values(spark, rows, "m date, s date", calendar.start_share("m", "s"))
    assert actual == [pytest.approx(expected) if expected is not None else None]


def test_months_clip_to_the_month_end(spark):
    df = spark.createDataFrame([(dt.date(2021, 3, 31),)], "d date")
    row = df.select(
        calendar.month_date(F.lit(5), F.col("d")), calendar.month_number(F.col("d"), F.col("d"))
    ).first()
    assert tuple(row) == (dt.date(2021, 2, 28), 6)


def test_planning_function(spark):
    rows = [(c,) for c in ("AR", "HW", "OP", "RF", "RX", "PV", "ME", "RH", None)]
    assert values(spark, rows, "x string", codes.planning_function("x")) == [
        "RH", "RH", "RH", "RH", "RH", "E4", "ME", "RH", None,
    ]


def test_is_filled(spark):
    rows = [("a",), ("",), (" ",), (None,)]
    assert values(spark, rows, "x string", codes.is_filled("x")) == [True, False, False, False]
