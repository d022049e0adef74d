"""Typed parsing: ids, counts, rates, booleans, text, dates."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from catalogq.functions import jalali, num, text
from catalogq.operators.transforms import parsed


def values(spark, tokens, make, kind="integer"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, x string")
    out = parsed(df, ["x"] * (kind == "integer"), dict(zip(("v", "r"), make("x"))), ["x"] * (kind == "rate")).orderBy("i").collect()
    return [(r.v, r.r) for r in out]


def test_integers(spark):
    tokens = ["12", "0012", "1.0", "1e3", " 7 ", "10e-1", "0", "-0", "9223372036854775807", "9223372036854775808", "-1", "1.5", "15e-1", "", None, "x", "NaN", "1e999999999999", "0e999999999999", "+5", ".5", "5.", "۱", "1_0", "1" + "0" * 70 + "e-70", "0." + "0" * 99 + "7e100", "0." + "0" * 99 + "7e99", "1" + "0" * 70 + "e-71"]
    expect = [12, 12, 1, 1000, 7, 1, 0, 0, 2**63 - 1, "range", "negative", "fraction", "fraction", "number", "number", "number", "number", "range", 0, 5, "fraction", 5, "number", "number", 1, 7, "fraction", "fraction"]
    got = values(spark, tokens, num.integer)
    assert [r if v is None else v for v, r in got] == expect
    assert values(spark, ["", "  ", None, "3", "x"], lambda c: num.integer(c, optional=True)) == [(None, None)] * 3 + [(3, None), (None, "number")]


def test_comment_rates(spark):
    good = ["0.05", "0.15", "0.25", "0.5", "0.75", "1", "3.33", "4.85", "5", "5.00", " 4 ", "4e0"]
    assert [(str(v), r) for v, r in values(spark, good, lambda c: num.rate(c, 5, 2), "rate")] == [(f"{float(t):.2f}", None) for t in good]
    bad = {"3.500": "scale", "0": "zero", "0.000": "zero", "-0": "zero", "-1": "number", "5.001": "number", "5.000000000000000000001": "number", "2500": "number", "bad": "number", "NaN": "number", "inf": "number", "": "blank", " ": "blank", None: "blank"}
    assert values(spark, list(bad), lambda c: num.rate(c, 5, 2), "rate") == [(None, r) for r in bad.values()]


def test_product_rates(spark):
    got = values(spark, ["0", "100", "100.0", "100.1", "-0.5", "78.4", ""], lambda c: num.rate(c, 100, kind="double"), "rate")
    assert got == [(0.0, None), (100.0, None), (100.0, None), (None, "number"), (None, "number"), (78.4, None), (None, "blank")]


def test_text_and_booleans(spark):
    df = spark.createDataFrame([(t,) for t in ["nan", "NAN", " a ", "", " \t　", "‌", None, "True", "true"]], "x string")
    got = df.select(text.clean_text(F.col("x"), "nan").alias("s"), text.clean_text(F.col("x")).alias("t"), text.strict_boolean(F.col("x")).alias("b")).collect()
    assert [r.s for r in got] == [None, "NAN", " a ", None, None, "‌", None, "True", "true"]
    assert got[0].t == "nan" and [r.b for r in got[-2:]] == [True, None]


@pytest.mark.parametrize(
    "token, day",
    [("1 فروردین 1", date(622, 3, 21)), ("1 فروردین 1397", date(2018, 3, 21)), ("1 فروردین 1400", date(2021, 3, 21)), ("30 اسفند 1399", date(2021, 3, 20)), ("23 تیر 1395", date(2016, 7, 13)), ("31 مهر 1399", "day"), ("30 اسفند 1400", "day"), ("0 تیر 1400", "day"), ("1  تیر 1400", "form"), ("1 Tir 1400", "form"), ("1 دی 0000", "year"), ("1 دی 9378", "year"), ("۱ تیر 1400", "form"), (None, "missing"), ("30 اسفند 9377", date(9999, 3, 20))],
)
def test_jalali(spark, token, day):
    token = token if token is None or not token.endswith(" 1") else token[:-1] + "0001"
    iso, got, why = jalali.parsed(F.col("x"))
    r = spark.createDataFrame([(token,)], "x string").select(iso.alias("i"), got.alias("g"), why.alias("w")).first()
    assert (r.g or r.w) == day and (r.i is None) == (r.g is None)
