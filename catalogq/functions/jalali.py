"""Solar Hijri dates as native expressions.

Leap years follow the 33-year cycle: 8 of 33 years, the years 1, 5, 9, 13, 17, 22, 26 and 30 of a cycle. So
floor((8y + 29) / 33) leap years lie up to year y, and everything else is integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month names in order.
MONTHS = ["فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند"]
#: 1 Farvardin of year 1, in days from 1970-01-01 (0622-03-21, proleptic Gregorian).
EPOCH = -492268
YEARS = (1, 9377)
TEXT = f"^([0-9]{{1,2}}) ({'|'.join(MONTHS)}) ([0-9]{{4}})$"


def new_year(y: Column) -> Column:
    """Days from 1970-01-01 of the year's first day."""
    before = y - 1
    return F.lit(EPOCH) + before * 365 + F.floor((before * 8 + 29) / 33).cast("int")


def is_leap(y: Column) -> Column:
    return F.pmod(y * 25 + 11, F.lit(33)) < 8


def month_length(y: Column, m: Column) -> Column:
    return F.when(m <= 6, 31).when(m <= 11, 30).otherwise(F.when(is_leap(y), 30).otherwise(29))


def day_number(y: Column, m: Column, d: Column) -> Column:
    return new_year(y) + (m - 1) * 31 - F.greatest(F.lit(0), m - 7) + d - 1


def parsed(c: Column) -> tuple[Column, Column, Column]:
    """(ISO text of the Jalali date, Gregorian date, reason) of ``D <month> YYYY``: ASCII digits, single spaces.

    Reasons: "missing", "form", "year", "day"; null for a valid date.
    """
    part = lambda i: F.regexp_extract(c, TEXT, i)
    y, d = part(3).try_cast("int"), part(1).try_cast("int")
    m = F.array_position(F.array(*map(F.lit, MONTHS)), part(2)).cast("int")
    reason = F.when(c.isNull(), "missing").when(~c.rlike(TEXT), "form").when(~y.between(*YEARS), "year").when((d < 1) | (d > month_length(y, m)), "day")
    iso = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(reason.isNull(), iso), F.when(reason.isNull(), F.date_from_unix_date(day_number(y, m, d))), reason
