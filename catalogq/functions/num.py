"""Exact numbers from text, by digits and never through floating point."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions.text import is_blank, stripped

#: A finite decimal number: sign, whole digits, fraction digits (either may be empty, not both), exponent.
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: Powers of ten, beyond as many as a text has digits, at which a bigint is overflown or nothing is left before the point.
FAR = 60


@dataclass(frozen=True)
class Digits:
    """A number text taken apart: all digits, and the power of ten of the last one."""

    valid: Column
    negative: Column
    digits: Column
    shift: Column

    @property
    def is_zero(self) -> Column:
        return self.digits.rlike("^0*$")

    @property
    def integral(self) -> Column:
        """No digit other than 0 stands behind the point."""
        behind = F.when(self.shift < 0, F.right(self.digits, F.least(-self.shift, F.length(self.digits)))).otherwise(F.lit(""))
        return behind.rlike("^0*$")

    @property
    def whole(self) -> Column:
        """Magnitude of the whole part as digits without leading zeros."""
        kept = F.when(self.shift >= 0, F.concat(self.digits, F.repeat(F.lit("0"), self.shift))).otherwise(F.left(self.digits, F.greatest(F.lit(0), F.length(self.digits) + self.shift)))
        return F.regexp_replace(kept, "^0+", "")


def _taken_apart(t: Column) -> Column:
    """Struct of a stripped text's parts."""
    low = F.lower(t)  # the only letter of a number is its e
    mantissa = F.ltrim(F.substring_index(low, "e", 1), F.lit("+-"))
    exponent = F.when(low.contains("e"), F.substring_index(low, "e", -1)).otherwise("0")
    far = F.length(mantissa) + FAR
    power = F.coalesce(exponent.try_cast("int"), F.when(exponent.startswith("-"), -far).otherwise(far))
    fraction = F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("")
    return F.struct(
        F.coalesce(t.rlike(NUMBER), F.lit(False)).alias("valid"),
        t.startswith("-").alias("negative"),
        F.concat(F.substring_index(mantissa, ".", 1), fraction).alias("digits"),
        (F.greatest(-far, F.least(far, power)) - F.length(fraction)).alias("shift"),
    )


#: Spellings that need not be taken apart: those of nearly all values.
PLAIN = {"integer": "^[0-9]{1,18}$", "rate": r"^[0-9]{1,3}(\.[0-9]{1,9})?$"}


def with_digits(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds ``__d_<column>`` per column and kind ("integer" or "rate"): the stripped text, whether it is plain, and only if it is not
    its parts, once however often they are used."""
    judged = df.withColumns({f"__p_{c}": F.coalesce(F.col(c).rlike(PLAIN[k]), F.lit(False)) for c, k in columns.items()})
    texts = judged.withColumns({f"__t_{c}": F.when(F.col(f"__p_{c}"), F.col(c)).otherwise(stripped(F.col(c))) for c in columns})
    parts = texts.withColumns({f"__d_{c}": F.struct(F.col(f"__t_{c}").alias("text"), F.col(f"__p_{c}").alias("plain"), F.when(~F.col(f"__p_{c}"), _taken_apart(F.col(f"__t_{c}"))).alias("parts")) for c in columns})
    return parts.drop(*[f"__{x}_{c}" for x in "tp" for c in columns])


def digits(column: str) -> Digits:
    """The parts that with_digits added; null where the text is plain."""
    d = F.col(f"__d_{column}")["parts"]
    return Digits(d["valid"], d["negative"], d["digits"], d["shift"])


def _plain(column: str) -> tuple[Column, Column]:
    d = F.col(f"__d_{column}")
    return d["plain"], d["text"]


def integer(column: str, optional: bool = False) -> tuple[Column, Column]:
    """(value, reason): a non-negative integer up to 2^63-1, in any decimal spelling (``0012``, ``1.0``, ``1e3``).

    ``reason`` is null for a valid value and else "number", "fraction", "negative" or "range". With ``optional`` a
    blank is valid and null. Needs with_digits.
    """
    (plain, text), d = _plain(column), digits(column)
    value = F.coalesce(F.nullif(d.whole, F.lit("")), F.lit("0")).try_cast("bigint")
    reason = F.when(plain, None).when(~d.valid, "number").when(~d.integral, "fraction").when(d.negative & ~d.is_zero, "negative").when(value.isNull(), "range")
    if optional:
        reason = F.when(~plain & ~is_blank(F.col(column)), reason)
    sound = d.valid & d.integral & ~(d.negative & ~d.is_zero)
    return F.when(plain, text.try_cast("bigint")).when(sound, value), reason


def scale(column: str) -> Column:
    """Digits behind the point as the number is written. Needs with_digits for a rate."""
    plain, text = _plain(column)
    return F.when(plain, F.when(text.contains("."), F.length(F.substring_index(text, ".", -1))).otherwise(0)).otherwise(-digits(column).shift)


def rate(column: str, top: int, scale_limit: int | None = None, kind: str = "decimal(3,2)") -> tuple[Column, Column]:
    """(value, reason): a number from 0 to ``top``; with ``scale_limit`` no more digits behind the point than that.

    The scale is that of the text: 3.500 has three. Reasons: "blank" (null or white space), "number" (no number or out
    of range), "zero", "scale". A zero has a value only without ``scale_limit``, where zero is no reason. Needs with_digits.
    """
    (plain, text), d = _plain(column), digits(column)
    number = F.concat(F.when(d.negative, "-").otherwise(""), d.digits, F.lit("e"), d.shift.cast("string"))
    exact = F.when(plain, text).otherwise(number).try_cast("decimal(38,18)")
    # a whole part equal to the top is within only if nothing but zeros follows
    outside = F.when(plain, exact > top).otherwise(exact.isNull() | (exact > top) | (d.negative & ~d.is_zero) | ((d.whole == str(top)) & ~d.integral))
    valid, zero = plain | d.valid, F.when(plain, exact == 0).otherwise(d.is_zero)
    reason = F.when(~plain & is_blank(F.col(column)), "blank").when(~valid | outside, "number")
    sound = valid & ~outside
    if scale_limit is not None:
        reason = reason.when(zero, "zero").when(scale(column) > scale_limit, "scale")
        sound = sound & ~zero & (scale(column) <= scale_limit)
    return F.when(sound, exact.cast(kind)), reason


def as_number(c: Column) -> Column:
    """double of a plain number text, null for anything else; for profiling."""
    t = stripped(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))
