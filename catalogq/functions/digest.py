"""Framed byte forms of rows and their digests.

A frame keeps type, length and content apart, so different rows never have the same bytes. Digests inform
and break ties; equality is always decided on the columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _length(b: Column) -> Column:
    """Eight bytes, the most significant first."""
    return F.unhex(F.lpad(F.hex(F.octet_length(b).cast("bigint")), 16, "0"))


def _utf8(c: Column) -> Column:
    return F.encode(c.cast("string"), "UTF-8")


def _frame(c: Column, tag: str) -> Column:
    b = F.coalesce(_utf8(c), F.encode(F.lit(""), "UTF-8"))
    return F.concat(F.encode(F.when(c.isNull(), "N").otherwise(tag), "UTF-8"), _length(b), b)


def framed(columns: list[tuple[Column, str]]) -> Column:
    """Bytes of a row: per column its tag (S text, I integer, F floating, D decimal, B boolean; ``N`` for null), eight
    bytes of length, the content; a null has length 0."""
    return F.concat(*[_frame(c, tag) for c, tag in columns])


def digest(columns: list[tuple[Column, str]]) -> Column:
    """SHA-256 of the framed row, in hex."""
    return F.sha2(framed(columns), 256)


def exact_digest(columns: list[Column]) -> Column:
    """SHA-256 over text columns, framed."""
    return digest([(c, "S") for c in columns])


def text_fingerprint(columns: list[Column]) -> Column:
    """SHA-256 over raw text columns: ``V`` with length and content, or ``N`` alone for null."""
    present = lambda c: F.concat(F.encode(F.lit("V"), "UTF-8"), _length(_utf8(c)), _utf8(c))
    return F.sha2(F.concat(*[F.coalesce(present(c), F.encode(F.lit("N"), "UTF-8")) for c in columns]), 256)


def float_text(c: Column) -> Column:
    """Text of a double as shortest round trip, in plain notation from 1e-4 on as other languages write it."""
    short = F.regexp_replace(F.regexp_replace(F.substring_index(c.cast("string"), "E", 1), r"\.", ""), "0+$", "")
    return F.when((c < 1e-3) & (c >= 1e-4), F.concat(F.lit("0.000"), short)).otherwise(c.cast("string"))
