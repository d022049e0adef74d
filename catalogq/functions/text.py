"""Text expressions: blanks, sentinels, group values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.strip() knows it; the zero-width non-joiner is none.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Without white space at either end; linear in the length of the text."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """True for null and for white space alone; a look at the first character decides nearly always."""
    return F.coalesce(F.when(F.lit(SPACES).contains(F.left(c, F.lit(1))), stripped(c) == "").otherwise(c.isNull()), F.lit(True))


def clean_text(c: Column, sentinel: str | None = None) -> Column:
    """Null for blanks and for the exact ``sentinel``; any other text is kept as it is, padding included."""
    blank = is_blank(c) if sentinel is None else is_blank(c) | (c == sentinel)
    return F.when(~blank, c)


def normal_id(c: Column) -> Column:
    """Stripped text of an id, null if nothing is left."""
    return F.nullif(stripped(c), F.lit(""))


def group_value(c: Column) -> Column:
    """The value to group by, with a stand-in for null."""
    return F.coalesce(c, F.lit("<MISSING>"))


def strict_boolean(c: Column) -> Column:
    """true for ``True``, false for ``False``, else null; no trimming, no other spellings."""
    return F.when(c == "True", True).when(c == "False", False)
