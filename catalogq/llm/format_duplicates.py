"""Records that are identical but for formatting, collapsed and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.operators.keyed import attach_keyed
from catalogq.session import cut

# Code points that stand for the same letter or digit: Arabic and Persian letters, digits, full-width forms.
_SAME = {"ي": "ی", "ى": "ی", "ې": "ی", "ك": "ک", "ڪ": "ک", "ە": "ه", "ہ": "ه", "ھ": "ه"}
_SAME |= {chr(base + i): str(i) for base in (0x660, 0x6F0, 0xFF10) for i in range(10)}
_SAME |= {chr(base + i): chr(ord("a") + i) for base in (0xFF21, 0xFF41) for i in range(26)}
#: A word: a longest run of letters, digits, combining marks and zero-width non-joiners.
WORD = r"[\p{L}\p{Nd}\p{M}‌]+"


def canonical_form(fields: list[str]) -> Column:
    """The words of all fields, characters and case made one, sorted, one space apart: equal for equal multisets of words."""
    text = F.translate(F.lower(F.concat_ws("\n", *fields)), "".join(_SAME), "".join(_SAME.values()))
    return F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), " ")


def keyed_rows(df: DataFrame, fields: list[str], row: str) -> DataFrame:
    """``row``, ``digest`` (128 bits) and ``proof`` (64 bits of an unrelated hash and the length) per row.

    Rows with a null in any of the fields are left out; rows without any word are equal to each other.
    """
    whole = df.where(" AND ".join(f"`{f}` IS NOT NULL" for f in fields)).select(F.col(row).alias("row"), canonical_form(fields).alias("c"))
    return whole.select("row", F.unhex(F.md5("c")).alias("digest"), F.struct(F.xxhash64("c").alias("h"), F.length("c").alias("l")).alias("proof"))


def copy_groups(keyed: DataFrame) -> DataFrame:
    """``digest``, ``proof``, ``first_row``, ``copies`` per group, counted before the shuffle.

    The proof is part of the key: two forms that collide in the digest stay two groups.
    """
    return keyed.groupBy("digest", "proof").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("copies"))


def collisions(keyed: DataFrame) -> DataFrame:
    """Digests that stand for more than one canonical form; expected empty."""
    forms = copy_groups(keyed).groupBy("digest").agg(F.count(F.lit(1)).alias("forms"), F.sum("copies").alias("rows"))
    return forms.where("forms > 1").select(F.hex("digest").alias("digest"), "forms", "rows")


def format_duplicates(df: DataFrame, fields: list[str], row: str) -> DataFrame:
    """``first_row``, ``copy_row``: every row beyond the first of its group, with the group's smallest row.

    The text is canonicalised once; what is kept of a row, some 40 bytes, is written to the shared folder. Rows of the
    largest groups find their group by broadcast, so a group that owns a third of all rows is never gathered.
    Repeated values of ``row`` are rows of their own, one of which is the first. Empty input gives no rows.
    """
    keyed = cut(keyed_rows(df, fields, row))
    groups = cut(copy_groups(keyed).where("copies > 1"))  # counted once; read for the largest groups and for the others
    found = attach_keyed(keyed, groups, ["digest", "proof"], "copies")
    return found.where("row > first_row").select("first_row", F.col("row").alias("copy_row"))
