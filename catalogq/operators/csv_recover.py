"""Loading delimited text that partly fails to parse.

Grammar (quote Q, separator S)::

    text    := record (newline record)*
    record  := field (S field)*
    field   := quoted | bare
    quoted  := Q (any character but Q | Q Q)* Q
    bare    := (any character but Q, S, newline)*

The parser descends this grammar. Where a record breaks it, the error is located (kind, offset, line, field) and
parsing resumes at the next anchor: the start of a line from which a whole record of the declared
number of fields parses and whose first field is an id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
_BARE = re.compile(r'[^,"\r\n]*')
_NEWLINE = re.compile(r"\r\n|\n|\r")
_ID = re.compile(r"\s*[0-9]{1,19}\s*\Z")


@dataclass
class Record:
    """A parsed record, or where and why it is none. ``kind`` is null, "quoting" or "columns"."""

    start: int
    end: int
    fields: list[str]
    kind: str | None = None
    error_at: int | None = None
    error_field: int | None = None


def _quoted(text: str, at: int) -> tuple[str, int, int | None]:
    """A quoted field from its opening quote: value, position after it, offset of an error."""
    inside = _QUOTED.match(text, at + 1)
    end = inside.end()
    if end >= len(text):
        return inside.group(), end, at  # never closed
    return inside.group().replace('""', '"'), end + 1, None


def _field(text: str, at: int) -> tuple[str, int, int | None]:
    if at < len(text) and text[at] == '"':
        value, end, error = _quoted(text, at)
    else:
        bare = _BARE.match(text, at)
        value, end, error = bare.group(), bare.end(), None
    if error is None and end < len(text) and text[end] not in ",\r\n":
        error = end  # a quote inside an unquoted field, or text after a closing quote
    return value, end, error


def _record(text: str, start: int, columns: int) -> Record:
    fields, at = [], start
    while True:
        value, at, error = _field(text, at)
        if error is not None:
            return Record(start, at, fields, "quoting", error, len(fields))
        fields.append(value)
        if at < len(text) and text[at] == ",":
            at += 1
            continue
        break
    if len(fields) != columns:
        return Record(start, at, fields, "columns", at, len(fields))
    return Record(start, at, fields)


def parse_record(text: str, start: int, columns: int, whole: bool = False) -> Record:
    """The record that begins at ``start``. With ``whole`` the text holds one record only."""
    first = _record(text, start, columns)
    if not whole or first.kind == "quoting" or not text[first.end :].strip("\r\n"):
        return first
    # a line break outside quotes ended the record; what follows belongs to none, but may break the quoting
    at = _NEWLINE.match(text, first.end).end()
    while at < len(text):
        r = _record(text, at, columns)
        if r.kind == "quoting":
            return Record(start, r.end, first.fields, "quoting", r.error_at, len(first.fields))
        m = _NEWLINE.match(text, r.end)
        at = m.end() if m else len(text)
    return Record(start, first.end, first.fields, "columns", first.end, len(first.fields))


def _anchor(text: str, after: int, columns: int, before: int | None = None) -> int | None:
    """The next validated record start behind ``after``, and not behind ``before``."""
    for m in _NEWLINE.finditer(text, after, len(text) if before is None else before):
        r = parse_record(text, m.end(), columns)
        if r.kind is None and _ID.match(r.fields[0]):
            return m.end()
    return None


def parse_text(text: str, columns: int) -> Iterator[Record]:
    """All records of a text, broken ones with their error; resumes at anchors.

    A record of a wrong number of fields that reaches over line breaks may be two stray quotes that met, with
    records between them: parsing then resumes at the first anchor within it.
    """
    at = 0
    while at < len(text):
        r = parse_record(text, at, columns)
        if r.kind == "quoting":
            again = _anchor(text, at, columns)
            r.end = len(text) if again is None else again
            yield r
            at = r.end
            continue
        if r.kind == "columns" and _NEWLINE.search(text, at, r.end) and (again := _anchor(text, at, columns, r.end)) is not None:
            r.end = again
            yield r
            at = again
            continue
        if r.fields != [""]:  # a blank line is no record
            yield r
        m = _NEWLINE.match(text, r.end)
        at = m.end() if m else len(text)


RECORD = T.StructType(
    [
        T.StructField("record_no", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("kind", T.StringType()),
        T.StructField("error_offset", T.LongType()),
        T.StructField("error_line", T.LongType()),
        T.StructField("error_field", T.LongType()),
        T.StructField("broken_text", T.StringType()),
    ]
)


def parse_records(df: DataFrame, text: str, columns: Column, keep: list[str], one_record: bool = True) -> DataFrame:
    """``keep`` columns plus the parse of ``text``: fields of each record, or the located error.

    With ``one_record`` each row holds one record and gives one output row; else a row's text is parsed
    with recovery and gives one row per record found. ``columns`` is the number of fields declared for a row.
    A null text is a record of no fields (kind "columns"); an empty text is one empty field. Rows are independent, so
    repeats and order do not matter; extra columns are ignored. A kept column whose name is one of the output's
    (record_no, offset, fields, kind, error_*, broken_text) comes out as ``<name>_kept``.
    """
    names = {c: f"{c}_kept" if c in RECORD.names else c for c in keep}
    schema = T.StructType([*(T.StructField(names[c], df.schema[c].dataType) for c in keep), *RECORD.fields])

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, rows = [], []
            for i, (t, n) in enumerate(zip(pdf["__text"], pdf["__columns"])):
                if t is None:
                    found = [Record(0, 0, [], "columns", 0, 0)]
                elif one_record:
                    found = [parse_record(t, 0, n, whole=True)]
                else:
                    found = parse_text(t, n)
                for no, r in enumerate(found):
                    at.append(i)
                    bad = r.kind is not None
                    rows.append((no, r.start, None if bad else r.fields, r.kind, r.error_at, t.count("\n", 0, r.error_at) + 1 if bad and t is not None else None, r.error_field, (t or "")[r.start : r.end] if bad and not one_record else None))
            out = pd.DataFrame(rows, columns=RECORD.names)
            for c in ("error_offset", "error_line", "error_field"):
                out[c] = out[c].astype("Int64")
            left = pdf[list(names.values())].iloc[at].reset_index(drop=True)
            yield pd.concat([left, out], axis=1)

    return df.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(text).alias("__text"), columns.cast("int").alias("__columns")).mapInPandas(parsed, schema)


def trimmed(c: Column) -> Column:
    """Without the spaces around it."""
    return F.trim(c)


def valid_rate(c: Column) -> Column:
    """Empty, or 0 to 5 with one digit before and at most two after an optional point."""
    t = trimmed(c)
    return (t == "") | (t.rlike(r"^[0-4](\.[0-9]{0,2})?$")) | t.rlike(r"^5(\.0{0,2})?$")


def valid_count(c: Column, may_be_empty: bool) -> Column:
    """ASCII digits up to 2^63-1."""
    t = trimmed(c)
    digits = t.rlike("^[0-9]+$") & _fits(t)
    return ((t == "") | digits) if may_be_empty else digits


def _fits(t: Column) -> Column:
    """Digits without leading zeros compare as numbers by length, then as text."""
    bare = F.regexp_replace(t, "^0+(?=.)", "")
    top = F.lit("9223372036854775807")
    return (F.length(bare) < 19) | ((F.length(bare) == 19) & (bare <= top))
