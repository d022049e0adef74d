"""Cutting large CSV files into pieces that tasks read on their own, with the result of reading each file in one go.

A piece begins behind a line feed. There the reader is either at the start of a record or inside a quoted field, so each
piece is scanned once for both cases: where its first record starts, how many records start in it, and in which case its end
leaves the next piece. One row a piece comes to the driver, which follows the cases from the start of the file; then every piece
is read, from its first record on, in the case that holds. Nothing is guessed: quotes inside unquoted fields, line breaks in
quoted ones and blank lines count as the exact reader counts them. A file with carriage returns alone as line ends is not cut.
"""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from catalogq.sources.exact_csv import CsvError

#: Bytes of a piece; files of no more than that are read in one go.
PIECE = 256 << 20

_INSIDE = rb'[^"]*+(?:""[^"]*+)*+'
_FIELD = rb'(?:"' + _INSIDE + rb'"|(?!"))[^,\r\n]*+'
_RECORD = re.compile(rb"(?:" + _FIELD + rb")(?:," + _FIELD + rb")*+(\r\n|\n|\r|\Z)")
_CLOSED = re.compile(_INSIDE + rb'"[^,\r\n]*+(?:,' + _FIELD + rb")*+(\r\n|\n|\r|\Z)")


@dataclass
class Scan:
    """What a piece holds if it begins in one of the two cases: records that start in it, the first of them, the case behind it."""

    records: int
    first: int | None
    quoted: bool
    lone_return: bool = False


def scan(piece: bytes, quoted: bool) -> Scan:
    """Scans a piece that begins behind a line feed; ``first`` counts from its beginning."""
    at, found, lone = 0, Scan(0, None, False), False
    if quoted:
        m = _CLOSED.match(piece)
        if m is None:
            return Scan(0, None, True)
        at, lone = m.end(), m.group(1) == b"\r"
    while at < len(piece):
        m = _RECORD.match(piece, at)
        if m is None:
            found.quoted = True  # a quoted field that the piece does not close
            found.records += 1
            found.first = at if found.first is None else found.first
            break
        lone = lone or m.group(1) == b"\r"
        if m.end() > m.start() + len(m.group(1)):  # a blank line is no record
            found.records += 1
            found.first = at if found.first is None else found.first
        at = m.end()
    found.lone_return = lone
    return found


def _piece(path: str, no: int, size: int) -> tuple[int, int]:
    """Beginning and end of a piece: the nominal places, each moved behind the next line feed."""
    total = os.path.getsize(path)

    def moved(f, at: int) -> int:
        if at == 0 or at >= total:
            return min(at, total)
        f.seek(at - 1)
        f.readline()
        return f.tell()

    with open(path, "rb") as f:
        return moved(f, no * size), moved(f, (no + 1) * size)


def plan(spark: SparkSession, paths: list[str], size: int) -> list[tuple] | None:
    """(path, start, end, number of the first record, whether the first piece) per piece that has records; None if a file can not be cut."""
    asked = [(p, no) for p in paths for no in range(-(-os.path.getsize(p) // size) or 1)]

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, no in zip(pdf["path"], pdf["no"]):
                start, end = _piece(path, no, size)
                with open(path, "rb") as f:
                    f.seek(start)
                    data = f.read(end - start)
                if no == 0 and data.startswith(b"\xef\xbb\xbf"):
                    start, data = start + 3, data[3:]
                a, b = scan(data, False), scan(data, True)
                yield pd.DataFrame([(path, no, start, end, a.records, a.first, a.quoted, b.records, b.first, b.quoted, a.lone_return or b.lone_return)], columns=[f.name for f in schema])

    schema = T._parse_datatype_string("path string, no bigint, start bigint, end bigint, n0 bigint, f0 bigint, q0 boolean, n1 bigint, f1 bigint, q1 boolean, lone boolean")
    df = spark.createDataFrame(asked, "path string, no bigint").repartition(len(asked), "path", "no")
    found = sorted(df.mapInPandas(scanned, schema).collect(), key=lambda r: (paths.index(r.path), r.no))
    out: list[tuple] = []
    last, quoted, number = None, False, 0
    for r in found:
        if r.path != last:
            last, quoted, number = r.path, False, 0
        if r.lone:
            return None
        n, first, after = (r.n1, r.f1, r.q1) if quoted else (r.n0, r.f0, r.q0)
        if n:
            out.append((r.path, r.start + int(first), r.end, number + 1))
        number, quoted = number + n, after
    return out


def read_pieces(spark: SparkSession, pieces: list[tuple], columns: list[str], limit: int, encoding: str) -> DataFrame:
    """The records of planned pieces, a task each: ``source_row`` and the columns; a broken file fails the read."""
    schema = T.StructType([T.StructField("source_row", T.LongType()), *(T.StructField(c, T.StringType()) for c in columns)])

    def rows(path: str, start: int, end: int, number: int) -> Iterator[tuple]:
        csv.field_size_limit(limit)
        at = start

        def lines(f) -> Iterator[str]:
            nonlocal at
            for line in f:
                at += len(line)
                yield line.decode(encoding)

        with open(path, "rb") as f:
            f.seek(start)
            reader = csv.reader(lines(f), strict=True)
            try:
                while at < end and (tokens := next(reader, None)) is not None:
                    if not tokens:
                        continue
                    if number == 1 and tokens != columns:
                        raise CsvError(f"{path}: header {tokens} where {columns} was declared")
                    if len(tokens) != len(columns):
                        raise CsvError(f"{path}: row {number} has {len(tokens)} fields, {len(columns)} were declared")
                    if number > 1:
                        yield (number, *tokens)
                    number += 1
            except csv.Error as e:
                raise CsvError(f"{path}: after row {number - 1}: {e}") from e

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for piece in pdf.itertuples(index=False):
                batch: list[tuple] = []
                for row in rows(piece.path, piece.start, piece.end, piece.number):
                    batch.append(row)
                    if len(batch) == 4096:
                        yield pd.DataFrame(batch, columns=schema.names)
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=schema.names)

    df = spark.createDataFrame(pieces, "path string, start bigint, end bigint, number bigint").repartition(max(1, len(pieces)), "path", "start")
    return df.mapInPandas(read, schema)
