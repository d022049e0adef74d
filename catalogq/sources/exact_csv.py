"""CSV read token by token as it is: no type inference, no missing-value vocabulary, exact header, logical row numbers."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Largest field, in characters, unless told otherwise.
FIELD_LIMIT = 16 << 20


class CsvError(ValueError):
    """A file that breaks its declared form."""


def exact_rows(lines: Iterator[str], columns: list[str], limit: int = FIELD_LIMIT, name: str = "csv") -> Iterator[tuple]:
    """(row number, tokens...) of each record; the header is row 1. Raises CsvError where the form is broken."""
    csv.field_size_limit(limit)
    reader = csv.reader(lines, strict=True)
    number = 1
    try:
        header = next(reader, None)
        if header != columns:
            raise CsvError(f"{name}: header {header} where {columns} was declared")
        for number, tokens in enumerate((r for r in reader if r), 2):
            if len(tokens) != len(columns):
                raise CsvError(f"{name}: row {number} has {len(tokens)} fields, {len(columns)} were declared")
            yield (number, *tokens)
    except csv.Error as e:
        raise CsvError(f"{name}: after row {number}: {e}") from e


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.columns = [f.name for f in schema.fields if f.name != "source_row"]
        self.paths = [p for p in options["path"].split(",") if p]
        self.limit = int(options.get("fieldlimit", FIELD_LIMIT))
        self.rows = int(options["maxrows"]) if options.get("maxrows") else None
        self.encoding = options.get("encoding", "utf-8-sig")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding=self.encoding, newline="") as f:
            for row in exact_rows(f, self.columns, self.limit, partition.path):
                if self.rows is not None and row[0] > self.rows + 1:
                    return
                yield row


class ExactCsv(DataSource):
    """Format ``exact_csv``: one task per file, as quotes may hide line breaks anywhere in it.

    Options: path (several joined by commas), fieldLimit, maxRows (the first records only), encoding. The schema is
    ``source_row BIGINT`` and the header's columns as STRING, in order. A broken file fails the read.
    """

    @classmethod
    def name(cls) -> str:
        return "exact_csv"

    def schema(self) -> str:
        raise CsvError("exact_csv needs its columns declared as schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def read_exact_csv(spark: SparkSession, path: str, columns: list[str], field_limit: int = FIELD_LIMIT, max_rows: int | None = None) -> DataFrame:
    """Records of a file (several joined by commas) with ``source_row`` and the declared columns as text.

    Files beyond ``split_csv.PIECE`` bytes are read in pieces, a task each, unless only the first records are asked for.
    """
    from catalogq.sources import split_csv

    paths = [p for p in path.split(",") if p]
    if max_rows is None and any(os.path.getsize(p) > split_csv.PIECE for p in paths):
        pieces = split_csv.plan(spark, paths, split_csv.PIECE)
        if pieces:
            return split_csv.read_pieces(spark, pieces, columns, field_limit, "utf-8")
    spark.dataSource.register(ExactCsv)
    schema = T.StructType([T.StructField("source_row", T.LongType()), *(T.StructField(c, T.StringType()) for c in columns)])
    r = spark.read.format("exact_csv").schema(schema).option("fieldLimit", field_limit)
    if max_rows is not None:
        r = r.option("maxRows", max_rows)
    return r.load(path)


def read_split_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Files known to hold no line break inside quotes: split and read by the JVM in parallel, broken rows fail the read.

    Has no row numbers; tokens are text, unquoted nothing is the empty string. The way for very large deliveries.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, mode="FAILFAST", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    return df.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def text_rows(lines: Iterator[str], sep: str, columns: int, name: str = "csv") -> Iterator[tuple]:
    """(row number, tokens...) of each record behind the header; short records end in nulls, long ones are an error."""
    csv.field_size_limit(FIELD_LIMIT * 4)
    reader = csv.reader(lines, delimiter=sep)
    next(reader, None)
    for number, tokens in enumerate((r for r in reader if r), 2):
        if len(tokens) > columns:
            raise CsvError(f"{name}: row {number} has {len(tokens)} fields, {columns} were declared")
        yield (number, *tokens, *([None] * (columns - len(tokens))))


class _TextReader(_Reader):
    def __init__(self, schema: T.StructType, options: dict):
        super().__init__(schema, options)
        self.sep = options["sep"]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, encoding=self.encoding, newline="") as f:
            for row in text_rows(f, self.sep, len(self.columns), partition.path):
                if self.rows is not None and row[0] > self.rows + 1:
                    return
                yield row


class TextCsv(ExactCsv):
    """Format ``text_csv``: as ``exact_csv``, for files whose header and delimiter were sniffed; further option: sep."""

    @classmethod
    def name(cls) -> str:
        return "text_csv"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TextReader(schema, dict(self.options))


def read_text(spark: SparkSession, path: str, columns: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """A delimited file of unknown columns as text with ``source_row``, its encoding and delimiter sniffed; for profiling.

    Usual spellings of a missing value become null. ``columns`` are given alone; with ``max_rows`` the first records are read
    and no more, which also makes a bounded sample.
    """
    from catalogq.sources.sniff import sniff

    encoding, sep = sniff(path)
    with open(path, encoding=encoding, newline="") as f:
        names = next(csv.reader(f, delimiter=sep), [])
    spark.dataSource.register(TextCsv)
    schema = T.StructType([T.StructField("source_row", T.LongType()), *(T.StructField(c, T.StringType()) for c in names)])
    r = spark.read.format("text_csv").schema(schema).option("sep", sep).option("encoding", encoding)
    df = (r if max_rows is None else r.option("maxRows", max_rows)).load(path)
    return df.select("source_row", *[F.when(~F.col(c).isin(*MISSING), F.col(c)).alias(c) for c in columns or names])


# Texts that stand for a missing value in profiles.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def records(text: str) -> list[list[str]]:
    """All records of a text; for small inputs on the driver."""
    return list(csv.reader(io.StringIO(text, newline=""), strict=True))
