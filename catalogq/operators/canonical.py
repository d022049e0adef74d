"""Deterministic canonical rows and the conflicts they won."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.operators.keyed import attach_keyed
from catalogq.session import cut


def completeness(columns: list[str]) -> Column:
    """Number of non-null columns."""
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("bigint") for c in columns])


def descending(c: Column) -> Column:
    """For an ascending rank over bigint: the highest first, null last."""
    return F.coalesce(-c.cast("bigint"), F.lit(9223372036854775807))


def variants(df: DataFrame, key: str, content: list[str], rank: list[Column]) -> DataFrame:
    """Per key and distinct content its best row by ``rank`` (ascending, total); all columns kept.

    Contents compare column by column with null equal to null. Equal contents collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, *content)]
    best = F.min(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], *rest)).alias("__best")
    got = df.groupBy(key, *content).agg(best)
    return got.select(key, *content, *[F.col(f"__best.{c}").alias(c) for c in rest], *[F.col(f"__best.r{i}").alias(f"__r{i}") for i in range(len(rank))])


def canonical(df: DataFrame, key: str, content: list[str], rank: list[Column], variant_rank: list[Column] | None = None) -> DataFrame:
    """The canonical row per key: the first by ``rank`` among its distinct contents, with ``variants``, their number.

    ``variant_rank`` picks the row that stands for equal contents (default: ``rank``). Null keys form one group.
    """
    v = variants(df, key, content, variant_rank or rank).drop(*[f"__r{i}" for i in range(len(variant_rank or rank))])
    cols = [c for c in df.columns if c != key]
    best = F.min(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], *cols)).alias("__best")
    return v.groupBy(key).agg(F.count(F.lit(1)).alias("variants"), best).select(key, "variants", *[F.col(f"__best.{c}").alias(c) for c in cols])


def conflicts(df: DataFrame, key: str, row: str, content: list[str], rank: list[Column], variant_rank: list[Column] | None = None) -> DataFrame:
    """All variants of keys that have more than one, with ``canonical_row`` and ``selected``.

    Variants of hot keys find their canonical row by broadcast. The variants are written to the shared folder once, as
    several steps read them.
    """
    v = cut(variants(df, key, content, variant_rank or rank).drop(*[f"__r{i}" for i in range(len(variant_rank or rank))]))
    best = F.min(F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(row).alias("row")))["row"]
    won = v.groupBy(key).agg(F.count(F.lit(1)).alias("variants"), best.alias("canonical_row"))
    return attach_keyed(v, won, [key], "variants", keep=F.col("variants") > 1).withColumn("selected", F.col(row) == F.col("canonical_row"))
