"""Exact duplicates and duplicate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.operators.keyed import attach_keyed


def first_of_equal(df: DataFrame, content: list[str], row: str) -> DataFrame:
    """One row per distinct content, with the smallest ``row`` and ``copies``.

    Contents are compared column by column, null equal to null, never by a hash alone. Repeats collapse before the shuffle.
    """
    return df.groupBy(*content).agg(F.min(row).alias(row), F.count(F.lit(1)).alias("copies"))


def first_rows(df: DataFrame, content: list[str], row: str) -> DataFrame:
    """Per distinct content the whole row with the smallest ``row``; other columns come from it."""
    rest = [c for c in df.columns if c not in content]
    best = F.min(F.struct(row, *[c for c in rest if c != row])).alias("__first")
    return df.groupBy(*content).agg(best).select(*content, *[F.col(f"__first.{c}").alias(c) for c in rest])


def duplicate_id_figures(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct_ids, repeated_ids, excess_rows. Null ids are left out; an empty table gives zeros."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return n.agg(zero(F.sum("n")).alias("rows"), F.count(F.lit(1)).alias("distinct_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"), zero(F.sum(F.col("n") - 1)).alias("excess_rows"))


def all_copies(df: DataFrame, key: list[str]) -> DataFrame:
    """Every row of a key that occurs more than once, with ``copies``; rows of hot keys are not shuffled."""
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    return attach_keyed(df, n, key, "copies", keep=F.col("copies") > 1)


def occurrence_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many ids occur how often."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences"))
    return n.groupBy("occurrences").agg(F.count(F.lit(1)).alias("ids"))


def variation(df: DataFrame, key: str, facts: dict[str, list[Column]]) -> DataFrame:
    """One row: per fact, the ids with more than one distinct value of it (a null counts as a value)."""
    named = {n: F.to_json(F.struct(*[c.cast("string").alias(f"f{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}) for n, cols in facts.items()}
    rows = df.where(F.col(key).isNotNull()).select(key, *[c.alias(n) for n, c in named.items()])
    # a group has more than one value exactly if its least and greatest differ; both combine before the shuffle
    many = rows.groupBy(key).agg(*[(F.min(n) < F.max(n)).alias(n) for n in facts])
    return many.agg(*[F.count_if(n).alias(n) for n in facts])
