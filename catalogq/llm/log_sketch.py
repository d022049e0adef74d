"""Percentiles of very large numeric columns with bounded relative error, by mergeable logarithmic bucket counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to a bucket's logarithm index, so that buckets of positive values are positive and zero has bucket 0.
#: Doubles reach down to 5e-324, whose index is above -OFFSET for every relative error of 0.001 or more.
OFFSET = 1 << 20
#: Buckets of infinite values.
INFINITE = 1 << 40
#: Decimals at which the logarithm is rounded before it is cut, so that engines agree at bucket edges.
#: It moves an edge by a relative 1e-9 * ln(gamma) at most, far below the stated error.
EDGE_DECIMALS = 9


def gamma(error: float) -> float:
    """Ratio of neighbouring bucket edges for a relative error."""
    if not 0.001 <= error < 1:
        raise ValueError("error must be in [0.001, 1)")
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float) -> Column:
    """Signed bucket of a number: ordered like the value, 0 for zero, null for null and NaN."""
    x = value.cast("double")
    size = F.ceil(F.round(F.log(F.abs(x)) / F.lit(math.log(gamma(error))), EDGE_DECIMALS)).cast("bigint") + F.lit(OFFSET)
    return (
        F.when(F.isnan(x), F.lit(None).cast("bigint"))
        .when(x == 0, F.lit(0).cast("bigint"))
        .when(F.abs(x) == float("inf"), F.signum(x).cast("bigint") * F.lit(INFINITE))
        .otherwise(F.signum(x).cast("bigint") * size)
    )


def bucket_value(b: Column, error: float) -> Column:
    """The value given for a bucket; within the relative error of every value in it."""
    g = gamma(error)
    size = F.lit(2 / (g + 1)) * F.pow(F.lit(g), (F.abs(b) - F.lit(OFFSET)).cast("double"))
    return F.when(b == 0, 0.0).when(F.abs(b) == INFINITE, F.signum(b) * F.lit(float("inf"))).otherwise(F.signum(b) * size)


def bucket_counts(df: DataFrame, groups: list[str], value: str, error: float) -> DataFrame:
    """``groups``, ``bucket``, ``n``: the sketch of ``value`` per group; at most some thousand buckets a group.

    Rows with a null or NaN value are left out. Counting happens before the shuffle, so a group that owns a third of all
    rows sends its buckets once per task. An empty table gives an empty sketch.
    """
    b = df.select(*groups, bucket(F.col(value), error).alias("bucket")).where(F.col("bucket").isNotNull())
    return b.groupBy(*groups, "bucket").agg(F.count(F.lit(1)).alias("n"))


def combined(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of slices added up to the sketch of ``groups``; exact, whatever the slices."""
    return counts.groupBy(*groups, "bucket").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: list[str], at: list[float], error: float) -> DataFrame:
    """``groups``, ``percentile``, ``n``, ``estimate`` per group and asked percentile.

    The exact answer is the value of rank ceil(percentile * n), at least 1, among the ascending values; ``estimate``
    is within the relative error of it (for a zero it is exact). Null group values form groups.
    """
    by = Window.partitionBy(*groups)  # of bucket counts, not of rows
    upto = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(*groups, "bucket", F.col("n").alias("__n"), F.sum("n").over(upto).alias("__upto"), F.sum("n").over(by).alias("n"))
    asked = ranked.withColumn("percentile", F.explode(F.array(*[F.lit(float(p)) for p in at])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("n")))
    hit = asked.where((F.col("__upto") >= rank) & (F.col("__upto") - F.col("__n") < rank))
    return hit.select(*groups, "percentile", "n", bucket_value(F.col("bucket"), error).alias("estimate"))
