"""Exact quantiles from counts per value, and the flags that follow from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``groups``, ``value``, ``n``: non-null values with their counts; combined before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


#: Slices per doubling of the value; a slice's distinct values lie within 1/64 of their size of each other.
SLICES = 64


def value_slice(value: Column) -> Column:
    """A slice of the value range, rising with the value; the same for all rows and runs, so nothing has to be sampled."""
    x = value.cast("double")
    size = F.floor(F.log2(F.abs(x) + 1) * SLICES)
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).otherwise(F.signum(x).cast("bigint") * size)


def at_ranks(counts: DataFrame, groups: list[str], asked: dict[str, Column]) -> DataFrame:
    """``groups``, ``name``, ``rank``, ``n``, ``value``: the values of the asked ranks (from 1, in terms of ``total``) per group.

    Counts are first added up per slice of the value range; only the slices that hold an asked rank are sorted, each for itself. So
    a group that owns a third of all values is spread over its slices, of which there are some thousand. Null group values form groups.
    """
    sliced = counts.withColumn("__slice", value_slice(F.col("value")))
    per = sliced.groupBy(*groups, "__slice").agg(F.sum("n").alias("__in"))
    by = Window.partitionBy(*groups)
    upto = F.sum("__in").over(by.orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0))
    placed = per.select("*", (upto - F.col("__in")).alias("__before"), F.sum("__in").over(by).alias("total"))
    ranks = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.cast("bigint").alias("rank")) for n, r in asked.items()])).alias("a")
    hit = placed.select("*", ranks).where("a.rank > __before AND a.rank <= __before + __in")
    keys = [*groups, "__slice"]
    hit = hit.select(*[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], "a.name", "a.rank", "__before", "total")
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(keys)])
    within = Window.partitionBy(*[f"__h{i}" for i in range(len(keys))], "name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = sliced.join(hit, on).withColumn("__upto", F.col("__before") + F.sum("n").over(within))
    return found.where("__upto >= rank AND __upto - n < rank").select(*groups, "name", "rank", F.col("total").alias("n"), "value")


def nearest_rank(df: DataFrame, groups: list[str], value: str, per_mille: list[int]) -> DataFrame:
    """``groups``, ``per_mille``, ``n``, ``rank``, ``threshold``: the value of rank ceil(p * n / 1000), in integer arithmetic."""
    asked = {str(p): F.greatest(F.lit(1), F.expr(f"({p} * total + 999) div 1000")) for p in per_mille}
    r = at_ranks(value_counts(df, groups, value), groups, asked)
    return r.select(*groups, F.col("name").cast("int").alias("per_mille"), "n", "rank", F.col("value").alias("threshold"))


def above_threshold(df: DataFrame, value: str, per_mille: int, flag: str) -> DataFrame:
    """``df`` with ``flag``: value strictly above the global nearest-rank quantile; false for null. The threshold is one row."""
    t = nearest_rank(df, [], value, [per_mille]).first()  # one row, or none
    return df.withColumn(flag, F.lit(False) if t is None else F.coalesce(F.col(value) > F.lit(t.threshold), F.lit(False)))


def interpolated_quantiles(df: DataFrame, groups: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Per group the interpolated quantiles, from counts per value: no group's values are collected."""
    at = {name: (F.col("total") - 1).cast("double") * F.lit(p) for name, p in ps.items()}
    asked = {}
    for name, c in at.items():
        asked |= {f"{name}/low": F.floor(c) + 1, f"{name}/high": F.least(F.floor(c) + 2, F.col("total"))}
    r = at_ranks(value_counts(df, groups, value), groups, asked).withColumnRenamed("n", "total")
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value").cast("double")))
    aggs = [(of(f"{n}/low") + (of(f"{n}/high") - of(f"{n}/low")) * F.max(c - F.floor(c))).alias(n) for n, c in at.items()]
    return r.groupBy(*groups).agg(F.max("total").alias("n"), *aggs)
