"""Profiles of tables whose columns are not known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogq.functions.num import as_number
from catalogq.functions.text import is_blank
from catalogq.operators.quantile import interpolated_quantiles

#: Distinct values of a column up to which its distribution is told.
DISTRIBUTION = 100


def unpivoted(df: DataFrame, columns: list[str], row: str | None = None) -> DataFrame:
    """``column``, ``value`` (text, blank is null) and, if given, ``row``."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(~is_blank(F.col(c).cast("string")), F.col(c).cast("string")).alias("value")) for c in columns])).alias("c")
    return df.select(*([F.col(row).alias("row")] if row else []), cells).select(*(["row"] if row else []), "c.*")


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: missing, present, numeric and not numeric values, least, greatest and mean number, in one pass."""
    u = unpivoted(df, columns)
    x = as_number(F.col("value"))
    return u.groupBy("column").agg(
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count("value").alias("present"),
        F.count(x).alias("numeric"),
        F.count_if(F.col("value").isNotNull() & x.isNull()).alias("not_numeric"),
        F.min(x).alias("least"),
        F.max(x).alias("greatest"),
        F.sum(x).alias("total"),
    )


def top_values(df: DataFrame, columns: list[str], row: str, k: int) -> DataFrame:
    """The ``k`` most frequent values per column; ties by first appearance.

    Counts combine before the shuffle. A column's distinct values are first cut to k per share, as many shares as there are
    shuffle partitions, then to k.
    """
    n = unpivoted(df, columns, row).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first_row"))
    order = [F.col("n").desc(), F.col("first_row")]
    share = n.withColumn("share", F.pmod(F.xxhash64("value"), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    some = share.withColumn("place", F.row_number().over(Window.partitionBy("column", "share").orderBy(*order))).where(F.col("place") <= k)
    return some.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(F.col("place") <= k).select("column", "place", "value", "n")


def few_valued(df: DataFrame, columns: list[str], limit: int) -> list[str]:
    """The columns with at most ``limit`` distinct values."""
    n = unpivoted(df, columns).where("value IS NOT NULL").groupBy("column", F.trim("value").alias("value")).agg(F.lit(1)).groupBy("column").agg(F.count(F.lit(1)).alias("d"))
    found = {r["column"] for r in n.where(F.col("d") <= limit).collect()}  # one row per column
    return [c for c in columns if c in found]


def distribution(df: DataFrame, columns: list[str], limit: int = DISTRIBUTION) -> DataFrame:
    """All values with their counts, of columns with at most ``limit`` distinct ones."""
    n = unpivoted(df, columns).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    few = n.groupBy("column").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= limit).select("column")
    return n.join(F.broadcast(few), "column", "left_semi")


def outside(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: per column, the numbers outside its range."""
    return df.agg(*[F.count_if((as_number(F.col(c).cast("string")) < low) | (as_number(F.col(c).cast("string")) > high)).alias(c) for c, (low, high) in ranges.items()])


def number_classes(df: DataFrame, column: str) -> DataFrame:
    """One row: missing, zero, negative, positive and not numeric values of a column."""
    c = F.col(column).cast("string")
    x = as_number(c)
    return df.agg(
        F.count_if(is_blank(c)).alias("missing"),
        F.count_if(x == 0).alias("zero"),
        F.count_if(x < 0).alias("negative"),
        F.count_if(x > 0).alias("positive"),
        F.count_if(~is_blank(c) & x.isNull()).alias("not_numeric"),
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts for pairs of values with margins; ``a_all`` and ``b_all`` tell a margin from a null value."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"), (F.grouping(a) == 1).alias("a_all"), (F.grouping(b) == 1).alias("b_all"))


def described(df: DataFrame, value: str, ps: dict[str, float]) -> DataFrame:
    """One row: count, mean, standard deviation, least, greatest, interpolated percentiles of the numbers."""
    x = F.col(value).cast("double")
    plain = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("deviation"), F.min(x).alias("least"), F.max(x).alias("greatest"))
    q = interpolated_quantiles(df, [], value, ps).drop("n").agg(*[F.max(p).alias(p) for p in ps])
    return plain.withColumn("__one", F.lit(1)).join(q.withColumn("__one", F.lit(1)), "__one").drop("__one")


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """``bin`` 1..bins of equal width over [low, high], the last closed; values outside are left out."""
    b = F.least(F.floor((value - low) / F.lit((high - low) / bins)).cast("bigint") + 1, F.lit(bins).cast("bigint"))
    return df.where(value.between(low, high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def largest(df: DataFrame, column: str, k: int, ties: list[str]) -> DataFrame:
    """The ``k`` rows with the greatest values; ties by other columns."""
    return df.where(F.col(column).isNotNull()).orderBy(F.col(column).desc(), *ties).limit(k)


def coverage(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row: rows, rows whose key is known, distinct keys, known distinct keys; by counts per key."""
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = keys.select(F.col(key).alias("__k")).dropna().distinct()
    j = n.join(known, F.col(key) == F.col("__k"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return j.agg(zero(F.sum("n")).alias("rows"), zero(F.sum(F.when(F.col("__k").isNotNull(), F.col("n")))).alias("known_rows"), F.count(F.lit(1)).alias("keys"), F.count("__k").alias("known_keys"))


def first_missing(rows: DataFrame, keys: DataFrame, key: str, row: str, k: int) -> DataFrame:
    """The first ``k`` keys, in order of appearance, that ``keys`` lacks."""
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias("first_row"), F.count(F.lit(1)).alias("n"))
    return n.join(keys.select(key), key, "left_anti").orderBy("first_row").limit(k)


def stratified_sample(df: DataFrame, strata: list[str], row: str, k: int) -> DataFrame:
    """``k`` rows per stratum by the order of a hash of ``row``: the same rows on every run; null is a stratum.

    Strata are first cut to k per share of a stratum, so that a stratum of a third of all rows is never gathered.
    """
    order = [F.md5(F.col(row).cast("string")), F.col(row)]
    shares = df.withColumn("__share", F.pmod(F.xxhash64(row), F.lit(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    some = shares.withColumn("__place", F.row_number().over(Window.partitionBy(*strata, "__share").orderBy(*order))).where(F.col("__place") <= k)
    return some.withColumn("__place", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("__place") <= k).drop("__place", "__share")


def lexical_classes(df: DataFrame, column: str) -> DataFrame:
    """``form``, ``n``: values by how they are written: blank, integer, decimal, signed, letters, other."""
    c = F.col(column).cast("string")
    form = (
        F.when(is_blank(c), "blank")
        .when(c.rlike("^[0-9]+$"), "integer")
        .when(c.rlike(r"^[0-9]+\.[0-9]+$"), "decimal")
        .when(c.rlike(r"^[+-][0-9.]+$"), "signed")
        .when(c.rlike(r"^\p{L}+$"), "letters")
        .otherwise("other")
    )
    return df.groupBy(form.alias("form")).agg(F.count(F.lit(1)).alias("n"))
