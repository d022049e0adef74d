"""References to records that do not exist, for composite keys with partial nulls."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.operators.keyed import attach_keyed
from catalogq.session import cut

MATCHES = ("simple", "partial", "full")


def reference_status(refs: DataFrame, targets: DataFrame, pairs: list[tuple[str, str]], match: str = "simple") -> DataFrame:
    """Per distinct reference: its columns, ``ref_rows`` (rows that hold it) and ``is_orphan``.

    References are grouped by their null mask, and each mask is anti-joined on its non-null columns.
    ``match`` declares what a reference with nulls means, as in SQL's referential constraints:
    simple - any null: no reference, never an orphan; partial - the non-null columns must occur together in some
    target row; full - all null is no reference, partly null is always an orphan.
    Repeated rows are counted, not multiplied; targets may repeat and may hold nulls, which match nothing.
    Without targets every reference with an effective value is an orphan; without references the result is empty.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    cols = [r for r, _ in pairs]
    # counted before the shuffle; written once, as filters by mask would each read all references again
    keys = cut(refs.groupBy(*cols).agg(F.count(F.lit(1)).alias("ref_rows")))
    parts = []
    for mask in product((True, False), repeat=len(pairs)):
        there = [p for p, m in zip(pairs, mask) if m]
        of_mask = keys.where(reduce(lambda a, b: a & b, [F.col(r).isNotNull() if m else F.col(r).isNull() for (r, _), m in zip(pairs, mask)]))
        if not there or (match == "simple" and len(there) < len(pairs)):
            parts.append(of_mask.withColumn("is_orphan", F.lit(False)))
        elif match == "full" and len(there) < len(pairs):
            parts.append(of_mask.withColumn("is_orphan", F.lit(True)))
        else:
            known = targets.select(*[F.col(t).alias(f"__t{i}") for i, (_, t) in enumerate(there)]).dropna().distinct().withColumn("__known", F.lit(True))
            on: Column = reduce(lambda a, b: a & b, [F.col(r) == F.col(f"__t{i}") for i, (r, _) in enumerate(there)])
            parts.append(of_mask.join(known, on, "left").select(*cols, "ref_rows", F.col("__known").isNull().alias("is_orphan")))
    return reduce(DataFrame.unionByName, parts)


def orphan_rows(refs: DataFrame, targets: DataFrame, pairs: list[tuple[str, str]], match: str = "simple") -> DataFrame:
    """The rows of ``refs`` whose reference is an orphan under ``match``, with all their columns.

    The anti-join runs over distinct references; rows of the most frequent references are then
    judged by broadcast and never shuffled, whether they are orphans or not.
    """
    # names of its own, as the rows may have columns of any name
    status = cut(reference_status(refs, targets, pairs, match)).withColumnsRenamed({"ref_rows": "__ref_rows", "is_orphan": "__is_orphan"})
    found = attach_keyed(refs, status, [r for r, _ in pairs], "__ref_rows", keep=F.col("__is_orphan"))
    return found.select(refs.columns)


def orphan_counts(refs: DataFrame, targets: DataFrame, pairs: list[tuple[str, str]], table_name: str, period: Column | None = None, match: str = "simple") -> DataFrame:
    """Orphan rows per table and period: ``table_name``, ``period`` (null without one), ``orphans``.

    Counts are first taken per reference and period, so a hot reference costs the join one row per period.
    """
    cols = [r for r, _ in pairs]
    per = refs.select(*cols, (F.lit(None).cast("string") if period is None else period.cast("string")).alias("period"))
    counted = per.groupBy(*cols, "period").agg(F.count(F.lit(1)).alias("n"))
    bad = reference_status(refs, targets, pairs, match).where("is_orphan").select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(cols)])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(cols)])
    return counted.join(bad, on, "left_semi").groupBy("period").agg(F.sum("n").alias("orphans")).select(F.lit(table_name).alias("table_name"), "period", "orphans")
