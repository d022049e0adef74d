"""Attaching per-key results to rows without sending a hot key's rows to one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that travel by broadcast, per shuffle partition. A bound on rows sent, not on keys handled: the others take the
#: shuffled way. With 2 a partition, a key outside them owns less than half of a partition's even share of the rows.
HOT_KEYS_A_PARTITION = 2


def _same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def attach_keyed(
    rows: DataFrame,
    keyed: DataFrame,
    keys: list[str],
    weight: str,
    keep: Column | None = None,
    hot_keys: int | None = None,
) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, one row per key, where a key may own a third of all rows.

    Keys that own at least 1/hot_keys of all rows by ``weight`` (rows per key; default: HOT_KEYS_A_PARTITION per shuffle
    partition) are broadcast, so their rows stay where they are; there can be no more than ``hot_keys`` of them. All other
    rows are shuffled by key, and none of those keys owns half of what a shuffle partition holds on average.
    ``keep`` filters ``keyed`` after the hot keys were chosen, so that rows of a hot key that is filtered
    out never reach the shuffle. Keys compare null-safely: null equals null. ``keyed`` must have the columns
    ``keys`` and ``weight``; its other columns are added to the rows and win over no clash: a clashing name raises.
    An empty side gives an empty result.
    """
    hot_keys = hot_keys or HOT_KEYS_A_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    extra = [c for c in keyed.columns if c not in keys]
    if clash := set(extra) & set(rows.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    pairs = [(k, f"__key_{i}") for i, k in enumerate(keys)]
    named = keyed.select(*[F.col(k).alias(n) for k, n in pairs], *extra)
    names = [n for _, n in pairs]
    total = keyed.agg(F.sum(F.col(weight).cast("double"))).scalar()
    hot = named.where(F.col(weight).cast("double") * hot_keys >= total)
    hot_names = hot.select(names)
    cold = named.join(F.broadcast(hot_names.toDF(*[f"{n}_h" for n in names])), _by(names), "left_anti")
    if keep is not None:
        hot, cold = hot.where(keep), cold.where(keep)
    near = rows.join(F.broadcast(hot), _same(rows, hot, pairs), "inner")
    rest = rows.join(F.broadcast(hot_names), _same(rows, hot_names, pairs), "left_anti")
    far = rest.join(cold, _same(rest, cold, pairs), "inner")
    out = [*rows.columns, *extra]
    return near.select(out).unionByName(far.select(out))


def _by(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_h")) for n in names])
