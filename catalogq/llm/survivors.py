"""One surviving record per group of duplicates, chosen in consistent bundles of fields.

Fields that depend on each other form a bundle, which is taken whole from one candidate row. Functional
dependencies that span bundles (say sub-category determines category) constrain which bundles go together.
Per group, branch and bound looks for the combination that breaks the fewest dependencies and, of
those, has the most trust.

What the search sees is bounded, whatever a group's size, and loses no answer:

* The bound comes first, by aggregation: each bundle's most trusted candidate. Where these break no dependency, they are the
  answer, and nothing is left to branch on.
* In the other groups candidates are reduced by determinant. A combination without a broken dependency either takes
  determinant and dependent with the same value, of which only the most trusted pair counts, or one of them demands or holds
  nothing, of which only the most trusted counts; one with a broken dependency is the most trusted of each. So three
  candidates a bundle are searched.
* A bundle that no dependency binds may name a level, an expression of few values; the search then has the most
  trusted candidate of each level. Without a level its bound is its answer.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from catalogq.operators.keyed import attach_keyed
from catalogq.session import cut


@dataclass(frozen=True)
class Bundle:
    """``fields`` taken together; ``order`` (SQL expressions, more is better, null lowest) ranks candidates; ties go to the smallest row.

    Bundles that rules bind are ranked by their filled fields, then by what ``order`` gives as bigint, which is added up over bundles.
    ``fields`` may be empty: the bundle then stands for the whole record.
    """

    name: str
    fields: tuple[str, ...]
    order: tuple[str, ...]
    level: str | None = None


@dataclass(frozen=True)
class Rule:
    """The value of ``determinant`` fixes the value of ``dependent``; both are fields of different bundles."""

    determinant: str
    dependent: str


Trust = tuple[int, ...]


def search(bundles: list[list[tuple[Trust, int, list, list]]]) -> list[int]:
    """Branch and bound over one candidate (trust, row, determined, value) per bundle; the rows chosen.

    ``determined`` and ``value`` hold, per rule, what the candidate's determinant demands and what its dependent is.
    Fewest broken rules first, then most trust, compared part by part, then the smallest rows. Of equal signatures only
    the best candidate is looked at, and the last bundle is looked up where one rule binds it, so two bundles cost linear time.
    """
    lists = []
    for b in bundles:
        best_of: dict = {}
        for c in sorted(b, key=lambda c: ([-t for t in c[0]], c[1])):
            best_of.setdefault((*c[2], *c[3]), c)
        lists.append(list(best_of.values()))
    plus = lambda a, b: tuple(x + y for x, y in zip(a, b))
    rest = [tuple(0 for _ in lists[0][0][0])]
    for b in reversed(lists):
        rest.insert(0, plus(b[0][0], rest[0]))
    rules = range(len(lists[0][0][2]))
    binding = [r for r in rules if any(c[2][r] is not None or c[3][r] is not None for c in lists[-1])]
    by_demand: dict = {}
    by_value: dict = {}
    if len(binding) == 1:
        for c in lists[-1]:
            by_demand.setdefault(c[2][binding[0]], c)
            by_value.setdefault(c[3][binding[0]], c)
    best: list = [None, None]

    def broken(demand: list, value: list) -> int:
        return sum(demand[r] is not None and value[r] is not None and demand[r] != value[r] for r in rules)

    def last(demand: list, value: list) -> list:
        """The candidates of the last bundle that can be best beside what was chosen."""
        if len(binding) != 1:
            return lists[-1]
        d, v = demand[binding[0]], value[binding[0]]
        found = [lists[-1][0], by_value.get(None) if d is not None else None, by_value.get(d), by_demand.get(None) if v is not None else None, by_demand.get(v)]
        return sorted((c for c in found if c), key=lambda c: ([-t for t in c[0]], c[1]))

    def descend(i: int, demand: list, value: list, trust: Trust, rows: list[int]) -> None:
        now = broken(demand, value)
        bound = (-now, plus(trust, rest[i]))  # rules are never mended further down, trust grows by the best at most
        if best[0] is not None and (bound, [-r for r in rows]) <= (best[0], best[1][: len(rows)]):
            return
        if i == len(lists):
            best[0], best[1] = bound, [-r for r in rows]
            return
        for t, row, d, v in last(demand, value) if i == len(lists) - 1 else lists[i]:
            descend(i + 1, [x if x is not None else y for x, y in zip(demand, d)], [x if x is not None else y for x, y in zip(value, v)], plus(trust, t), [*rows, row])

    descend(0, [None for _ in rules], [None for _ in rules], tuple(0 for _ in rest[0]), [])
    return [-r for r in best[1]]


def demanded(df: DataFrame, rule: Rule) -> DataFrame:
    """``x``, ``demand``, ``seen``: per determinant value the dependent value it occurs with most often (ties: the greatest).

    A determinant that occurs with nothing but nulls demands nothing (null), and so does null.
    """
    pairs = df.select(F.col(rule.determinant).cast("string").alias("x"), F.col(rule.dependent).cast("string").alias("y"))
    counted = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("x").agg(F.max(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("n", "y")))["y"].alias("demand"), F.sum("n").alias("seen"))


_KEY = ["__k0", "__k1"]


def _keyed(df: DataFrame, key: str) -> DataFrame:
    """The key as two columns without nulls, so that joins by it need no partitioning of their own."""
    kind = df.schema[key].dataType
    c = F.col(key) if isinstance(kind, (T.StringType, T.LongType, T.IntegerType)) else F.col(key).cast("string")
    return df.withColumns({"__k0": F.coalesce(c, F.lit(0 if isinstance(kind, (T.LongType, T.IntegerType)) else "")), "__k1": F.col(key).isNull()})


def _trust(b: Bundle) -> list[Column]:
    """Parts of a bundle's trust as bigints, null lowest: filled fields, then per expression whether it is there, and what it is."""
    filled = reduce(lambda a, c: a + c, [F.col(f).isNotNull().cast("bigint") for f in b.fields], F.lit(0).cast("bigint"))
    parts = [filled]
    for o in b.order:
        c = F.expr(o).cast("bigint")
        parts += [c.isNotNull().cast("bigint"), F.coalesce(c, F.lit(0).cast("bigint"))]
    return parts


def _candidate(b: Bundle, row: str, fields: bool, ranked: list[Column], *more: Column) -> Column:
    """A candidate as a struct whose greatest is the best."""
    carried = [F.struct(*b.fields).alias("fields")] if fields and b.fields else []
    return F.struct(*[c.alias(f"t{i}") for i, c in enumerate(ranked)], (-F.col(row)).alias("minus_row"), *more, *carried)


def _free(df: DataFrame, row: str, bundles: list[Bundle], fields: bool) -> DataFrame:
    """Per key ``candidates`` and the best candidate of each bundle, by aggregation before the shuffle."""
    return df.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("candidates"), *[F.max(_candidate(b, row, fields, [F.expr(o) for o in b.order])).alias(b.name) for b in bundles])


def _levelled(df: DataFrame, row: str, b: Bundle, fields: bool) -> DataFrame:
    """Per key ``candidates`` and the candidate the search finds among the best ones of each level."""
    per = df.withColumn("__level", F.expr(b.level)).groupBy(*_KEY, "__level").agg(F.count(F.lit(1)).alias("n"), F.max(_candidate(b, row, fields, _trust(b))).alias("best"))
    lists = per.groupBy(*_KEY).agg(F.sum("n").alias("candidates"), F.collect_list("best").alias("c"))
    n = 1 + 2 * len(b.order)

    @pandas_udf("bigint")
    def searched(groups: pd.Series) -> pd.Series:
        return groups.map(lambda cs: search([[(tuple(c[f"t{i}"] for i in range(n)), -c["minus_row"], [], []) for c in cs]])[0], na_action="ignore").astype("Int64")

    seen = F.transform("c", lambda x: F.struct(*[x[f"t{i}"].alias(f"t{i}") for i in range(n)], x["minus_row"].alias("minus_row")))
    chosen = F.coalesce(searched(F.when(F.size("c") > 1, seen)), -F.get("c", F.lit(0))["minus_row"])
    picked = lists.select(*_KEY, "candidates", "c", chosen.alias("__row"))
    return picked.select(*_KEY, "candidates", F.get(F.filter("c", lambda x: x["minus_row"] == -F.col("__row")), F.lit(0)).alias(b.name))


def _bound(df: DataFrame, row: str, rule: Rule, det: Bundle, dep: Bundle, fields: bool) -> DataFrame:
    """Per key the candidates of two bundles that a rule binds."""
    n = 1 + 2 * max(len(det.order), len(dep.order))
    if len(det.order) != len(dep.order):
        raise ValueError("bundles that a rule binds add up their trust and need as many expressions")
    rows = df.select(
        *_KEY,
        F.col(rule.determinant).cast("string").alias("x"),
        F.col(rule.dependent).cast("string").alias("y"),
        _candidate(det, row, fields, _trust(det), F.col(rule.determinant).cast("string").alias("link")).alias("det"),
        _candidate(dep, row, fields, _trust(dep), F.col(rule.dependent).cast("string").alias("link")).alias("dep"),
    )
    demands = cut(demanded(df, rule))
    # the bound: the best of each bundle, whatever the other
    tops = cut(rows.groupBy(*_KEY).agg(F.max("det").alias("det"), F.max("dep").alias("dep")).withColumn("__x", F.col("det.link")))
    tops = cut(attach_keyed(tops, demands.withColumnRenamed("x", "__x"), ["__x"], "seen").drop("seen", "__x"))
    breaks = F.coalesce(F.col("demand") != F.col("dep.link"), F.lit(False))
    some = cut(rows.join(tops.where(breaks).select(*_KEY), _KEY, "left_semi"))
    dets = some.groupBy(*_KEY, "x").agg(F.max("det").alias("det"))
    dets = attach_keyed(dets, demands, ["x"], "seen").select(*_KEY, F.col("demand").alias("link"), "det", F.lit(None).cast(rows.schema["dep"].dataType).alias("dep"))
    deps = some.groupBy(*_KEY, "y").agg(F.max("dep").alias("dep")).select(*_KEY, F.col("y").alias("link"), F.lit(None).cast(rows.schema["det"].dataType).alias("det"), "dep")
    met = dets.unionByName(deps).groupBy(*_KEY, "link").agg(F.max("det").alias("det"), F.max("dep").alias("dep"))
    total = F.struct(*[(F.col(f"det.t{i}") + F.col(f"dep.t{i}")).alias(f"t{i}") for i in range(n)], "det.minus_row", F.col("dep.minus_row").alias("minus_row2"), "det", "dep")
    pair = F.max(F.when(F.col("link").isNotNull() & F.col("det").isNotNull() & F.col("dep").isNotNull(), total.alias("p")))
    nothing = F.col("link").isNull()
    reduced = met.groupBy(*_KEY).agg(pair.alias("pair"), F.max(F.when(nothing, F.col("det"))).alias("det0"), F.max(F.when(nothing, F.col("dep"))).alias("dep0"))
    plain = lambda c: F.struct(F.array(*[c[f"t{i}"] for i in range(n)]).alias("trust"), c["minus_row"].alias("minus_row"), c["link"].alias("link"))
    three = lambda side: F.array(*[F.when(c.isNotNull(), plain(c)) for c in (F.col(side), F.col(f"pair.{side}"), F.col(f"{side}0"))])

    @pandas_udf("array<bigint>")
    def searched(dets: pd.Series, deps: pd.Series, top: pd.Series) -> pd.Series:
        out = []
        for a, b, demand in zip(dets, deps, top):
            if a is None:
                out.append(None)
                continue
            # best, paired, demanding nothing: the demand of a paired one is what its partner holds
            wants = [demand, None if b[1] is None else b[1]["link"], None]
            left = [(tuple(c["trust"]), -c["minus_row"], [w], [None]) for c, w in zip(a, wants) if c is not None]
            right = [(tuple(c["trust"]), -c["minus_row"], [None], [c["link"]]) for c in b if c is not None]
            out.append(search([left, right]))
        return pd.Series(out)

    both = tops.join(reduced, _KEY, "left").withColumn("__breaks", breaks)
    both = both.withColumn("__rows", searched(F.when(F.col("__breaks"), three("det")), F.when(F.col("__breaks"), three("dep")), F.col("demand")))
    chosen = lambda side, i: F.coalesce(*[F.when(-c["minus_row"] == F.get("__rows", F.lit(i)), c) for c in (F.col(side), F.col(f"pair.{side}"), F.col(f"{side}0"))], F.col(side))
    return both.select(*_KEY, chosen("det", 0).alias(det.name), chosen("dep", 1).alias(dep.name))


def _chosen(df: DataFrame, key: str, row: str, bundles: list[Bundle], rules: list[Rule], fields: bool) -> DataFrame:
    """Key columns, ``candidates`` and per bundle its chosen candidate."""
    where = {f: b for b in bundles for f in b.fields}
    pairs = [(r, where[r.determinant], where[r.dependent]) for r in rules]
    names = [b.name for _, *both in pairs for b in both]
    if len(names) != len(set(names)):
        raise ValueError("a bundle may take part in one rule, beside another bundle")
    df = _keyed(df, key)
    free = [b for b in bundles if b.name not in names and b.level is None]
    levelled = [b for b in bundles if b.name not in names and b.level is not None]
    parts = [_levelled(df, row, b, fields) for b in levelled]
    if free or not parts:
        parts.insert(0, _free(df, row, free, fields))
    parts += [_bound(df, row, r, det, dep, fields) for r, det, dep in pairs]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.drop("candidates"), _KEY)
    kind = df.schema[key].dataType
    return out.select(F.when(~F.col("__k1"), F.col("__k0").cast(kind)).alias(key), "candidates", *[b.name for b in bundles])


def surviving_rows(df: DataFrame, key: str, row: str, bundles: list[Bundle], rules: list[Rule]) -> DataFrame:
    """Per key: ``candidates`` (its rows) and, per bundle, ``<bundle>_row``, the row the bundle is taken from.

    Best candidates are found by aggregation before the shuffle, so a key that owns a third of all rows is never gathered;
    what a search sees is at most three candidates a bundle, or one a level. Exact repeats are candidates like others; a
    null key is a key of its own; a key with one row gives that row for every bundle; an empty table gives none. Rules
    bind pairs of bundles, each bundle at most once. Other columns of the table may have any name but one that begins with two underscores.
    """
    c = _chosen(df, key, row, bundles, rules, False)
    return c.select(key, "candidates", *[(-F.col(f"{b.name}.minus_row")).alias(f"{b.name}_row") for b in bundles])


def built_records(df: DataFrame, key: str, row: str, bundles: list[Bundle], rules: list[Rule]) -> DataFrame:
    """The surviving record per key with ``candidates``, each bundle's fields from its chosen row.

    The fields travel with the candidates, so no row is looked up again. As surviving_rows otherwise.
    """
    c = _chosen(df, key, row, bundles, rules, True)
    return c.select(key, "candidates", *[F.col(f"{b.name}.fields.{f}").alias(f) for b in bundles for f in b.fields])
