"""Figures per level of a hierarchy of categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.operators.quantile import interpolated_quantiles

#: Numbers of comments for which an inventory counts the products that reach them.
STEPS = (5, 10, 20, 50)


def scoped(df: DataFrame, levels: list[str]) -> DataFrame:
    """Each row once per scope it belongs to: ``level`` and ``levels``, those below the scope null.

    A scope ends before the first null level; a row without the first level belongs to none.
    """
    scopes = []
    for i in range(len(levels)):
        there = reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in levels[: i + 1]])
        scopes.append(F.when(there, F.struct(F.lit(i + 1).alias("level"), *[(F.col(x) if j <= i else F.lit(None).cast("string")).alias(f"scope_{x}") for j, x in enumerate(levels)])))
    e = F.explode(F.filter(F.array(*scopes), lambda s: s.isNotNull())).alias("__scope")
    return df.select("*", e).select("*", "__scope.*").drop("__scope")


def inventory(products: DataFrame, offers: DataFrame, comments: DataFrame, levels: list[str]) -> DataFrame:
    """Per scope: products, brands, comments and what they hold, products by number of comments, prices; quantiles of comments are over products that have some.

    ``products``: product_id, levels, brand. ``offers``: product_id, price (null or not positive: no price).
    ``comments``: product_id, body, is_buyer, rate. Comments and offers are added up per product before any join, so a
    product that owns a third of all comments joins as one row.
    """
    per_comment = comments.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("comments"),
        F.count_if(F.col("body").isNotNull()).alias("bodies"),
        F.count_if(F.col("is_buyer")).alias("buyers"),
        F.count_if(F.col("rate") > 0).alias("ratings"),
    )
    per_offer = offers.where("price > 0").groupBy("product_id").agg(F.min("price").alias("price"))
    p = products.select("product_id", *levels, "brand").join(per_comment, "product_id", "left").join(per_offer, "product_id", "left")
    s = scoped(p.fillna(0, ["comments", "bodies", "buyers", "ratings"]), levels)
    keys = ["level", *[f"scope_{x}" for x in levels]]
    figures = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("products"),
        F.count_distinct("brand").alias("brands"),
        F.sum("comments").alias("comments"),
        F.count_if(F.col("comments") > 0).alias("commented_products"),
        F.sum("bodies").alias("bodies"),
        F.sum("buyers").alias("buyers"),
        F.sum("ratings").alias("ratings"),
        F.count("price").alias("priced_products"),
        *[F.count_if(F.col("comments") >= k).alias(f"products_with_{k}") for k in STEPS],
    )
    values = F.explode(F.array(F.struct(F.lit("price").alias("metric"), F.col("price").cast("bigint").alias("value")), F.struct(F.lit("comments").alias("metric"), F.when(F.col("comments") > 0, F.col("comments")).alias("value")))).alias("v")
    q = interpolated_quantiles(s.select(*keys, values).select(*keys, "v.*"), [*keys, "metric"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    asked = [("price", "p05"), ("price", "p50"), ("price", "p95"), ("comments", "p50"), ("comments", "p95")]
    q = q.groupBy(*[F.col(k).alias(f"q_{k}") for k in keys]).agg(*[F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}") for m, p in asked])
    out = figures.join(q, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in keys]), "left")
    share = lambda c: (F.col(c) * 100).cast("double") / F.col("products")
    return out.select(
        *keys,
        *[c for c in figures.columns if c not in keys],
        (F.col("products") - F.col("commented_products")).alias("uncommented_products"),
        "price_p05",
        "price_p50",
        "price_p95",
        "comments_p50",
        "comments_p95",
        share("commented_products").alias("coverage_percent"),
        share("priced_products").alias("price_coverage_percent"),
    )


# The columns of the published inventory, and the figure each one holds; the scope comes before them.
REPORT = {
    "product_count": "products",
    "comment_count": "comments",
    "products_with_comments": "commented_products",
    "products_without_comments": "uncommented_products",
    "product_comment_coverage_pct": "coverage_percent",
    **{f"products_with_at_least_{k}_comments": f"products_with_{k}" for k in STEPS},
    "median_comments_per_commented_product": "comments_p50",
    "p95_comments_per_commented_product": "comments_p95",
    "non_empty_body_count": "bodies",
    "buyer_comment_count": "buyers",
    "valid_positive_rating_count": "ratings",
    "unique_brand_count": "brands",
    "products_with_valid_historical_price": "priced_products",
    "historical_price_coverage_pct": "price_coverage_percent",
    "historical_price_p05": "price_p05",
    "historical_price_p50": "price_p50",
    "historical_price_p95": "price_p95",
}


def report(inv: DataFrame) -> DataFrame:
    """An inventory over category1 and category2 with the columns of the published report."""
    level = F.when(F.col("level") == 1, "category1").otherwise("category1_category2")
    return inv.select(level.alias("scope_level"), F.col("scope_category1").alias("category1"), F.col("scope_category2").alias("category2"), *[F.col(c).alias(n) for n, c in REPORT.items()])


def broken_invariants(inv: DataFrame) -> DataFrame:
    """Scopes whose figures contradict each other; expected empty."""
    ordered = [F.col(f"products_with_{a}") >= F.col(f"products_with_{b}") for a, b in zip(STEPS, STEPS[1:])]
    sound = reduce(lambda a, b: a & b, [F.col("commented_products") <= F.col("products"), F.col("bodies") <= F.col("comments"), F.col("buyers") <= F.col("comments"), F.col("ratings") <= F.col("comments"), F.col(f"products_with_{STEPS[0]}") <= F.col("commented_products"), F.col("priced_products") <= F.col("products"), *ordered])
    return inv.where(~sound)


def top_scopes(inv: DataFrame, least: dict[str, float], without: tuple[Column, list[str]], order: list[Column], k: int) -> DataFrame:
    """The ``k`` first scopes by ``order`` that reach all least figures and whose name holds none of the terms."""
    name, terms = without
    keep = reduce(lambda a, b: a & b, [F.col(c) >= v for c, v in least.items()])
    for t in terms:
        keep = keep & ~F.coalesce(name.contains(t), F.lit(False))
    return inv.where(keep).orderBy(*order).limit(k)


def named_scopes(inv: DataFrame, names: list[tuple], levels: list[str]) -> DataFrame:
    """The scopes of a stated list, in its order (``place``); a name may be null below its level. Unknown names are left out."""
    spark = inv.sparkSession
    asked = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "place int, " + ", ".join(f"n_{x} string" for x in levels))
    on = reduce(lambda a, b: a & b, [F.col(f"scope_{x}").eqNullSafe(F.col(f"n_{x}")) for x in levels])
    return inv.join(F.broadcast(asked), on).drop(*[f"n_{x}" for x in levels])


def unmet(inv: DataFrame, scope: dict[str, str | None], expected: dict[str, float]) -> dict[str, tuple]:
    """Figures of one scope that differ from what is expected of it: name, (expected, found). All if it is missing."""
    r = inv.where(reduce(lambda a, b: a & b, [F.col(f"scope_{k}").eqNullSafe(F.lit(v)) for k, v in scope.items()])).first()
    found = {k: None if r is None else r[k] for k in expected}
    return {k: (v, found[k]) for k, v in expected.items() if found[k] is None or abs(found[k] - v) > 1e-9 * max(1, abs(v))}
