"""Queries of the corpus problems (p1, p3, p5, p7, p8, p9, p10) and the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.llm import format_duplicates as D
from catalogq.llm import leakage, log_sketch, lookalikes, mojibake, packing
from catalogq.llm.survivors import Bundle, Rule, built_records, surviving_rows
from catalogq.session import cut, table

# --- p1 -------------------------------------------------------------------------------------------------------------

#: The promised relative error, and that of the buckets: the difference is room for rounding to DECIMALS places, which engines
#: need to give the same figures. It suffices for all values of at least one half; whole prices other than 0 are.
PRICE_ERROR = 0.01
BUCKET_ERROR = 0.0099
DECIMALS = 4
PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
CATEGORIES = ["category1", "category2"]


def _price_buckets(spark: SparkSession, d: str, slices: list[str]) -> DataFrame:
    """Bucket counts of price_raw per category pair (and slice of the offers)."""
    # sixteen slices at any size, standing for days or deliveries
    offers = table(spark, d, "offers").withColumn("feed_slice", F.shiftrightunsigned(F.xxhash64("offer_id"), 60))
    per_product = log_sketch.bucket_counts(offers, ["product_id", *slices], "price_raw", BUCKET_ERROR)
    products = table(spark, d, "final_products").select("product_id", *CATEGORIES)
    return per_product.join(products, "product_id").groupBy(*CATEGORIES, *slices, "bucket").agg(F.sum("n").alias("n"))


def _percentiles(counts: DataFrame) -> DataFrame:
    return log_sketch.percentiles(counts, CATEGORIES, PERCENTILES, BUCKET_ERROR).withColumn("estimate", F.round("estimate", DECIMALS))


def p1_price_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(_price_buckets(spark, d, []))


def p1_from_slices(spark: SparkSession, d: str) -> DataFrame:
    return _percentiles(log_sketch.combined(_price_buckets(spark, d, ["feed_slice"]), CATEGORIES))


def p1_error_audit(spark: SparkSession, d: str) -> DataFrame:
    """The exact percentiles, from counts per value, and whether the published estimate keeps the promised bound."""
    offers = table(spark, d, "offers").where("price_raw IS NOT NULL").groupBy("product_id", "price_raw").agg(F.count(F.lit(1)).alias("n"))
    values = offers.join(table(spark, d, "final_products").select("product_id", *CATEGORIES), "product_id").groupBy(*CATEGORIES, F.col("price_raw").alias("bucket")).agg(F.sum("n").alias("n"))
    # ranks among values go by value like ranks among buckets
    from pyspark.sql import Window

    by = Window.partitionBy(*CATEGORIES)
    r = values.select(*CATEGORIES, "bucket", "n", F.sum("n").over(by.orderBy("bucket")).alias("upto"), F.sum("n").over(by).alias("total"))
    r = r.withColumn("percentile", F.explode(F.array(*map(F.lit, PERCENTILES))))
    rank = F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("total")))
    exact = r.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select(*CATEGORIES, "percentile", F.col("bucket").alias("exact"))
    a, b = exact.alias("a"), p1_price_percentiles(spark, d).alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*CATEGORIES, "percentile")]
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.lit(PRICE_ERROR) * F.abs(F.col("exact"))
    return a.join(b, on).select("a.category1", "a.category2", "a.percentile", "exact", near.alias("within_bound"))


_LOG = repr(math.log(log_sketch.gamma(BUCKET_ERROR)))
_GAMMA = repr(log_sketch.gamma(BUCKET_ERROR))
_ASKED = ", ".join(f"CAST({p} AS DOUBLE)" for p in PERCENTILES)
_P1 = f"""
WITH b AS (
  SELECT category1, category2, CAST(ceil(round(ln(price_raw) / {_LOG}, 9)) AS BIGINT) AS bucket, count(*) AS n
  FROM offers JOIN final_products USING (product_id) WHERE price_raw > 0 GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY category1, category2 ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY category1, category2) AS total FROM b),
q AS (SELECT *, unnest([{_ASKED}]) AS percentile FROM r)
SELECT category1, category2, percentile, CAST(total AS BIGINT) AS n, round(2 / ({_GAMMA} + 1) * pow({_GAMMA}, bucket), {DECIMALS}) AS estimate
FROM q WHERE upto >= greatest(1, ceil(percentile * total)) AND upto - n < greatest(1, ceil(percentile * total))"""
_P1_EXACT = f"""
WITH v AS (SELECT category1, category2, price_raw, row_number() OVER (PARTITION BY category1, category2 ORDER BY price_raw) AS k,
  count(*) OVER (PARTITION BY category1, category2) AS total FROM offers JOIN final_products USING (product_id) WHERE price_raw IS NOT NULL),
q AS (SELECT *, unnest([{_ASKED}]) AS percentile FROM v)
SELECT category1, category2, percentile, price_raw AS exact, TRUE AS within_bound FROM q WHERE k = greatest(1, ceil(percentile * total))"""

# --- p3 -------------------------------------------------------------------------------------------------------------

#: The record as one bundle, ranked as the survivors are defined; the search has its best row of each completeness.
COMMENT_RECORD = Bundle("record", (), ("completeness", "unix_date(created_at_gregorian)"), "completeness")
PRODUCT_RECORD = Bundle("record", (), ("rate_count", "completeness"), "completeness")
COMMENT_BUNDLES = [
    Bundle("product", ("product_id",), ("completeness", "created_at_gregorian")),
    Bundle("content", ("title", "body"), ("int(title IS NOT NULL) + int(body IS NOT NULL)", "completeness", "created_at_gregorian")),
    Bundle("created", ("created_at_raw", "created_at_jalali", "created_at_gregorian"), ("created_at_gregorian", "completeness")),
    Bundle("rating", ("rate", "is_unrated", "invalid_rate"), ("int(rate IS NOT NULL)", "created_at_gregorian", "completeness")),
    Bundle("recommendation", ("recommendation_status",), ("int(recommendation_status IS NOT NULL)", "created_at_gregorian", "completeness")),
    Bundle("buyer", ("is_buyer",), ("int(is_buyer IS NOT NULL)", "created_at_gregorian", "completeness")),
    Bundle("points", ("advantages", "disadvantages"), ("int(advantages IS NOT NULL) + int(disadvantages IS NOT NULL)", "created_at_gregorian", "completeness")),
    Bundle("votes", ("likes", "dislikes"), ("int(likes IS NOT NULL) + int(dislikes IS NOT NULL)", "created_at_gregorian", "likes", "completeness")),
    Bundle("seller_name", ("seller_title",), ("completeness", "unix_date(created_at_gregorian)")),
    Bundle("seller_id", ("seller_code",), ("completeness", "unix_date(created_at_gregorian)")),
    Bundle("fit", ("true_to_size_rate",), ("int(true_to_size_rate IS NOT NULL)", "created_at_gregorian", "completeness")),
]
COMMENT_RULES = [Rule("seller_code", "seller_title")]
PRODUCT_BUNDLES = [
    Bundle("naming", ("title_fa", "brand"), ("int(title_fa IS NOT NULL) + int(brand IS NOT NULL)", "rate_count", "completeness")),
    Bundle("rating", ("rate", "rate_count", "is_unrated", "inconsistent_zero_rate"), ("rate_count", "int(rate IS NOT NULL)", "completeness")),
    Bundle("category", ("category1", "category2"), ("rate_count", "completeness")),
    Bundle("shelf", ("sub_category",), ("rate_count", "completeness")),
]
PRODUCT_RULES = [Rule("sub_category", "category1")]

_ENTITIES = {
    "comment": ("comment_candidates", "comment_id", COMMENT_RECORD, COMMENT_BUNDLES, COMMENT_RULES),
    "product": ("product_candidates", "product_id", PRODUCT_RECORD, PRODUCT_BUNDLES, PRODUCT_RULES),
}


def _survivors(spark: SparkSession, d: str, entity: str) -> DataFrame:
    name, key, record, _, _ = _ENTITIES[entity]
    return surviving_rows(table(spark, d, name), key, "source_row", [record], [])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        _survivors(spark, d, e).where("candidates > 1").select(F.lit(e).alias("entity"), F.col(_ENTITIES[e][1]).alias("entity_id"), F.col("record_row").alias("source_row"))
        for e in _ENTITIES
    ]
    return parts[0].unionByName(parts[1])


def _built(entity: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        name, key, _, bundles, rules = _ENTITIES[entity]
        return built_records(table(spark, d, name), key, "source_row", bundles, rules)

    return query


def p3_stale_choices(spark: SparkSession, d: str) -> DataFrame:
    """Ids whose survivor differs from the earlier run's choice, or that it does not have."""
    parts = []
    for e, final in (("comment", "final_comments"), ("product", "final_products")):
        key = _ENTITIES[e][1]
        now = _survivors(spark, d, e).select(F.col(key).alias("entity_id"), F.col("record_row").alias("source_row"))
        was = table(spark, d, final).select(F.col(key).alias("entity_id"), F.col("canonical_source_row").alias("earlier_row"))
        both = now.join(was, "entity_id", "left").where(~F.col("source_row").eqNullSafe(F.col("earlier_row")))
        parts.append(both.select(F.lit(e).alias("entity"), "entity_id", "source_row", "earlier_row"))
    return parts[0].unionByName(parts[1])


_P3 = """
WITH c AS (SELECT 'comment' AS entity, comment_id AS entity_id, source_row, row_number() OVER w AS k, count(*) OVER (PARTITION BY comment_id) AS n
  FROM comment_candidates WINDOW w AS (PARTITION BY comment_id ORDER BY completeness DESC, created_at_gregorian DESC NULLS LAST, source_row)),
p AS (SELECT 'product' AS entity, product_id AS entity_id, source_row, row_number() OVER w AS k, count(*) OVER (PARTITION BY product_id) AS n
  FROM product_candidates WINDOW w AS (PARTITION BY product_id ORDER BY rate_count DESC NULLS LAST, completeness DESC, source_row)),
s AS (SELECT * FROM c WHERE k = 1 UNION ALL SELECT * FROM p WHERE k = 1)"""



def _parts(exprs: tuple[str, ...], of: list[str]) -> list[str]:
    """Order of pairs of candidates: sums, per expression, of whether it is there and of what it is."""
    each = lambda e, t: f"{t}.{e}"
    return [x for e in exprs for x in (" + ".join(f"({each(e, t)} IS NOT NULL)::INT" for t in of) + " DESC", " + ".join(f"coalesce({each(e, t)}, 0)" for t in of) + " DESC")]


def _built_sql(name: str, key: str, bundles: list[Bundle], rules: list[Rule]) -> str:
    """Brute force: a window per free bundle, and all pairs of an id's rows for bound ones."""
    where = {f: b for b in bundles for f in b.fields}
    (rule,) = rules
    det, dep = where[rule.determinant], where[rule.dependent]
    plain = lambda o: o.replace("int(", "CAST(").replace(" IS NOT NULL)", " IS NOT NULL AS INT)")
    parts = [f"n AS (SELECT {key}, count(*) AS candidates FROM {name} GROUP BY 1)"]
    for b in bundles:
        if b not in (det, dep):
            order = ", ".join(f"{plain(o)} DESC NULLS LAST" for o in b.order)
            parts.append(f"b_{b.name} AS (SELECT {key}, {', '.join(b.fields)} FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}, source_row) = 1)")
    filled = lambda b, t: " + ".join(f"({t}.{f} IS NOT NULL)::INT" for f in b.fields)
    columns = [o.replace("unix_date(created_at_gregorian)", "day") for o in det.order]
    day = ", created_at_gregorian - DATE '1970-01-01' AS day" if "day" in columns else ""
    parts.append(f"t AS (SELECT *{day} FROM {name})")
    parts.append(f"demand AS (SELECT x, y FROM (SELECT {rule.determinant} AS x, {rule.dependent} AS y, count(*) AS c FROM {name} WHERE {rule.determinant} IS NOT NULL AND {rule.dependent} IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y DESC) = 1)")
    fields = [f"a.{f}" for f in det.fields] + [f"b.{f}" for f in dep.fields]
    order = [f"coalesce(demand.y <> b.{rule.dependent}, FALSE)", f"{filled(det, 'a')} + {filled(dep, 'b')} DESC", *_parts(tuple(columns), ["a", "b"]), "a.source_row", "b.source_row"]
    parts.append(f"pairs AS (SELECT a.{key}, {', '.join(fields)} FROM t a JOIN t b USING ({key}) LEFT JOIN demand ON demand.x = a.{rule.determinant} QUALIFY row_number() OVER (PARTITION BY a.{key} ORDER BY {', '.join(order)}) = 1)")
    joins = " ".join(f"JOIN b_{b.name} USING ({key})" for b in bundles if b not in (det, dep))
    return f"WITH {', '.join(parts)} SELECT * FROM n {joins} JOIN pairs USING ({key})"


# --- p5 -------------------------------------------------------------------------------------------------------------

_TEXTS = {"comment_candidates": ["title", "body"], "product_candidates": ["title_fa"]}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [D.format_duplicates(table(spark, d, t), f, "source_row").select(F.lit(t).alias("table_name"), "first_row", "copy_row") for t, f in _TEXTS.items()]
    return parts[0].unionByName(parts[1])


def p5_copy_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [D.copy_groups(D.keyed_rows(table(spark, d, t), f, "source_row")).select(F.lit(t).alias("table_name"), "first_row", "copies") for t, f in _TEXTS.items()]
    return parts[0].unionByName(parts[1])


def p5_collisions(spark: SparkSession, d: str) -> DataFrame:
    parts = [D.collisions(D.keyed_rows(table(spark, d, t), f, "source_row")).select(F.lit(t).alias("table_name"), "digest", "forms", "rows") for t, f in _TEXTS.items()]
    return parts[0].unionByName(parts[1])


_WORD = r"[\p{L}\p{Nd}\p{M}\x{200c}]+"
_P5 = f"""
WITH k AS (
  SELECT 'comment_candidates' AS table_name, source_row, list_sort(regexp_extract_all(lower(title || chr(10) || body), '{_WORD}')) AS w FROM comment_candidates WHERE title IS NOT NULL AND body IS NOT NULL
  UNION ALL SELECT 'product_candidates', source_row, list_sort(regexp_extract_all(lower(title_fa), '{_WORD}')) FROM product_candidates WHERE title_fa IS NOT NULL),
g AS (SELECT table_name, source_row, min(source_row) OVER (PARTITION BY table_name, w) AS first_row, count(*) OVER (PARTITION BY table_name, w) AS copies FROM k)"""

# --- p7 -------------------------------------------------------------------------------------------------------------

_ODD = {"comment_candidates": ["body"], "product_candidates": ["title_fa", "brand"]}


def _odd(spark: SparkSession, d: str) -> DataFrame:
    parts = [lookalikes.odd_values(table(spark, d, t), "source_row", f, t) for t, f in _ODD.items()]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _odd(spark, d).select("table_name", "source_row", "field")


def p7_normalized_products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "product_candidates")
    return p.select("source_row", *[lookalikes.normalized(F.col(c)).alias(c) for c in _ODD["product_candidates"]])


def p7_normalized_comments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comment_candidates").select("source_row", lookalikes.normalized(F.col("body")).alias("body"))


# --- p8 -------------------------------------------------------------------------------------------------------------

CAPACITY = 2048


def p8_assignments(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), "doc_id", "text", CAPACITY)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return p8_assignments(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, those assigned exactly once and whole wherever they fit, containers above capacity, and whether at most one token in fifty of the room is unused."""
    p = cut(p8_assignments(spark, d))
    sound = (F.col("first_token") == F.col("piece") * CAPACITY) & (F.col("n_tokens") <= CAPACITY)
    per = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("k"), F.max("piece").alias("last"), F.sum("n_tokens").alias("tokens"), F.bool_and(sound).alias("sound"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / CAPACITY))
    once = per.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("sound") & (F.col("n") == F.col("k")) & (F.col("n") == pieces) & (F.col("last") == F.col("n") - 1)).alias("assigned_once"))
    c = p.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    room = c.agg(F.count_if(F.col("used") > CAPACITY).alias("overfull"), (F.sum("used") >= 0.98 * CAPACITY * (F.count(F.lit(1)) - 1)).alias("well_filled"))
    return once.withColumn("__one", F.lit(1)).join(room.withColumn("__one", F.lit(1)), "__one").drop("__one")


# --- p9, p10 --------------------------------------------------------------------------------------------------------


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_near_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Passages with at most two words changed, added or left out."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), errors=2)


_GRAMS = """SELECT DISTINCT {id}, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT {id}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '{word}') AS w FROM {t} WHERE text IS NOT NULL))"""
_P9 = f"WITH a AS ({_GRAMS.format(id='item_id', t='eval_items', word=_WORD)}), b AS ({_GRAMS.format(id='doc_id', t='documents', word=_WORD)}) SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (g)"


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, d, "documents"))


QUERIES = {
    "p1_price_percentiles": p1_price_percentiles,
    "p1_from_slices": p1_from_slices,
    "p1_error_audit": p1_error_audit,
    "p3_found": p3_found,
    "p3_built_comments": _built("comment"),
    "p3_built_products": _built("product"),
    "p3_stale_choices": p3_stale_choices,
    "p5_found": p5_found,
    "p5_copy_counts": p5_copy_counts,
    "p5_collisions": p5_collisions,
    "p7_found": p7_found,
    "p7_normalized_products": p7_normalized_products,
    "p7_normalized_comments": p7_normalized_comments,
    "p8_assignments": p8_assignments,
    "p8_containers": p8_containers,
    "p8_audit": p8_audit,
    "p9_found": p9_found,
    "p9_near_leaks": p9_near_leaks,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}

ORACLES = {
    "p1_price_percentiles": _P1,
    "p1_from_slices": _P1,
    "p1_error_audit": _P1_EXACT,
    "p3_found": f"{_P3} SELECT entity, entity_id, source_row FROM s WHERE n > 1",
    "p3_built_comments": _built_sql("comment_candidates", "comment_id", COMMENT_BUNDLES, COMMENT_RULES),
    "p3_built_products": _built_sql("product_candidates", "product_id", PRODUCT_BUNDLES, PRODUCT_RULES),
    "p3_stale_choices": f"""{_P3} SELECT entity, entity_id, s.source_row, f.canonical_source_row AS earlier_row FROM s
  LEFT JOIN (SELECT 'comment' AS entity, comment_id AS entity_id, canonical_source_row FROM final_comments UNION ALL
             SELECT 'product', product_id, canonical_source_row FROM final_products) f USING (entity, entity_id)
  WHERE s.source_row IS DISTINCT FROM f.canonical_source_row""",
    "p5_found": f"{_P5} SELECT table_name, first_row, source_row AS copy_row FROM g WHERE source_row > first_row",
    "p5_copy_counts": f"{_P5} SELECT DISTINCT table_name, first_row, copies FROM g",
    # two hashes and the length of different texts all agree in no table; a planted pair is in the tests
    "p5_collisions": "SELECT '' AS table_name, '' AS digest, 0 AS forms, 0 AS rows WHERE FALSE",
    "p8_audit": "SELECT count(*) AS documents, count(*) AS assigned_once, 0 AS overfull, TRUE AS well_filled FROM documents",
    "p9_found": _P9,
}
