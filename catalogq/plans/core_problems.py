"""Queries of the problems solved in the core: p2 (hot keys), p4 (orphans), p6 (rows that fail to parse)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.operators import csv_recover as R
from catalogq.operators.dense import dense_key_figures
from catalogq.operators.orphans import orphan_counts, orphan_rows, reference_status
from catalogq.session import table

#: Share of all rows above which a product is reported as hot.
HOT_SHARE = 0.02


def product_figures(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "final_comments").select("product_id", "rate", "created_at_gregorian")
    return dense_key_figures(
        c,
        "product_id",
        {"rate_sum": ("sum", F.col("rate") * 100), "latest": ("max", F.unix_date("created_at_gregorian"))},
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "final_comments").count()  # from the parquet footers
    return product_figures(spark, d).where(F.col("n") > F.lit(HOT_SHARE * rows)).select("product_id")


def p2_product_figures(spark: SparkSession, d: str) -> DataFrame:
    return product_figures(spark, d).select(
        "product_id",
        F.col("n").alias("n_comments"),
        (F.col("rate_sum").cast("double") / F.col("rate_sum_n") / 100).alias("mean_rate"),
        F.date_from_unix_date(F.col("latest").cast("int")).alias("latest_comment"),
    )


def _refs(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).select("product_id", "source_row")


_PRODUCT = [("product_id", "product_id")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    products = table(spark, d, "final_products").select("product_id")
    parts = [orphan_rows(_refs(spark, d, t), products, _PRODUCT).select(F.lit(t).alias("table_name"), "source_row") for t in ("comment_candidates", "offers")]
    return parts[0].unionByName(parts[1])


def p4_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    products = table(spark, d, "final_products").select("product_id")
    comments = table(spark, d, "comment_candidates").select("product_id", "created_at_gregorian")
    month = F.date_format("created_at_gregorian", "yyyy-MM")
    a = orphan_counts(comments, products, _PRODUCT, "comment_candidates", month)
    return a.unionByName(orphan_counts(table(spark, d, "offers").select("product_id"), products, _PRODUCT, "offers"))


#: Composite references with nulls: their table, the table they point to, and pairs of columns. A comment names the product and,
#: often, the seller; the offers of that product hold the sellers that exist.
COMPOSITE = {
    "category": ("product_candidates", "final_products", [("category1", "category1"), ("category2", "category2"), ("sub_category", "sub_category")]),
    "seller": ("comment_candidates", "offers", [("product_id", "product_id"), ("seller_title", "seller")]),
}


def _composite_status(name: str, match: str):
    refs, targets, pairs = COMPOSITE[name]

    def query(spark: SparkSession, d: str) -> DataFrame:
        cols = [r for r, _ in pairs]
        status = reference_status(table(spark, d, refs).select(cols), table(spark, d, targets).select([t for _, t in pairs]), pairs, match)
        return status.where("is_orphan").select(*cols, "ref_rows")

    return query


def p4_seller_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Comments per month whose product, or product with seller, has no offer."""
    refs, targets, pairs = COMPOSITE["seller"]
    c = table(spark, d, refs).select("product_id", "seller_title", "created_at_gregorian")
    o = table(spark, d, targets).select("product_id", "seller")
    return orphan_counts(c, o, pairs, refs, F.date_format("created_at_gregorian", "yyyy-MM"), "partial")


#: Fields of a record of each feed, and the position of those that are checked.
FIELDS = {"comments": 15, "products": 12}


def parsed_records(spark: SparkSession, d: str) -> DataFrame:
    """raw_records with their fields or the first reason why they fail."""
    raw = table(spark, d, "raw_records").select("record_id", "feed", "raw_text")
    n = F.when(F.col("feed") == "comments", FIELDS["comments"]).otherwise(FIELDS["products"])
    p = R.parse_records(raw, "raw_text", n, ["record_id", "feed"])
    return p.withColumn("reason", _reason())


def _reason() -> Column:
    f, comment = F.col("fields"), F.col("feed") == "comments"
    at = lambda i: F.get(f, F.lit(i))
    return (
        F.when(F.col("kind").isNotNull(), F.col("kind"))
        .when(comment & ~R.valid_rate(at(4)), "rate")
        .when(comment & ~R.valid_count(at(10), True), "likes")
        .when(comment & ~at(6).isin("True", "False"), "is_buyer")
        .when(~comment & ~R.valid_count(at(7), False), "price")
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return parsed_records(spark, d).where(F.col("reason").isNotNull()).select("record_id", "reason")


def p6_error_places(spark: SparkSession, d: str) -> DataFrame:
    return parsed_records(spark, d).where(F.col("kind").isNotNull()).select("record_id", "feed", "kind", "error_offset", "error_line", "error_field")


#: Record ids that make one text of p6_recovered; bounds its size.
JOINED = 64
UNIT = "\x1f"


def p6_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Sound records found in texts of many records, as a delivery brings them: ``feed`` and the fields, set apart by UNIT.

    Records of a feed are joined by line breaks into texts, broken ones among them. Parsing goes on at validated record
    starts after a broken quote, so the records found are those that are sound on their own.
    """
    raw = table(spark, d, "raw_records").select("feed", F.floor(F.col("record_id") / JOINED).alias("part"), F.struct("record_id", "raw_text").alias("r"))
    texts = raw.groupBy("feed", "part").agg(F.array_sort(F.collect_list("r")).alias("r")).select("feed", F.array_join("r.raw_text", "\n").alias("text"))
    n = F.when(F.col("feed") == "comments", FIELDS["comments"]).otherwise(FIELDS["products"])
    found = R.parse_records(texts, "text", n, ["feed"], one_record=False).where("kind IS NULL")
    return found.select("feed", F.array_join("fields", UNIT).alias("record"))


def p6_comments(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("fields")
    at = lambda i: F.get(f, F.lit(i))
    number = lambda i, t: F.nullif(R.trimmed(at(i)), F.lit("")).try_cast(t)
    good = parsed_records(spark, d).where((F.col("feed") == "comments") & F.col("reason").isNull())
    return good.select(
        "record_id",
        number(0, "bigint").alias("comment_id"),
        number(7, "bigint").alias("product_id"),
        at(1).alias("title"),
        at(2).alias("body"),
        number(4, "decimal(3,2)").alias("rate"),
        (at(6) == "True").alias("is_buyer"),
        number(10, "bigint").alias("likes"),
    )


def p6_offers(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("fields")
    good = parsed_records(spark, d).where((F.col("feed") == "products") & F.col("reason").isNull())
    return good.select(
        "record_id",
        R.trimmed(F.get(f, F.lit(0))).try_cast("bigint").alias("product_id"),
        F.get(f, F.lit(8)).alias("seller"),
        R.trimmed(F.get(f, F.lit(7))).try_cast("bigint").alias("price_raw"),
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_product_figures": p2_product_figures,
    "p4_found": p4_found,
    "p4_orphans_by_month": p4_orphans_by_month,
    **{f"p4_{c}_{m}": _composite_status(c, m) for c in COMPOSITE for m in ("partial", "full", "simple")},
    "p4_seller_by_month": p4_seller_by_month,
    "p6_found": p6_found,
    "p6_error_places": p6_error_places,
    "p6_recovered": p6_recovered,
    "p6_comments": p6_comments,
    "p6_offers": p6_offers,
}

_QUOTED_FIELD = '"(?:[^"]|"")*"|[^,"]*'
_PARSED = f"""
split AS (
  SELECT record_id, feed, regexp_full_match(raw_text, '(?:{_QUOTED_FIELD})(?:,(?:{_QUOTED_FIELD}))*') AS quoted_well,
         [CASE WHEN f[1:1] = '"' THEN replace(f[2:-2], '""', '"') ELSE f END
          FOR f IN regexp_extract_all(',' || raw_text, ',({_QUOTED_FIELD})', 1)] AS f
  FROM raw_records),
checked AS (
  SELECT *, CASE
    WHEN NOT quoted_well THEN 'quoting'
    WHEN len(f) <> CASE WHEN feed = 'comments' THEN 15 ELSE 12 END THEN 'columns'
    WHEN feed = 'comments' AND NOT (trim(f[5]) = '' OR regexp_full_match(trim(f[5]), '[0-4](\\.[0-9]{{0,2}})?|5(\\.0{{0,2}})?')) THEN 'rate'
    WHEN feed = 'comments' AND NOT (trim(f[11]) = '' OR (regexp_full_match(trim(f[11]), '[0-9]+') AND TRY_CAST(trim(f[11]) AS BIGINT) IS NOT NULL)) THEN 'likes'
    WHEN feed = 'comments' AND f[7] NOT IN ('True', 'False') THEN 'is_buyer'
    WHEN feed = 'products' AND NOT (regexp_full_match(trim(f[8]), '[0-9]+') AND TRY_CAST(trim(f[8]) AS BIGINT) IS NOT NULL) THEN 'price'
    END AS reason
  FROM split)"""



def _composite_sql(name: str, match: str) -> str:
    refs, targets, pairs = COMPOSITE[name]
    cols = ", ".join(r for r, _ in pairs)
    nulls = "(" + " + ".join(f"CAST({r} IS NULL AS INT)" for r, _ in pairs) + ")"
    known = f"EXISTS (SELECT 1 FROM {targets} t WHERE " + " AND ".join(f"(k.{r} IS NULL OR k.{r} = t.{t})" for r, t in pairs) + ")"
    bad = {"simple": f"{nulls} = 0 AND NOT {known}", "partial": f"{nulls} < {len(pairs)} AND NOT {known}", "full": f"{nulls} BETWEEN 1 AND {len(pairs) - 1} OR ({nulls} = 0 AND NOT {known})"}
    return f"WITH k AS (SELECT {cols}, count(*) AS ref_rows FROM {refs} GROUP BY ALL) SELECT * FROM k WHERE {bad[match]}"


ORACLES = {
    "p2_found": "SELECT product_id FROM final_comments GROUP BY product_id HAVING count(*) > 0.02 * (SELECT count(*) FROM final_comments)",
    "p2_product_figures": """SELECT product_id, count(*) AS n_comments,
  CAST(sum(CAST(rate * 100 AS BIGINT)) AS DOUBLE) / count(rate) / 100 AS mean_rate, max(created_at_gregorian) AS latest_comment
  FROM final_comments GROUP BY product_id""",
    "p4_found": """SELECT 'comment_candidates' AS table_name, source_row FROM comment_candidates WHERE product_id NOT IN (SELECT product_id FROM final_products)
  UNION ALL SELECT 'offers', source_row FROM offers WHERE product_id NOT IN (SELECT product_id FROM final_products)""",
    "p4_orphans_by_month": """SELECT 'comment_candidates' AS table_name, strftime(created_at_gregorian, '%Y-%m') AS period, count(*) AS orphans
  FROM comment_candidates WHERE product_id NOT IN (SELECT product_id FROM final_products) GROUP BY ALL
  UNION ALL SELECT 'offers', NULL, count(*) FROM offers WHERE product_id NOT IN (SELECT product_id FROM final_products) HAVING count(*) > 0""",
    **{f"p4_{c}_{m}": _composite_sql(c, m) for c in COMPOSITE for m in ("partial", "full", "simple")},
    "p4_seller_by_month": f"""WITH o AS ({_composite_sql("seller", "partial")})
  SELECT 'comment_candidates' AS table_name, strftime(created_at_gregorian, '%Y-%m') AS period, count(*) AS orphans FROM comment_candidates c
  WHERE EXISTS (SELECT 1 FROM o WHERE o.product_id = c.product_id AND o.seller_title IS NOT DISTINCT FROM c.seller_title) GROUP BY ALL""",
    "p6_recovered": f"WITH {_PARSED} SELECT feed, array_to_string(f, chr(31)) AS record FROM checked WHERE quoted_well AND len(f) = CASE WHEN feed = 'comments' THEN 15 ELSE 12 END",
    "p6_found": f"WITH {_PARSED} SELECT record_id, reason FROM checked WHERE reason IS NOT NULL",
    "p6_comments": f"""WITH {_PARSED} SELECT record_id, TRY_CAST(trim(f[1]) AS BIGINT) AS comment_id, TRY_CAST(trim(f[8]) AS BIGINT) AS product_id,
  f[2] AS title, f[3] AS body, CAST(nullif(trim(f[5]), '') AS DECIMAL(3,2)) AS rate, f[7] = 'True' AS is_buyer, CAST(nullif(trim(f[11]), '') AS BIGINT) AS likes
  FROM checked WHERE feed = 'comments' AND reason IS NULL""",
    "p6_offers": f"""WITH {_PARSED} SELECT record_id, TRY_CAST(trim(f[1]) AS BIGINT) AS product_id, f[9] AS seller, CAST(trim(f[8]) AS BIGINT) AS price_raw
  FROM checked WHERE feed = 'products' AND reason IS NULL""",
}
