"""Raw text rows made from the test tables, with deterministic dirt; one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogq.session import table

RAW_PRODUCTS = """
SELECT o.source_row AS source_row,
  CASE o.source_row % 97 WHEN 0 THEN 'bad' WHEN 1 THEN '-1' WHEN 2 THEN '1.5' WHEN 3 THEN '  ' WHEN 4 THEN CAST(o.product_id AS STRING) || '.0'
    WHEN 5 THEN '00' || CAST(o.product_id AS STRING) WHEN 6 THEN '1e3' WHEN 7 THEN '99999999999999999999' WHEN 8 THEN ' ' || CAST(o.product_id AS STRING) || ' '
    ELSE CAST(o.product_id AS STRING) END AS id,
  coalesce(p.title_fa, CASE o.source_row % 3 WHEN 0 THEN '  ' ELSE '' END) AS title_fa,
  CASE WHEN o.source_row % 89 = 0 THEN '101' WHEN o.source_row % 89 = 1 THEN 'bad' WHEN o.source_row % 89 = 2 THEN '-0.5' WHEN o.source_row % 89 = 3 THEN ''
    WHEN p.rate IS NULL THEN '0' ELSE CAST(CAST(floor(round(p.rate * 10) / 10) AS BIGINT) AS STRING) || '.' || CAST(CAST(round(p.rate * 10) AS BIGINT) % 10 AS STRING) END AS `Rate`,
  CASE o.source_row % 83 WHEN 0 THEN '-3' WHEN 1 THEN '2.5' WHEN 2 THEN '' WHEN 3 THEN '7.0' ELSE coalesce(CAST(p.rate_count AS STRING), '0') END AS `Rate_cnt`,
  coalesce(p.category1, '') AS `Category1`, coalesce(p.category2, '') AS `Category2`, coalesce(p.brand, '') AS `Brand`,
  CASE o.source_row % 79 WHEN 0 THEN 'bad' WHEN 1 THEN '-5' WHEN 2 THEN '9223372036854775808' WHEN 3 THEN '0' WHEN 4 THEN '1.5' ELSE coalesce(CAST(o.price_raw AS STRING), '0') END AS `Price`,
  coalesce(o.seller, 'nan') AS `Seller`,
  CASE WHEN o.source_row % 71 = 0 THEN 'yes' WHEN o.source_row % 71 = 1 THEN 'true' WHEN o.is_fake IS NULL THEN '' WHEN o.is_fake THEN 'True' ELSE 'False' END AS `Is_Fake`,
  coalesce(CAST(o.min_price_last_month AS STRING), CASE WHEN o.missing_price_history THEN '0' ELSE '' END) AS min_price_last_month,
  coalesce(p.sub_category, '') AS sub_category
FROM {offers} o LEFT JOIN {product_candidates} p ON o.source_row = p.source_row"""

_TEXT = "coalesce({c}, CASE source_row % 4 WHEN 0 THEN 'nan' WHEN 1 THEN '  ' WHEN 2 THEN '' ELSE 'NAN' END) AS {c}"
_TEXTS = {c: _TEXT.format(c=c) for c in ("title", "body", "recommendation_status", "advantages", "disadvantages", "seller_title", "seller_code", "true_to_size_rate")}
RAW_COMMENTS = f"""
SELECT source_row,
  CASE source_row % 101 WHEN 0 THEN 'bad' WHEN 1 THEN '-7' WHEN 2 THEN '2.5' WHEN 3 THEN '' ELSE CAST(comment_id AS STRING) END AS id,
  {_TEXTS['title']}, {_TEXTS['body']},
  CASE source_row % 103 WHEN 0 THEN '31 مهر 1399' WHEN 1 THEN '30 اسفند 1399' WHEN 2 THEN '30 اسفند 1400' WHEN 3 THEN '1 Farvardin 1400' WHEN 4 THEN '0 تیر 1400'
    WHEN 5 THEN '1  تیر 1400' WHEN 6 THEN '1 دی 0000' WHEN 7 THEN '1 دی 9378' ELSE created_at_raw END AS created_at,
  CASE source_row % 107 WHEN 0 THEN '3.500' WHEN 1 THEN '2500' WHEN 2 THEN '0.000' WHEN 3 THEN '-1' WHEN 4 THEN 'bad' WHEN 5 THEN ' 3.5 ' WHEN 6 THEN '5.01'
    ELSE coalesce(CAST(rate AS STRING), CASE WHEN is_unrated THEN '0' ELSE '' END) END AS rate,
  {_TEXTS['recommendation_status']},
  CASE WHEN source_row % 109 = 0 THEN 'yes' WHEN is_buyer IS NULL THEN '' WHEN is_buyer THEN 'True' ELSE 'False' END AS is_buyer,
  CASE source_row % 113 WHEN 0 THEN '1.5' WHEN 1 THEN ' ' ELSE CAST(product_id AS STRING) END AS product_id,
  {_TEXTS['advantages']}, {_TEXTS['disadvantages']},
  CASE source_row % 127 WHEN 0 THEN '-2' WHEN 1 THEN '1.5' WHEN 2 THEN '1e2' ELSE coalesce(CAST(likes AS STRING), '') END AS likes,
  CASE source_row % 131 WHEN 0 THEN 'x' ELSE coalesce(CAST(dislikes AS STRING), ' ') END AS dislikes,
  {_TEXTS['seller_title']}, {_TEXTS['seller_code']}, {_TEXTS['true_to_size_rate']}
FROM {{comment_candidates}}"""


def _view(spark: SparkSession, d: str, sql: str, names: list[str]) -> DataFrame:
    return spark.sql(sql, **{n: table(spark, d, n) for n in names})


def raw_products(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, RAW_PRODUCTS, ["offers", "product_candidates"])


def raw_comments(spark: SparkSession, d: str) -> DataFrame:
    return _view(spark, d, RAW_COMMENTS, ["comment_candidates"])


def for_duckdb(sql: str) -> str:
    return sql.replace("{offers}", "offers").replace("{product_candidates}", "product_candidates").replace("{comment_candidates}", "comment_candidates").replace("`", '"')


#: Common table expressions for the SQL side.
CTE_PRODUCTS = f"raw_products AS ({for_duckdb(RAW_PRODUCTS)})"
CTE_COMMENTS = f"raw_comments AS ({for_duckdb(RAW_COMMENTS)})"
