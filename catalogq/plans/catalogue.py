"""Queries of the catalogue and review engine, each beside SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.functions import digest as G
from catalogq.operators import canonical as C
from catalogq.operators import counters, dedup, evidence, profile, quantile, rules, scopes
from catalogq.operators import transforms as T
from catalogq.operators.orphans import orphan_rows
from catalogq.plans.raw import CTE_COMMENTS, CTE_PRODUCTS, raw_comments, raw_products
from catalogq.session import cut, table

# --- SQL pieces ------------------------------------------------------------------------------------------------------

_NUM = "TRY_CAST(trim({c}) AS DECIMAL(38,10))"
_INT = "CASE WHEN {n} >= 0 AND {n} = floor({n}) AND {n} <= 9223372036854775807 THEN CAST({n} AS BIGINT) END"


def _num(c: str) -> str:
    return _NUM.format(c=c)


def _int(c: str) -> str:
    return _INT.format(n=_num(c))


def _why(c: str) -> str:
    n = _num(c)
    return f"CASE WHEN {n} IS NULL AND NOT regexp_full_match(trim({c}), '[0-9]{{20,}}') THEN 'number' WHEN {n} <> floor({n}) THEN 'fraction' WHEN {n} < 0 THEN 'negative' WHEN {n} IS NULL OR {n} > CAST(9223372036854775807 AS DECIMAL(38,10)) THEN 'range' END"


def _text(c: str, sentinel: bool = False) -> str:
    return f"CASE WHEN trim({c}) = '' {f'''OR {c} = 'nan' ''' if sentinel else ''}THEN NULL ELSE {c} END"


_BOOL = "CASE {c} WHEN 'True' THEN TRUE WHEN 'False' THEN FALSE END"
_MONTHS = ", ".join(f"'{m}'" for m in ["فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند"])
TYPED_PRODUCTS = f"""{CTE_PRODUCTS},
typed_products AS (
  SELECT *, {_int('id')} AS product_id, {_int('"Rate_cnt"')} AS rate_count_, CASE WHEN {_num('"Rate"')} BETWEEN 0 AND 100 THEN CAST({_num('"Rate"')} AS DOUBLE) END AS rate_,
    {_text('title_fa')} AS t_title_fa, {_text('"Category1"')} AS t_category1, {_text('"Category2"')} AS t_category2, {_text('"Brand"')} AS brand_, {_text('sub_category')} AS t_sub_category
  FROM raw_products),
products AS (
  SELECT source_row, product_id, t_title_fa AS title_fa, t_category1 AS category1, t_category2 AS category2, brand_ AS brand, CASE WHEN rate_ = 0 AND rate_count_ = 0 THEN NULL ELSE rate_ END AS rate,
    rate_count_ AS rate_count, t_sub_category AS sub_category, rate_ = 0 AND rate_count_ = 0 AS is_unrated, rate_ = 0 AND rate_count_ > 0 AS inconsistent_zero_rate
  FROM typed_products WHERE product_id IS NOT NULL AND rate_ IS NOT NULL AND rate_count_ IS NOT NULL)"""
TYPED_OFFERS = f"""{CTE_PRODUCTS},
typed_offers AS (
  SELECT *, {_int('id')} AS product_id, {_text('"Seller"')} AS seller_, {_int('"Price"')} AS price_, {_BOOL.format(c='"Is_Fake"')} AS fake, {_int('min_price_last_month')} AS history
  FROM raw_products),
offers_ok AS (
  SELECT source_row, product_id, seller_ AS seller, nullif(price_, 0) AS price_raw, CAST(nullif(price_, 0) AS DECIMAL(20,0)) / 10 AS toman, fake AS is_fake, nullif(history, 0) AS min_price_last_month,
    coalesce(history = 0, FALSE) AS missing_price_history, coalesce(price_ = 0, FALSE) AS invalid_price, id, "Price" AS p, "Seller" AS s, "Is_Fake" AS f, typed_offers.min_price_last_month AS h
  FROM typed_offers WHERE product_id IS NOT NULL AND price_ IS NOT NULL AND fake IS NOT NULL AND (history IS NOT NULL OR trim(typed_offers.min_price_last_month) = ''))"""
_S = {c: _text(c, True) for c in T.SENTINEL_RULES}
_PARTS = "regexp_extract(created_at, '^([0-9]{{1,2}}) (.+) ([0-9]{{4}})$', {i})"
TYPED_COMMENTS = f"""{CTE_COMMENTS},
dated AS (
  SELECT *, CASE WHEN regexp_full_match(created_at, '[0-9]{{1,2}} [^ ]+ [0-9]{{4}}') THEN TRY_CAST(split_part(created_at, ' ', 1) AS INTEGER) END AS jd,
    list_position([{_MONTHS}], split_part(created_at, ' ', 2)) AS jm, CASE WHEN regexp_full_match(created_at, '[0-9]{{1,2}} [^ ]+ [0-9]{{4}}') THEN TRY_CAST(split_part(created_at, ' ', 3) AS INTEGER) END AS jy
  FROM raw_comments),
checked_dates AS (
  SELECT *, jd IS NOT NULL AND jm > 0 AND jy BETWEEN 1 AND 9377 AND jd BETWEEN 1 AND CASE WHEN jm <= 6 THEN 31 WHEN jm <= 11 THEN 30 WHEN jy % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) THEN 30 ELSE 29 END AS date_ok FROM dated),
typed_comments AS (
  SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _S.items())}), {_int('id')} AS comment_id, {_int('product_id')} AS product, {_BOOL.format(c='is_buyer')} AS buyer,
    CASE WHEN date_ok THEN printf('%04d-%02d-%02d', jy, jm, jd) END AS created_at_jalali,
    CASE WHEN date_ok THEN CAST(DATE '0622-03-21' + CAST((jy - 1) * 365 + (8 * (jy - 1) + 29) // 33 + (jm - 1) * 31 - greatest(0, jm - 7) + jd - 1 AS INTEGER) AS DATE) END AS created_at_gregorian,
    {_num('rate')} AS r, CASE WHEN contains(rate, '.') THEN length(split_part(trim(rate), '.', 2)) ELSE 0 END AS scale, {_int('likes')} AS likes_, {_int('dislikes')} AS dislikes_, trim(rate) AS rate_t
  FROM checked_dates),
rated AS (
  SELECT *, CASE WHEN trim(rate) = '' THEN 'blank' WHEN r IS NULL OR r < 0 OR r > 5 THEN 'number' WHEN r = 0 THEN 'zero' WHEN scale > 2 THEN 'scale' END AS rate_reason FROM typed_comments),
comments_ok AS (
  SELECT source_row, comment_id, product AS product_id, title, body, created_at AS created_at_raw, created_at_jalali, created_at_gregorian,
    CASE WHEN rate_reason IS NULL THEN CAST(r AS DECIMAL(3,2)) END AS rate, CASE WHEN rate_reason IS NULL THEN rate_t END AS rate_text, coalesce(rate_reason = 'zero', FALSE) AS is_unrated,
    coalesce(rate_reason IN ('number', 'scale'), FALSE) AS invalid_rate, recommendation_status, buyer AS is_buyer, advantages, disadvantages, likes_ AS likes, dislikes_ AS dislikes, seller_title, seller_code, true_to_size_rate
  FROM rated WHERE comment_id IS NOT NULL AND product IS NOT NULL AND buyer IS NOT NULL AND date_ok)"""

# --- parsing ---------------------------------------------------------------------------------------------------------


def parse_ids(spark: SparkSession, d: str) -> DataFrame:
    return T.parsed(raw_products(spark, d), ["id"], dict(zip(("value", "reason"), T.integer("id")))).select("source_row", "value", "reason")


def parse_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.parsed(raw_comments(spark, d), ["likes"], dict(zip(("value", "reason"), T.integer("likes", optional=True)))).select("source_row", "value", "reason")


def parse_booleans(spark: SparkSession, d: str) -> DataFrame:
    return raw_products(spark, d).select("source_row", T.strict_boolean(F.col("Is_Fake")).alias("value"))


def product_rate_rules(spark: SparkSession, d: str) -> DataFrame:
    return T.product_candidates(raw_products(spark, d)).select("source_row", "rate", "rate_count", "is_unrated", "inconsistent_zero_rate")


def comment_rate_rules(spark: SparkSession, d: str) -> DataFrame:
    return T.parsed(raw_comments(spark, d), [], dict(zip(("value", "reason"), T.rate("rate", 5, 2))), ["rate"]).select("source_row", "value", "reason")


def text_sentinels(spark: SparkSession, d: str) -> DataFrame:
    return raw_comments(spark, d).select("source_row", *[T.clean_text(F.col(c), "nan").alias(c) for c in T.SENTINEL_RULES])


def jalali_parse(spark: SparkSession, d: str) -> DataFrame:
    iso, day, _ = T.jalali.parsed(F.col("created_at"))
    return raw_comments(spark, d).select("source_row", iso.alias("created_at_jalali"), day.alias("created_at_gregorian"))


def product_transform(spark: SparkSession, d: str) -> DataFrame:
    return T.product_candidates(raw_products(spark, d))


def offer_transform(spark: SparkSession, d: str) -> DataFrame:
    o = T.offer_candidates(raw_products(spark, d))
    return o.select("source_row", *[F.col(f"o_{c}").alias(c) for c in ("product_id", "seller", "price_raw", "is_fake", "min_price_last_month", "missing_price_history", "invalid_price")], F.col("o_price_toman").cast("double").alias("price_toman"))


def comment_transform(spark: SparkSession, d: str) -> DataFrame:
    return T.comment_candidates(raw_comments(spark, d)).drop("canonical_digest", "completeness").withColumn("rate", F.col("rate").cast("double"))


# --- duplicates and fingerprints -------------------------------------------------------------------------------------


def exact_row_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_of_equal(raw_products(spark, d), T.PRODUCT_COLUMNS, "source_row").select("source_row", "copies")


def distinct_products(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_of_equal(raw_products(spark, d), T.PRODUCT_COLUMNS, "source_row").drop("copies")


def distinct_comments(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_of_equal(raw_comments(spark, d), T.COMMENT_COLUMNS, "source_row").drop("copies")


def dup_id_metrics(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_id_figures(table(spark, d, "comment_candidates"), "comment_id")


def duplicated_rows(spark: SparkSession, d: str) -> DataFrame:
    return dedup.all_copies(table(spark, d, "comment_candidates").select("source_row", "comment_id"), ["comment_id"])


def offer_dedup(spark: SparkSession, d: str) -> DataFrame:
    o = T.offer_candidates(raw_products(spark, d))
    return dedup.first_of_equal(o, T.OFFER_CONTENT, "source_row").select("source_row", "copies")


def offer_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return raw_products(spark, d).select("source_row", G.text_fingerprint([F.col(c) for c in T.OFFER_CONTENT]).alias("fingerprint"))


def raw_digest(spark: SparkSession, d: str) -> DataFrame:
    """The informational digest of each raw record."""
    return raw_products(spark, d).select("source_row", G.exact_digest([F.col(c) for c in T.PRODUCT_COLUMNS]).alias("digest"))


def offer_id_collisions(spark: SparkSession, d: str) -> DataFrame:
    o = T.offer_candidates(raw_products(spark, d))
    return counters.id_collisions(o, G.text_fingerprint([F.col(c) for c in T.OFFER_CONTENT]), T.OFFER_CONTENT)


_CORE_TAGS = {"rate": "F", "rate_count": "I"}


def core_digest(spark: SparkSession, d: str) -> DataFrame:
    return T.product_candidates(raw_products(spark, d)).select("source_row", T.core_digest().alias("digest"))


def _frame_sql(c: str, tag: str) -> str:
    null = "'N'::BLOB" if tag == "V" else "'N'::BLOB || unhex('0000000000000000')"
    return f"CASE WHEN {c} IS NULL THEN {null} ELSE '{tag}'::BLOB || unhex(lpad(hex(octet_length(encode(CAST({c} AS VARCHAR)))), 16, '0')) || encode(CAST({c} AS VARCHAR)) END"


def _digest_sql(parts: list[tuple[str, str]]) -> str:
    return "sha256(" + " || ".join(_frame_sql(c, t) for c, t in parts) + ")"


_CORE_SQL = _digest_sql([(c, _CORE_TAGS.get(c, "S")) for c in T.PRODUCT_CORE])


# --- canonical rows --------------------------------------------------------------------------------------------------


def _products(spark: SparkSession, d: str) -> DataFrame:
    return T.product_candidates(raw_products(spark, d)).withColumn("completeness", C.completeness(T.PRODUCT_CORE)).withColumn("digest", T.core_digest())


def _product_rank():
    return [C.descending(F.col("rate_count")), C.descending(F.col("completeness")), F.col("digest"), F.col("source_row")]


def canonical_products(spark: SparkSession, d: str) -> DataFrame:
    won = C.canonical(_products(spark, d), "product_id", T.PRODUCT_CORE, _product_rank(), [F.col("source_row")])
    return won.select("product_id", *T.PRODUCT_CORE, "is_unrated", "inconsistent_zero_rate", (F.col("variants") > 1).alias("core_attribute_conflict"), F.col("source_row").alias("canonical_source_row"))


def product_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = C.conflicts(_products(spark, d), "product_id", "source_row", T.PRODUCT_CORE, _product_rank(), [F.col("source_row")])
    return c.select("product_id", "source_row", "canonical_row", "completeness", "digest", "selected")


_CANON_PRODUCTS = f"""WITH {TYPED_PRODUCTS},
c AS (SELECT *, CAST((title_fa IS NOT NULL) AS BIGINT) + CAST((category1 IS NOT NULL) AS BIGINT) + CAST((category2 IS NOT NULL) AS BIGINT) + CAST((brand IS NOT NULL) AS BIGINT)
  + CAST((rate IS NOT NULL) AS BIGINT) + CAST((rate_count IS NOT NULL) AS BIGINT) + CAST((sub_category IS NOT NULL) AS BIGINT) AS completeness, {_CORE_SQL} AS digest FROM products),
v AS (SELECT *, row_number() OVER (PARTITION BY product_id, title_fa, category1, category2, brand, rate, rate_count, sub_category ORDER BY source_row) AS k FROM c),
w AS (SELECT *, count(*) OVER (PARTITION BY product_id) AS variants,
  row_number() OVER (PARTITION BY product_id ORDER BY rate_count DESC NULLS LAST, completeness DESC, digest, source_row) AS place,
  first_value(source_row) OVER (PARTITION BY product_id ORDER BY rate_count DESC NULLS LAST, completeness DESC, digest, source_row) AS canonical_row FROM v WHERE k = 1)"""

_CONTENT = [c if c != "rate" else "rate_text" for c in T.COMMENT_CONTENT]


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return T.comment_candidates(raw_comments(spark, d))


def _comment_rank():
    return [C.descending(F.col("completeness")), F.col("canonical_digest"), F.col("source_row")]


def canonical_comments(spark: SparkSession, d: str) -> DataFrame:
    won = C.canonical(_comments(spark, d), "comment_id", _CONTENT, _comment_rank())
    return won.select("comment_id", "product_id", "title", "body", "created_at_gregorian", F.col("rate").cast("double").alias("rate"), "completeness", "canonical_digest", (F.col("variants") > 1).alias("comment_id_conflict"), F.col("source_row").alias("canonical_source_row"))


def canonical_comment_figures(spark: SparkSession, d: str) -> DataFrame:
    c = _comments(spark, d).withColumn("__content", G.exact_digest([F.col(c).cast("string") for c in _CONTENT]))
    return counters.candidate_figures(c.select("comment_id", "__content"), "comment_id", "__content")


def comment_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = C.conflicts(_comments(spark, d), "comment_id", "source_row", _CONTENT, _comment_rank())
    return c.select("comment_id", "source_row", "canonical_row", "completeness", "selected")


_MAPPED = [c if c in T.SENTINEL_RULES else f"CASE WHEN trim({c}) = '' THEN NULL ELSE {c} END" for c in T.COMMENT_COLUMNS[1:]]
_CANON_COMMENTS = f"""WITH {TYPED_COMMENTS},
mapped AS (SELECT source_row, {' + '.join(f'CAST(({x}) IS NOT NULL AS BIGINT)' for x in _MAPPED)} AS completeness, {_digest_sql([(f'({x})', 'S') for x in _MAPPED])} AS canonical_digest FROM typed_comments),
c AS (SELECT * FROM comments_ok JOIN mapped USING (source_row)),
v AS (SELECT *, row_number() OVER (PARTITION BY comment_id, {', '.join(_CONTENT)} ORDER BY completeness DESC, canonical_digest, source_row) AS k, count(*) OVER (PARTITION BY comment_id, {', '.join(_CONTENT)}) AS copies FROM c),
w AS (SELECT *, count(*) OVER (PARTITION BY comment_id) AS variants, row_number() OVER (PARTITION BY comment_id ORDER BY completeness DESC, canonical_digest, source_row) AS place,
  first_value(source_row) OVER (PARTITION BY comment_id ORDER BY completeness DESC, canonical_digest, source_row) AS canonical_row FROM v WHERE k = 1)"""


def offers_without_product(spark: SparkSession, d: str) -> DataFrame:
    o = cut(T.offer_candidates(raw_products(spark, d)).select("source_row", F.col("o_product_id").alias("product_id")))  # read three times
    return orphan_rows(o, canonical_products(spark, d).select("product_id"), [("product_id", "product_id")])


def orphan_comments(spark: SparkSession, d: str) -> DataFrame:
    c = cut(canonical_comments(spark, d).select("comment_id", "product_id", "canonical_source_row"))  # read three times
    return orphan_rows(c, table(spark, d, "final_products").select("product_id"), [("product_id", "product_id")])


def first_orphan_products(spark: SparkSession, d: str) -> DataFrame:
    """The 20 first product ids of comments that no product has, in order of appearance; a report."""
    return profile.first_missing(table(spark, d, "comment_candidates"), table(spark, d, "final_products").select("product_id"), "product_id", "source_row", 20)


def comment_date_range(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "final_products").select("product_id")
    per = canonical_comments(spark, d).groupBy("product_id").agg(F.min("created_at_gregorian").alias("a"), F.max("created_at_gregorian").alias("b"))
    return per.join(ids, "product_id", "left_semi").agg(F.min("a").alias("first_day"), F.max("b").alias("last_day"))


# --- evidence --------------------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, d: str):
    products, comments = distinct_products(spark, d), distinct_comments(spark, d)
    return [("products", T.product_rows(products), F.col("p_product_id"), T.PRODUCT_COLUMNS), ("offers", T.offer_rows(products), F.col("o_product_id"), T.PRODUCT_COLUMNS), ("comments", T.comment_rows(comments), F.col("c_comment_id"), T.COMMENT_COLUMNS)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_audit(spark: SparkSession, d: str) -> DataFrame:
    return _union([evidence.audit_records(df, "source_row", e, n).drop("position") for n, df, e, _ in _sides(spark, d)])


def _product_run(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The tables of a run over the products file; typed rows are written once, as several figures read them."""
    rows = dedup.first_of_equal(raw_products(spark, d), T.PRODUCT_COLUMNS, "source_row")
    products, offers = cut(T.product_rows(rows)), cut(T.offer_rows(rows))
    p = products.where("NOT fatal").select("source_row", *[F.col(c).alias(c[2:]) for c in products.columns if c.startswith("p_")])
    ranked = p.withColumn("completeness", C.completeness(T.PRODUCT_CORE)).withColumn("digest", T.core_digest())
    won = C.canonical(ranked, "product_id", T.PRODUCT_CORE, _product_rank(), [F.col("source_row")]).select("product_id", "variants")
    distinct = dedup.first_rows(offers.where("NOT fatal").select("source_row", *T.OFFER_CONTENT, F.col("o_product_id").alias("product_id"), F.col("o_price_raw").alias("price_raw")), T.OFFER_CONTENT, "source_row")
    final = cut(distinct.join(won.select("product_id"), "product_id", "left_semi").select("source_row", "product_id", "price_raw"))
    return {"products": products, "offers": offers, "canonical": won, "distinct_offers": distinct, "final_offers": quantile.above_threshold(final, "price_raw", 999, "high_price_review")}


def rule_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of both runs with its events or what its figure is, zeros included."""
    of_products = counters.product_run_counts(**_product_run(spark, d))
    comments = cut(T.comment_rows(dedup.first_of_equal(raw_comments(spark, d), T.COMMENT_COLUMNS, "source_row")))
    won = cut(C.canonical(T.ranked_comments(comments), "comment_id", _CONTENT, _comment_rank()).select("comment_id", "product_id", "variants"))
    orphans = orphan_rows(won, table(spark, d, "final_products").select("product_id"), [("product_id", "product_id")])
    of_comments = counters.comment_run_counts(comments, won, orphans)
    return _union([n.select(F.lit(side).alias("side"), "rule_id", "n") for side, n in (("products", of_products), ("comments", of_comments))])


def offer_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """One row: distinct offers, products with several of them, offers beyond the first of a product."""
    o = T.offer_candidates(raw_products(spark, d))
    distinct = dedup.first_rows(o.select("source_row", *T.OFFER_CONTENT, F.col("o_product_id").alias("product_id")), T.OFFER_CONTENT, "source_row")
    return dedup.duplicate_id_figures(distinct, "product_id")


def aggregate_transformations(spark: SparkSession, d: str) -> DataFrame:
    return _union([evidence.field_counts(df, n) for n, df, _, _ in _sides(spark, d)])


def quarantine_rows(spark: SparkSession, d: str) -> DataFrame:
    q = _union([evidence.quarantine(df, "source_row", e, n, raw) for n, df, e, raw in _sides(spark, d)])
    return q.withColumn("rule_ids", F.array_join("rule_ids", ","))


def quarantine_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return _union([evidence.quarantine_counts(evidence.quarantine(df, "source_row", e, n, raw)).select(F.lit(n).alias("dataset"), "rule_id", "n") for n, df, e, raw in _sides(spark, d)])


def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Rows in, exact repeats, distinct, accepted and quarantined per side; the equations hold or ``balanced`` is false."""
    parts = []
    for name, raw, cols, typed in (("products", raw_products(spark, d), T.PRODUCT_COLUMNS, T.product_rows), ("offers", raw_products(spark, d), T.PRODUCT_COLUMNS, T.offer_rows), ("comments", raw_comments(spark, d), T.COMMENT_COLUMNS, T.comment_rows)):
        n = typed(dedup.first_of_equal(raw, cols, "source_row")).agg(
            F.sum("copies").alias("rows"), F.sum(F.col("copies") - 1).alias("repeats"), F.count(F.lit(1)).alias("distinct_rows"), F.count_if(~F.col("fatal")).alias("accepted"), F.count_if("fatal").alias("quarantined")
        )
        balanced = (F.col("rows") == F.col("repeats") + F.col("distinct_rows")) & (F.col("distinct_rows") == F.col("accepted") + F.col("quarantined"))
        parts.append(n.select(F.lit(name).alias("side"), "*", balanced.alias("balanced")))
    return _union(parts)


_DISTINCT = """distinct_products AS (SELECT min(source_row) AS source_row, count(*) AS copies, * EXCLUDE (source_row) FROM raw_products GROUP BY ALL),
distinct_comments AS (SELECT min(source_row) AS source_row, count(*) AS copies, * EXCLUDE (source_row) FROM raw_comments GROUP BY ALL)"""


def _blank(c: str) -> str:
    return f"trim({c}) = ''"


def _said_sql(reason: str, texts: dict[str, str]) -> str:
    return f"CASE {reason} {' '.join(f"WHEN '{k}' THEN '{t}'" for k, t in texts.items())} END"


def _event_sql() -> str:
    """All events of all sides as rows: side, source_row, field, raw_value, rule_id, detail, fatal, row_level."""
    rate, cnt, jrate = _num('"Rate"'), _int('"Rate_cnt"'), "TRY_CAST(trim(rate) AS DECIMAL(38,10))"
    usable = f"{rate} BETWEEN 0 AND 100 AND {cnt} IS NOT NULL"
    id_says, count_says = lambda c: _said_sql(_why(c), rules.ID_SAYS), lambda c: _said_sql(_why(c), rules.COUNT_SAYS)
    boolean_says, rate_says = f"'{rules.BOOLEAN_SAYS}'", f"'{rules.RATE_SAYS}'"
    p = [("id", "ID-002", f"{_why('id')} IS NOT NULL", id_says("id"), 1), ('"Rate_cnt"', "PRD-007", f"""{_why('"Rate_cnt"')} IS NOT NULL""", count_says('"Rate_cnt"'), 1), ('"Rate"', "PRD-004", f"NOT coalesce({rate} BETWEEN 0 AND 100, FALSE)", rate_says, 1), ('"Rate"', "PRD-005", f"{usable} AND {rate} = 0 AND {cnt} = 0", "NULL", 0), ('"Rate"', "PRD-006", f"{usable} AND {rate} = 0 AND {cnt} > 0", "NULL", 0)]
    p += [(c, "TXT-001", _blank(c), "NULL", 0) for c in ("title_fa", '"Category1"', '"Category2"', '"Brand"', "sub_category")]
    o = [("id", "ID-002", f"{_why('id')} IS NOT NULL", id_says("id"), 1), ('"Is_Fake"', "BOOL-002", """"Is_Fake" NOT IN ('True', 'False')""", boolean_says, 1), ('"Price"', "OFF-004", f"""{_why('"Price"')} IS NOT NULL""", count_says('"Price"'), 1), ("min_price_last_month", "OFF-008", f"NOT {_blank('min_price_last_month')} AND {_why('min_price_last_month')} IS NOT NULL", count_says("min_price_last_month"), 1), ('"Price"', "OFF-003", f"""{_int('"Price"')} = 0""", "NULL", 0), ("min_price_last_month", "OFF-007", f"{_int('min_price_last_month')} = 0", "NULL", 0), ('"Seller"', "TXT-001", _blank('"Seller"'), "NULL", 0)]
    jd, jm, jy = "TRY_CAST(split_part(created_at, ' ', 1) AS INTEGER)", f"list_position([{_MONTHS}], split_part(created_at, ' ', 2))", "TRY_CAST(split_part(created_at, ' ', 3) AS INTEGER)"
    why_date = f"CASE WHEN NOT regexp_full_match(created_at, '[0-9]{{1,2}} [^ ]+ [0-9]{{4}}') OR coalesce({jm}, 0) = 0 THEN 'form' WHEN {jy} NOT BETWEEN 1 AND 9377 THEN 'year' WHEN {jd} NOT BETWEEN 1 AND CASE WHEN {jm} <= 6 THEN 31 WHEN {jm} <= 11 THEN 30 WHEN {jy} % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) THEN 30 ELSE 29 END THEN 'day' END"
    scale = "CASE WHEN contains(rate, '.') THEN length(split_part(trim(rate), '.', 2)) ELSE 0 END"
    why_rate = f"CASE WHEN {_blank('rate')} THEN 'blank' WHEN {jrate} IS NULL OR {jrate} < 0 OR {jrate} > 5 THEN 'number' WHEN {jrate} = 0 THEN 'zero' WHEN {scale} > 2 THEN 'scale' END"
    c = [("id", "ID-002", f"{_why('id')} IS NOT NULL", id_says("id"), 1), ("product_id", "ID-002", f"{_why('product_id')} IS NOT NULL", id_says("product_id"), 1), ("is_buyer", "BOOL-002", "is_buyer NOT IN ('True', 'False')", boolean_says, 1), ("created_at", "DATE-003", f"{why_date} IS NOT NULL", _said_sql(why_date, rules.DATE_SAYS), 1), ("rate", "COM-005", f"{why_rate} = 'zero'", "NULL", 0), ("rate", "COM-006", f"{why_rate} = 'number'", "NULL", 0), ("rate", "COM-021", f"{why_rate} = 'scale'", "NULL", 0)]
    c += [(x, "COM-012", f"NOT {_blank(x)} AND {_why(x)} IS NOT NULL", count_says(x), 0) for x in ("likes", "dislikes")]
    for x, rule in T.SENTINEL_RULES.items():
        c.append((x, rule, f"{x} = 'nan'", "NULL", 0))
        c += [(x, "COM-011", f"{x} = ''", "NULL", 0), (x, "TXT-001", f"{_blank(x)} AND {x} <> ''", "NULL", 0), (x, "COM-010", f"NOT {_blank(x)} AND {x} <> 'nan'", "NULL", 0)] if x == "seller_code" else [(x, "TXT-001", _blank(x), "NULL", 0)]
    c.append(("body", "COM-009", f"{_blank('body')} OR body = 'nan'", "NULL", 0))
    selects = []
    for side, t, found in (("products", "distinct_products", p), ("offers", "distinct_products", o), ("comments", "distinct_comments", c)):
        for place, (f, rule, when, detail, fatal) in enumerate(found):
            entity = _int("id")
            name = f.strip('"')
            selects.append(f"SELECT '{side}' AS side, source_row, {entity} AS entity_id, '{name}' AS field, {f} AS raw_value, '{rule}' AS rule_id, {detail} AS detail, {place} AS place, {fatal} = 1 AS fatal, {rules.CATALOGUE[rule].row_level} AS row_level FROM {t} WHERE {when}")
    return "\n  UNION ALL ".join(selects)


_EVENTS = f"WITH {CTE_PRODUCTS}, {CTE_COMMENTS}, {_DISTINCT},\nevents AS (\n  {_event_sql()})"
_INFO = ", ".join(f"('{k}', '{i.action}', '{i.severity}', {i.lossy})" for k, i in rules.CATALOGUE.items())
_ALL_RULES = ", ".join(f"('{s}', '{r}')" for s, rs in (("products", rules.PRODUCT_RUN_RULES), ("comments", rules.COMMENT_RUN_RULES)) for r in rs)


def _reconciled(side: str, t: str) -> str:
    return f"""SELECT '{side}' AS side, CAST(sum(copies) AS BIGINT) AS rows, CAST(sum(copies - 1) AS BIGINT) AS repeats, count(*) AS distinct_rows, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS quarantined, TRUE AS balanced
  FROM (SELECT *, source_row IN (SELECT source_row FROM events WHERE side = '{side}' AND fatal) AS bad FROM {t})"""


# --- quantiles -------------------------------------------------------------------------------------------------------


def price_p999_flag(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "offers").select("source_row", "price_raw")
    return quantile.above_threshold(o, "price_raw", 999, "high_price_review")


def price_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return quantile.nearest_rank(table(spark, d, "offers"), [], "price_raw", [500, 950, 990, 999])


def group_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "product_candidates").select("source_row", "sub_category")
    return quantile.nearest_rank(table(spark, d, "offers").join(p, "source_row"), ["sub_category"], "price_raw", [100, 500, 900, 999])


def _nearest_sql(source: str, groups: list[str], mille: list[int]) -> str:
    by = f"PARTITION BY {', '.join(groups)} " if groups else ""
    cols = "".join(f"{g}, " for g in groups)
    return f"""WITH s AS (SELECT {cols}price_raw, row_number() OVER ({by}ORDER BY price_raw) AS k, count(*) OVER ({by}) AS n FROM {source} WHERE price_raw IS NOT NULL),
q AS (SELECT *, unnest({mille}) AS per_mille FROM s)
SELECT {cols}per_mille, n, k AS rank, price_raw AS threshold FROM q WHERE k = greatest(1, (per_mille * n + 999) // 1000)"""


# --- inventory -------------------------------------------------------------------------------------------------------


def scope_inventory(spark: SparkSession, d: str) -> DataFrame:
    offers = table(spark, d, "offers").select("product_id", F.col("price_raw").alias("price"))
    comments = table(spark, d, "comment_candidates").select("product_id", "body", "is_buyer", "rate")
    return scopes.inventory(table(spark, d, "final_products"), offers, comments, ["category1", "category2"])


def inventory_report(spark: SparkSession, d: str) -> DataFrame:
    """The inventory with the 23 columns of the published report."""
    return scopes.report(scope_inventory(spark, d))


def scope_invariants(spark: SparkSession, d: str) -> DataFrame:
    return scopes.broken_invariants(scope_inventory(spark, d)).select("level", "scope_category1", "scope_category2")


def coherent_scopes_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 20 pairs of categories best covered by comments; a top-k report."""
    inv = scope_inventory(spark, d).where("level = 2")
    order = [F.col("comments").desc(), F.col("commented_products").desc(), F.col("products").desc(), "scope_category1", "scope_category2"]
    top = scopes.top_scopes(inv, {"products": 20, "comments": 20, "coverage_percent": 10.0, "brands": 2}, (F.col("scope_category2"), ["متفرقه", "سایر"]), order, 20)
    return top.select("scope_category1", "scope_category2", "products", "comments", "commented_products", "brands")


def _interp(list_sql: str, p: float) -> str:
    at = f"((len({list_sql}) - 1) * CAST({p} AS DOUBLE))"
    low = f"CAST(floor({at}) AS BIGINT)"
    a, b = f"CAST(list_sort({list_sql})[{low} + 1] AS DOUBLE)", f"CAST(list_sort({list_sql})[least({low} + 2, len({list_sql}))] AS DOUBLE)"
    return f"{a} + ({b} - {a}) * ({at} - {low})"


_INVENTORY = f"""WITH pc AS (SELECT product_id, count(*) AS comments, count(body) AS bodies, count(*) FILTER (is_buyer) AS buyers, count(*) FILTER (rate > 0) AS ratings FROM comment_candidates GROUP BY 1),
po AS (SELECT product_id, min(price_raw) AS price FROM offers WHERE price_raw > 0 GROUP BY 1),
p AS (SELECT f.product_id, category1, category2, brand, coalesce(comments, 0) AS comments, coalesce(bodies, 0) AS bodies, coalesce(buyers, 0) AS buyers, coalesce(ratings, 0) AS ratings, price
  FROM final_products f LEFT JOIN pc USING (product_id) LEFT JOIN po USING (product_id)),
s AS (SELECT 1 AS level, category1 AS c1, NULL AS c2, * FROM p WHERE category1 IS NOT NULL UNION ALL SELECT 2, category1, category2, * FROM p WHERE category1 IS NOT NULL AND category2 IS NOT NULL),
g AS (SELECT level, c1, c2, count(*) AS products, count(DISTINCT brand) AS brands, CAST(sum(comments) AS BIGINT) AS comments, count(*) FILTER (comments > 0) AS commented_products, CAST(sum(bodies) AS BIGINT) AS bodies,
  CAST(sum(buyers) AS BIGINT) AS buyers, CAST(sum(ratings) AS BIGINT) AS ratings, count(price) AS priced_products, {', '.join(f'count(*) FILTER (comments >= {k}) AS products_with_{k}' for k in scopes.STEPS)},
  list(price) FILTER (price IS NOT NULL) AS prices, list(comments) FILTER (comments > 0) AS depths FROM s GROUP BY level, c1, c2),
inv AS (SELECT level, c1 AS scope_category1, c2 AS scope_category2, products, brands, comments, commented_products, bodies, buyers, ratings, priced_products, {', '.join(f'products_with_{k}' for k in scopes.STEPS)},
  products - commented_products AS uncommented_products, {_interp('prices', 0.05)} AS price_p05, {_interp('prices', 0.5)} AS price_p50, {_interp('prices', 0.95)} AS price_p95, {_interp('depths', 0.5)} AS comments_p50, {_interp('depths', 0.95)} AS comments_p95,
  CAST(commented_products * 100 AS DOUBLE) / products AS coverage_percent, CAST(priced_products * 100 AS DOUBLE) / products AS price_coverage_percent FROM g)"""

# --- profiling -------------------------------------------------------------------------------------------------------

_PROFILED = ["id", "Rate", "Rate_cnt", "Price", "Brand", "Category1", "Seller", "Is_Fake"]


def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(raw_products(spark, d), _PROFILED).withColumn("total", F.round("total", 2))


def top_values(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most frequent values per column; a top-k report."""
    return profile.top_values(raw_products(spark, d), ["Brand", "Category1", "Is_Fake"], "source_row", 20)


def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(raw_products(spark, d), ["Category1", "Is_Fake", "Brand", "sub_category"])


def missing_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.column_profile(table(spark, d, "comment_candidates"), ["title", "body", "rate", "likes", "seller_code"]).select("column", "missing")


def range_violations(spark: SparkSession, d: str) -> DataFrame:
    return profile.outside(raw_products(spark, d), {"Rate": (0, 100), "Rate_cnt": (0, 1000)})


def price_validation(spark: SparkSession, d: str) -> DataFrame:
    return profile.number_classes(raw_products(spark, d), "Price")


def offer_variation(spark: SparkSession, d: str) -> DataFrame:
    return dedup.variation(raw_products(spark, d), "id", {"sellers": [F.col("Seller")], "prices": [F.col("Price")], "cores": [F.col(c) for c in ("title_fa", "Category1", "Category2", "Brand", "sub_category")]})


def join_coverage(spark: SparkSession, d: str) -> DataFrame:
    return profile.coverage(table(spark, d, "comment_candidates"), table(spark, d, "final_products"), "product_id")


def products_of_comments(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "comment_candidates").select("product_id").distinct()
    return table(spark, d, "final_products").select("product_id", "title_fa").join(ids, "product_id", "left_semi")


def crosstab_margins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "comment_candidates").select(F.col("rate").cast("string").alias("rate"), "recommendation_status")
    return profile.crosstab(c, "rate", "recommendation_status")


def describe_price(spark: SparkSession, d: str) -> DataFrame:
    t = profile.described(table(spark, d, "offers").select("price_raw"), "price_raw", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return t.select("n", F.round("deviation").alias("deviation"), *[F.round(c, 2).alias(c) for c in ("mean", "least", "greatest", "p50", "p95", "p99")])


def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return profile.histogram(table(spark, d, "product_candidates"), F.col("rate"), 0.0, 100.0, 20)


def nlargest(spark: SparkSession, d: str) -> DataFrame:
    """The 10 greatest prices; a top-k report."""
    return profile.largest(table(spark, d, "offers").select("source_row", "product_id", "price_raw"), "price_raw", 10, ["source_row"])


def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def date_shape_counts(spark: SparkSession, d: str) -> DataFrame:
    shape = F.regexp_replace(F.regexp_replace("created_at", "[0-9]", "9"), r"\p{L}+", "A")
    return raw_comments(spark, d).groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def comments_by_jalali_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comment_candidates").groupBy(F.left("created_at_jalali", F.lit(4)).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def code_title_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "comment_candidates").where("seller_code IS NOT NULL AND seller_title IS NOT NULL").groupBy("seller_code", "seller_title").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("seller_code").agg(F.count(F.lit(1)).alias("titles"))
    return per.groupBy("titles").agg(F.count(F.lit(1)).alias("codes"))


def occurrence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return dedup.occurrence_histogram(table(spark, d, "comment_candidates"), "comment_id")


def field_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """Per field, the comment ids whose rows differ in it."""
    fields = ["title", "body", "rate", "likes", "is_buyer"]
    return dedup.variation(table(spark, d, "comment_candidates"), "comment_id", {f"{f}_differs": [F.col(f)] for f in fields})


def price_history_relation(spark: SparkSession, d: str) -> DataFrame:
    p, h = F.col("price_raw"), F.col("min_price_last_month")
    kind = F.when(p.isNull() | h.isNull(), "unknown").when(p < h, "below").when(p == h, "equal").otherwise("above")
    return table(spark, d, "offers").groupBy(kind.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three products of each sub-category; a sampling operator."""
    return profile.stratified_sample(table(spark, d, "product_candidates").select("source_row", "product_id", "sub_category"), ["sub_category"], "source_row", 3)


def lexical_classes(spark: SparkSession, d: str) -> DataFrame:
    return profile.lexical_classes(raw_comments(spark, d), "rate")


def sentinel_crosstab(spark: SparkSession, d: str) -> DataFrame:
    c = raw_comments(spark, d).select((F.col("title") == "nan").alias("title_nan"), (F.col("body") == "nan").alias("body_nan"))
    return profile.crosstab(c, "title_nan", "body_nan")


_NAMED = [("آشپزخانه", None), ("ماهیگیری", "چرخ و نخ"), ("بی‌نام", None)]


def named_scopes(spark: SparkSession, d: str) -> DataFrame:
    return scopes.named_scopes(scope_inventory(spark, d), _NAMED, ["category1", "category2"]).select("place", "scope_category1", "scope_category2", "products", "comments")


def header_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per table, columns that hold a byte order mark, control characters or replacement characters in their text."""
    parts = []
    for t, cols in (("comment_candidates", ["title", "body"]), ("product_candidates", ["title_fa", "brand"]), ("documents", ["text"])):
        u = profile.unpivoted(table(spark, d, t), cols).where("value IS NOT NULL")
        n = u.groupBy("column").agg(*[F.count_if(F.col("value").contains(c)).alias(k) for k, c in (("byte_order_marks", "\ufeff"), ("replacements", "\ufffd"), ("nulls", "\x00"))])
        parts.append(n.select(F.lit(t).alias("table_name"), "*"))
    return _union(parts)


_SIMPLE = ["parse_ids", "parse_counts", "parse_booleans", "product_rate_rules", "comment_rate_rules", "text_sentinels", "jalali_parse", "product_transform", "offer_transform", "comment_transform", "exact_row_dedup", "dup_id_metrics", "duplicated_rows", "offer_dedup", "offer_fingerprint", "raw_digest", "offer_id_collisions", "offer_multiplicity", "core_digest", "canonical_products", "product_conflicts", "canonical_comments", "canonical_comment_figures", "comment_conflicts", "offers_without_product", "orphan_comments", "first_orphan_products", "comment_date_range", "row_audit", "rule_event_counts", "aggregate_transformations", "quarantine_rows", "quarantine_rule_counts", "reconciliation", "price_p999_flag", "price_thresholds", "group_nearest_rank", "scope_inventory", "inventory_report", "scope_invariants", "coherent_scopes_topk", "column_profile", "top_values", "value_distribution", "missing_summary", "range_violations", "price_validation", "offer_variation", "join_coverage", "products_of_comments", "crosstab_margins", "describe_price", "histogram_bins", "nlargest", "value_counts", "date_shape_counts", "comments_by_jalali_year", "code_title_multiplicity", "occurrence_histogram", "field_disagreement", "price_history_relation", "stratified_sample", "lexical_classes", "sentinel_crosstab", "named_scopes", "header_checks"]
QUERIES = {n: globals()[n] for n in _SIMPLE}

_OFFER_SQL = ", ".join(f'"{c}"' for c in T.OFFER_CONTENT)
_FP = _digest_sql([(f'"{c}"', "V") for c in T.OFFER_CONTENT])
_OK = f"""ok_products AS (SELECT source_row, {_int('id')} AS product_id FROM distinct_products WHERE source_row NOT IN (SELECT source_row FROM events WHERE side = 'products' AND fatal)),
ok_offers AS (SELECT source_row, {_int('id')} AS product_id, nullif({_int('"Price"')}, 0) AS price_raw, {_OFFER_SQL} FROM distinct_products WHERE source_row NOT IN (SELECT source_row FROM events WHERE side = 'offers' AND fatal)),
distinct_offers AS (SELECT DISTINCT product_id, price_raw, {_OFFER_SQL} FROM ok_offers)"""
_RULE_COUNTS = f"""{_EVENTS}, {_OK},
won AS ({_CANON_PRODUCTS} SELECT product_id, variants FROM w WHERE place = 1),
final_offers AS (SELECT * FROM distinct_offers WHERE product_id IN (SELECT product_id FROM won)),
threshold AS (SELECT price_raw AS t FROM (SELECT price_raw, row_number() OVER (ORDER BY price_raw) AS k, count(*) OVER () AS n FROM final_offers WHERE price_raw > 0) WHERE k = (999 * n + 999) // 1000),
ok_comments AS (SELECT * FROM distinct_comments WHERE source_row NOT IN (SELECT source_row FROM events WHERE side = 'comments' AND fatal)),
won_comments AS ({_CANON_COMMENTS} SELECT comment_id, product_id, variants, product_id NOT IN (SELECT product_id FROM final_products) AS orphan FROM w WHERE place = 1),
counted(side, rule_id, n) AS (
  SELECT CASE WHEN side = 'comments' THEN side ELSE 'products' END, rule_id, count(*) FROM events GROUP BY ALL
  UNION ALL SELECT 'products', 'RAW-001', sum(copies) FROM distinct_products
  UNION ALL SELECT 'products', 'PRD-001', sum(copies - 1) FROM distinct_products
  UNION ALL SELECT 'products', 'ID-001', count(*) FROM distinct_products WHERE source_row NOT IN (SELECT source_row FROM events WHERE side = 'products' AND rule_id = 'ID-002')
  UNION ALL SELECT 'products', 'BOOL-001', count(*) FROM distinct_products WHERE source_row NOT IN (SELECT source_row FROM events WHERE side = 'offers' AND rule_id = 'BOOL-002')
  UNION ALL SELECT 'products', 'PRD-002', count(*) FROM (SELECT product_id FROM ok_products GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'products', 'PRD-003', count(*) FROM won WHERE variants > 1
  UNION ALL SELECT 'products', 'OFF-001', (SELECT count(*) FROM ok_offers) - (SELECT count(*) FROM distinct_offers)
  UNION ALL SELECT 'products', 'OFF-002', count(*) - count(DISTINCT product_id) FROM final_offers
  UNION ALL SELECT 'products', 'OFF-005', count(*) FROM final_offers, threshold WHERE price_raw > t
  UNION ALL SELECT 'products', 'OFF-006', count(*) FROM final_offers WHERE price_raw > 0
  UNION ALL SELECT 'products', 'OFF-009', (SELECT count(*) FROM distinct_offers) - (SELECT count(*) FROM final_offers)
  UNION ALL SELECT 'comments', 'RAW-001', sum(copies) FROM distinct_comments
  UNION ALL SELECT 'comments', 'COM-001', sum(copies - 1) FROM distinct_comments
  UNION ALL SELECT 'comments', 'ID-001', count(*) FROM distinct_comments WHERE source_row NOT IN (SELECT source_row FROM events WHERE side = 'comments' AND rule_id = 'ID-002')
  UNION ALL SELECT 'comments', 'BOOL-001', count(*) FROM distinct_comments WHERE source_row NOT IN (SELECT source_row FROM events WHERE side = 'comments' AND rule_id = 'BOOL-002')
  UNION ALL SELECT 'comments', 'COM-004', count(*) FROM ok_comments WHERE TRY_CAST(trim(rate) AS DECIMAL(38,10)) BETWEEN 0.01 AND 5 AND NOT (contains(rate, '.') AND length(split_part(trim(rate), '.', 2)) > 2)
  UNION ALL SELECT 'comments', 'COM-007', count(*) FROM ok_comments WHERE trim(rate) = '2500'
  UNION ALL SELECT 'comments', r, count(*) FROM ok_comments, (VALUES ('COM-008'), ('DATE-001'), ('DATE-002'), ('DATE-004')) x(r) GROUP BY r
  UNION ALL SELECT 'comments', 'COM-002', count(*) FROM won_comments WHERE variants > 1
  UNION ALL SELECT 'comments', 'JOIN-001', count(*) FROM won_comments WHERE NOT orphan
  UNION ALL SELECT 'comments', 'JOIN-002', count(*) FROM won_comments WHERE orphan)
SELECT r.side, r.rule_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (VALUES {_ALL_RULES}) r(side, rule_id) LEFT JOIN counted USING (side, rule_id) GROUP BY ALL"""
_XNUM = "CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim({c}) AS DOUBLE) END"
_UNPIVOTED = "(" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", nullif(CASE WHEN trim("{c}") = '' THEN '' ELSE "{c}" END, '') AS value, source_row FROM raw_products""" for c in dict.fromkeys([*_PROFILED, "sub_category"])) + ")"


def _json_sql(t: str, columns: list[str]) -> str:
    """The raw record as JSON text with sorted keys."""
    return f"SELECT source_row, CAST(json_object({', '.join(f'{chr(39)}{c}{chr(39)}, {chr(34)}{c}{chr(34)}' for c in sorted(columns))}) AS VARCHAR) AS raw_record_json FROM {t}"


def _vary(t: str, key: str, facts: dict[str, list[str]]) -> str:
    inner = ", ".join(f"count(DISTINCT ROW({', '.join(cols)})) AS {n}" for n, cols in facts.items())
    outer = ", ".join(f"count(*) FILTER ({n} > 1) AS {n}" for n in facts)
    return f"SELECT {outer} FROM (SELECT {inner} FROM {t} WHERE {key} IS NOT NULL GROUP BY {key})"


ORACLES = {
    "parse_ids": f"WITH {CTE_PRODUCTS} SELECT source_row, {_int('id')} AS value, {_why('id')} AS reason FROM raw_products",
    "parse_counts": f"WITH {CTE_COMMENTS} SELECT source_row, {_int('likes')} AS value, CASE WHEN NOT {_blank('likes')} THEN {_why('likes')} END AS reason FROM raw_comments",
    "parse_booleans": f"""WITH {CTE_PRODUCTS} SELECT source_row, {_BOOL.format(c='"Is_Fake"')} AS value FROM raw_products""",
    "product_rate_rules": f"WITH {TYPED_PRODUCTS} SELECT source_row, rate, rate_count, is_unrated, inconsistent_zero_rate FROM products",
    "comment_rate_rules": f"WITH {TYPED_COMMENTS} SELECT source_row, CASE WHEN rate_reason IS NULL THEN CAST(r AS DECIMAL(3,2)) END AS value, rate_reason AS reason FROM rated",
    "text_sentinels": f"WITH {TYPED_COMMENTS} SELECT source_row, {', '.join(T.SENTINEL_RULES)} FROM typed_comments",
    "jalali_parse": f"WITH {TYPED_COMMENTS} SELECT source_row, created_at_jalali, created_at_gregorian FROM typed_comments",
    "product_transform": f"WITH {TYPED_PRODUCTS} SELECT * FROM products",
    "offer_transform": f"WITH {TYPED_OFFERS} SELECT source_row, product_id, seller, price_raw, is_fake, min_price_last_month, missing_price_history, invalid_price, CAST(toman AS DOUBLE) AS price_toman FROM offers_ok",
    "comment_transform": f"WITH {TYPED_COMMENTS} SELECT * REPLACE (CAST(rate AS DOUBLE) AS rate) FROM comments_ok",
    "exact_row_dedup": f"WITH {CTE_PRODUCTS} SELECT min(source_row) AS source_row, count(*) AS copies FROM raw_products GROUP BY {', '.join(chr(34) + c + chr(34) for c in T.PRODUCT_COLUMNS)}",
    "dup_id_metrics": "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_ids, count(*) FILTER (n > 1) AS repeated_ids, CAST(sum(n - 1) AS BIGINT) AS excess_rows FROM (SELECT count(*) AS n FROM comment_candidates GROUP BY comment_id)",
    "duplicated_rows": "SELECT source_row, comment_id, count(*) OVER (PARTITION BY comment_id) AS copies FROM comment_candidates QUALIFY copies > 1",
    "offer_dedup": f"WITH {TYPED_OFFERS} SELECT min(source_row) AS source_row, count(*) AS copies FROM offers_ok GROUP BY id, p, s, f, h",
    "offer_fingerprint": f"WITH {CTE_PRODUCTS} SELECT source_row, {_FP} AS fingerprint FROM raw_products",
    "raw_digest": f"WITH {CTE_PRODUCTS} SELECT source_row, {_digest_sql([(f'{chr(34)}{c}{chr(34)}', 'S') for c in T.PRODUCT_COLUMNS])} AS digest FROM raw_products",
    "offer_id_collisions": f"{_EVENTS}, {_OK} SELECT count(*) AS contents, count(DISTINCT {_FP}) AS ids, count(*) - count(DISTINCT {_FP}) AS collisions FROM distinct_offers",
    "offer_multiplicity": f"{_EVENTS}, {_OK} SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_ids, count(*) FILTER (n > 1) AS repeated_ids, CAST(sum(n - 1) AS BIGINT) AS excess_rows FROM (SELECT count(*) AS n FROM distinct_offers GROUP BY product_id)",
    "canonical_comment_figures": f"""{_CANON_COMMENTS}, per AS (SELECT comment_id, sum(copies) AS n, count(*) AS contents FROM v WHERE k = 1 GROUP BY 1)
  SELECT count(*) FILTER (n > 1) AS repeated_ids, CAST(sum(n - 1) AS BIGINT) AS repeated_excess_rows, count(*) FILTER (n > contents) AS identical_ids, CAST(sum(n - contents) AS BIGINT) AS identical_rows_removed,
    count(*) FILTER (contents > 1) AS conflicting_ids, CAST(coalesce(sum(contents) FILTER (contents > 1), 0) AS BIGINT) AS conflict_alternatives, count(*) AS canonical FROM per""",
    "core_digest": f"WITH {TYPED_PRODUCTS} SELECT source_row, {_CORE_SQL} AS digest FROM products",
    "canonical_products": f"{_CANON_PRODUCTS} SELECT product_id, title_fa, category1, category2, brand, rate, rate_count, sub_category, is_unrated, inconsistent_zero_rate, variants > 1 AS core_attribute_conflict, source_row AS canonical_source_row FROM w WHERE place = 1",
    "product_conflicts": f"{_CANON_PRODUCTS} SELECT product_id, source_row, canonical_row, completeness, digest, place = 1 AS selected FROM w WHERE variants > 1",
    "canonical_comments": f"{_CANON_COMMENTS} SELECT comment_id, product_id, title, body, created_at_gregorian, CAST(rate AS DOUBLE) AS rate, completeness, canonical_digest, variants > 1 AS comment_id_conflict, source_row AS canonical_source_row FROM w WHERE place = 1",
    "comment_conflicts": f"{_CANON_COMMENTS} SELECT comment_id, source_row, canonical_row, completeness, place = 1 AS selected FROM w WHERE variants > 1",
    "offers_without_product": f"WITH a AS ({_CANON_PRODUCTS} SELECT product_id FROM w WHERE place = 1), o AS (WITH {TYPED_OFFERS} SELECT source_row, product_id FROM offers_ok) SELECT * FROM o ANTI JOIN a USING (product_id)",
    "orphan_comments": f"{_CANON_COMMENTS} SELECT comment_id, product_id, source_row AS canonical_source_row FROM w WHERE place = 1 AND product_id NOT IN (SELECT product_id FROM final_products)",
    "first_orphan_products": "SELECT product_id, min(source_row) AS first_row, count(*) AS n FROM comment_candidates WHERE product_id NOT IN (SELECT product_id FROM final_products) GROUP BY 1 ORDER BY 2 LIMIT 20",
    "comment_date_range": f"{_CANON_COMMENTS} SELECT min(created_at_gregorian) AS first_day, max(created_at_gregorian) AS last_day FROM w WHERE place = 1 AND product_id IN (SELECT product_id FROM final_products)",
    "row_audit": f"{_EVENTS}, info(rule_id, action, severity, is_lossy) AS (VALUES {_INFO}) SELECT side AS dataset, source_row, entity_id, field, raw_value, rule_id, action, severity, detail, is_lossy FROM events JOIN info USING (rule_id) WHERE row_level",
    "rule_event_counts": _RULE_COUNTS,
    "aggregate_transformations": f"{_EVENTS} SELECT side, rule_id, field, count(*) AS n FROM events WHERE NOT row_level GROUP BY ALL",
    "quarantine_rows": f"""{_EVENTS}, info(rule_id, action, severity, is_lossy) AS (VALUES {_INFO}), q AS (SELECT side, source_row, any_value(entity_id) AS entity_id, array_to_string(list_sort(list_distinct(list(rule_id))), ',') AS rule_ids,
  string_agg(rule_id || ': ' || action || coalesce(' (' || detail || ')', ''), '; ' ORDER BY place) AS reason FROM events JOIN info USING (rule_id) WHERE row_level AND (side, source_row) IN (SELECT (side, source_row) FROM events WHERE fatal) GROUP BY ALL)
  SELECT side AS dataset, q.source_row, entity_id, rule_ids, reason, raw_record_json FROM q JOIN ({_json_sql('distinct_products', T.PRODUCT_COLUMNS)}) r USING (source_row) WHERE side <> 'comments'
  UNION ALL SELECT side, q.source_row, entity_id, rule_ids, reason, raw_record_json FROM q JOIN ({_json_sql('distinct_comments', T.COMMENT_COLUMNS)}) r USING (source_row) WHERE side = 'comments'""",
    "quarantine_rule_counts": f"{_EVENTS} SELECT side AS dataset, rule_id, count(DISTINCT source_row) AS n FROM events WHERE row_level AND (side, source_row) IN (SELECT (side, source_row) FROM events WHERE fatal) GROUP BY ALL",
    "reconciliation": f"{_EVENTS} {_reconciled('products', 'distinct_products')} UNION ALL {_reconciled('offers', 'distinct_products')} UNION ALL {_reconciled('comments', 'distinct_comments')}",
    "price_p999_flag": "WITH t AS (SELECT price_raw AS threshold FROM (SELECT price_raw, row_number() OVER (ORDER BY price_raw) AS k, count(*) OVER () AS n FROM offers WHERE price_raw IS NOT NULL) WHERE k = (999 * n + 999) // 1000) SELECT source_row, price_raw, coalesce(price_raw > (SELECT threshold FROM t), FALSE) AS high_price_review FROM offers",
    "price_thresholds": _nearest_sql("offers", [], [500, 950, 990, 999]),
    "group_nearest_rank": _nearest_sql("(SELECT o.price_raw, p.sub_category FROM offers o JOIN product_candidates p USING (source_row))", ["sub_category"], [100, 500, 900, 999]),
    "scope_inventory": f"{_INVENTORY} SELECT * FROM inv",
    "inventory_report": f"{_INVENTORY} SELECT CASE level WHEN 1 THEN 'category1' ELSE 'category1_category2' END AS scope_level, scope_category1 AS category1, scope_category2 AS category2, {', '.join(f'{c} AS {n}' for n, c in scopes.REPORT.items())} FROM inv",
    "scope_invariants": f"{_INVENTORY} SELECT level, scope_category1, scope_category2 FROM inv WHERE commented_products > products OR priced_products > products OR bodies > comments OR buyers > comments OR ratings > comments OR NOT (commented_products >= products_with_5 AND products_with_5 >= products_with_10 AND products_with_10 >= products_with_20 AND products_with_20 >= products_with_50)",
    "coherent_scopes_topk": f"{_INVENTORY} SELECT scope_category1, scope_category2, products, comments, commented_products, brands FROM inv WHERE level = 2 AND products >= 20 AND comments >= 20 AND coverage_percent >= 10 AND brands >= 2 AND NOT contains(scope_category2, 'متفرقه') AND NOT contains(scope_category2, 'سایر') ORDER BY comments DESC, commented_products DESC, products DESC, scope_category1, scope_category2 LIMIT 20",
    "column_profile": f"""WITH {CTE_PRODUCTS}, u AS (SELECT *, {_XNUM.format(c='value')} AS x FROM {_UNPIVOTED} WHERE "column" <> 'sub_category') SELECT "column", count(*) FILTER (value IS NULL) AS missing, count(value) AS present, count(x) AS "numeric", count(*) FILTER (value IS NOT NULL AND x IS NULL) AS not_numeric, min(x) AS least, max(x) AS greatest, round(sum(x), 2) AS total FROM u GROUP BY 1""",
    "top_values": f"""WITH {CTE_PRODUCTS}, n AS (SELECT "column", value, count(*) AS n, min(source_row) AS f FROM {_UNPIVOTED} WHERE value IS NOT NULL AND "column" IN ('Brand', 'Category1', 'Is_Fake') GROUP BY 1, 2) SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, f) AS place, value, n FROM n QUALIFY place <= 20""",
    "value_distribution": f"""WITH {CTE_PRODUCTS}, n AS (SELECT "column", value, count(*) AS n FROM {_UNPIVOTED} WHERE value IS NOT NULL AND "column" IN ('Brand', 'Category1', 'Is_Fake', 'sub_category') GROUP BY 1, 2) SELECT * FROM n QUALIFY count(*) OVER (PARTITION BY "column") <= 100""",
    "missing_summary": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (trim(CAST({c} AS VARCHAR)) = '' OR {c} IS NULL) AS missing FROM comment_candidates" for c in ("title", "body", "rate", "likes", "seller_code")),
    "range_violations": f"""WITH {CTE_PRODUCTS} SELECT count(*) FILTER ({_XNUM.format(c='"Rate"')} NOT BETWEEN 0 AND 100) AS "Rate", count(*) FILTER ({_XNUM.format(c='"Rate_cnt"')} NOT BETWEEN 0 AND 1000) AS "Rate_cnt" FROM raw_products""",
    "price_validation": f"""WITH {CTE_PRODUCTS}, u AS (SELECT "Price" AS p, {_XNUM.format(c='"Price"')} AS x FROM raw_products) SELECT count(*) FILTER (trim(p) = '') AS missing, count(*) FILTER (x = 0) AS zero, count(*) FILTER (x < 0) AS negative, count(*) FILTER (x > 0) AS positive, count(*) FILTER (trim(p) <> '' AND x IS NULL) AS not_numeric FROM u""",
    "offer_variation": f"""WITH {CTE_PRODUCTS} {_vary("raw_products", "id", {"sellers": ['"Seller"'], "prices": ['"Price"'], "cores": ["title_fa", '"Category1"', '"Category2"', '"Brand"', "sub_category"]})}""",
    "join_coverage": "WITH n AS (SELECT product_id, count(*) AS n, product_id IN (SELECT product_id FROM final_products) AS known FROM comment_candidates GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) FILTER (known) AS BIGINT) AS known_rows, count(*) AS keys, count(*) FILTER (known) AS known_keys FROM n",
    "products_of_comments": "SELECT product_id, title_fa FROM final_products WHERE product_id IN (SELECT product_id FROM comment_candidates)",
    "crosstab_margins": "SELECT CAST(rate AS VARCHAR) AS rate, recommendation_status, count(*) AS n, grouping(rate) = 1 AS a_all, grouping(recommendation_status) = 1 AS b_all FROM comment_candidates GROUP BY CUBE (rate, recommendation_status)",
    "describe_price": "SELECT count(price_raw) AS n, round(avg(CAST(price_raw AS DOUBLE)), 2) AS mean, round(stddev_samp(CAST(price_raw AS DOUBLE))) AS deviation, round(CAST(min(price_raw) AS DOUBLE), 2) AS least, round(CAST(max(price_raw) AS DOUBLE), 2) AS greatest, round(quantile_cont(CAST(price_raw AS DOUBLE), 0.5), 2) AS p50, round(quantile_cont(CAST(price_raw AS DOUBLE), 0.95), 2) AS p95, round(quantile_cont(CAST(price_raw AS DOUBLE), 0.99), 2) AS p99 FROM offers",
    "histogram_bins": "SELECT least(CAST(floor(rate / 5.0) AS BIGINT) + 1, 20) AS bin, count(*) AS n FROM product_candidates WHERE rate BETWEEN 0 AND 100 GROUP BY 1",
    "nlargest": "SELECT source_row, product_id, price_raw FROM offers WHERE price_raw IS NOT NULL ORDER BY price_raw DESC, source_row LIMIT 10",
    "value_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "date_shape_counts": f"WITH {CTE_COMMENTS} SELECT regexp_replace(regexp_replace(created_at, '[0-9]', '9', 'g'), '\\p{{L}}+', 'A', 'g') AS shape, count(*) AS n FROM raw_comments GROUP BY 1",
    "comments_by_jalali_year": "SELECT created_at_jalali[1:4] AS year, count(*) AS n FROM comment_candidates GROUP BY 1",
    "code_title_multiplicity": "SELECT titles, count(*) AS codes FROM (SELECT seller_code, count(DISTINCT seller_title) AS titles FROM comment_candidates WHERE seller_code IS NOT NULL AND seller_title IS NOT NULL GROUP BY 1) GROUP BY 1",
    "occurrence_histogram": "SELECT occurrences, count(*) AS ids FROM (SELECT count(*) AS occurrences FROM comment_candidates GROUP BY comment_id) GROUP BY 1",
    "field_disagreement": _vary("comment_candidates", "comment_id", {f"{f}_differs": [f] for f in ("title", "body", "rate", "likes", "is_buyer")}),
    "price_history_relation": "SELECT CASE WHEN price_raw IS NULL OR min_price_last_month IS NULL THEN 'unknown' WHEN price_raw < min_price_last_month THEN 'below' WHEN price_raw = min_price_last_month THEN 'equal' ELSE 'above' END AS relation, count(*) AS n FROM offers GROUP BY 1",
    "stratified_sample": "SELECT source_row, product_id, sub_category FROM product_candidates QUALIFY row_number() OVER (PARTITION BY sub_category ORDER BY md5(CAST(source_row AS VARCHAR)), source_row) <= 3",
    "lexical_classes": f"""WITH {CTE_COMMENTS} SELECT CASE WHEN trim(rate) = '' THEN 'blank' WHEN regexp_full_match(rate, '[0-9]+') THEN 'integer' WHEN regexp_full_match(rate, '[0-9]+\\.[0-9]+') THEN 'decimal'
  WHEN regexp_full_match(rate, '[+-][0-9.]+') THEN 'signed' WHEN regexp_full_match(rate, '\\p{{L}}+') THEN 'letters' ELSE 'other' END AS form, count(*) AS n FROM raw_comments GROUP BY 1""",
    "sentinel_crosstab": f"WITH {CTE_COMMENTS}, c AS (SELECT title = 'nan' AS title_nan, body = 'nan' AS body_nan FROM raw_comments) SELECT title_nan, body_nan, count(*) AS n, grouping(title_nan) = 1 AS a_all, grouping(body_nan) = 1 AS b_all FROM c GROUP BY CUBE (title_nan, body_nan)",
    "named_scopes": f"{_INVENTORY}, names(place, c1, c2) AS (VALUES {', '.join('(' + str(i) + ', ' + ', '.join('NULL' if x is None else repr(x) for x in n) + ')' for i, n in enumerate(_NAMED))}) SELECT place, scope_category1, scope_category2, products, comments FROM inv JOIN names ON scope_category1 IS NOT DISTINCT FROM c1 AND scope_category2 IS NOT DISTINCT FROM c2",
    "header_checks": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS \"column\", count(*) FILTER (contains({c}, chr(65279))) AS byte_order_marks, count(*) FILTER (contains({c}, chr(65533))) AS replacements, count(*) FILTER (contains({c}, chr(0))) AS nulls FROM {t}"
        for t, cs in (("comment_candidates", ["title", "body"]), ("product_candidates", ["title_fa", "brand"]), ("documents", ["text"])) for c in cs
    ),
}
