"""Typed rows from raw text rows of products, offers and comments, with the events their parsing made.

The rule ids and field names are those of the data's published rule catalogue. Only what parsing and
normalising decide is here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.functions import digest, jalali
from catalogq.functions.num import integer, rate, scale, with_digits
from catalogq.functions.text import clean_text, is_blank, strict_boolean
from catalogq.operators.evidence import Rule, said, with_events
from catalogq.operators.rules import BOOLEAN_SAYS, COUNT_SAYS, DATE_SAYS, ID_SAYS, RATE_SAYS, SENTINEL_RULES

PRODUCT_COLUMNS = ["id", "title_fa", "Rate", "Rate_cnt", "Category1", "Category2", "Brand", "Price", "Seller", "Is_Fake", "min_price_last_month", "sub_category"]
COMMENT_COLUMNS = ["id", "title", "body", "created_at", "rate", "recommendation_status", "is_buyer", "product_id", "advantages", "disadvantages", "likes", "dislikes", "seller_title", "seller_code", "true_to_size_rate"]
# The raw columns that make an offer, in the order its id hashes them.
OFFER_CONTENT = ["id", "Seller", "Price", "Is_Fake", "min_price_last_month"]
# The raw columns of a product's core facts.
CORE_COLUMNS = ["title_fa", "Category1", "Category2", "Brand", "Rate", "Rate_cnt", "sub_category"]
PRODUCT_CORE = ["title_fa", "category1", "category2", "brand", "rate", "rate_count", "sub_category"]
COMMENT_CONTENT = ["product_id", "title", "body", "created_at_raw", "created_at_jalali", "created_at_gregorian", "rate", "is_unrated", "invalid_rate", "recommendation_status", "is_buyer", "advantages", "disadvantages", "likes", "dislikes", "seller_title", "seller_code", "true_to_size_rate"]


def parsed(df: DataFrame, integers: list[str], values: dict[str, Column], rates: list[str] | None = None) -> DataFrame:
    """``df`` with ``values`` computed once per row, over the ``integers`` and ``rates`` taken apart.

    The values come out of a generator, which keeps filters on them from being pushed below it and so from
    computing every parse a second time.
    """
    one = F.inline(F.array(F.struct(*[c.alias(n) for n, c in values.items()])))
    kinds = dict.fromkeys(integers, "integer") | dict.fromkeys(rates or [], "rate")
    return with_digits(df, kinds).select(*df.columns, one)


def _blanks(fields: list[str]) -> dict[str, Column]:
    """Whether each text field is blank, as columns computed once."""
    return {f"{f}_blank": is_blank(F.col(f)) for f in fields}


def _blank_text(field: str) -> Rule:
    return Rule("TXT-001", field, F.col(field).isNotNull() & F.col(f"{field}_blank"))


def _kept(field: str, sentinel: bool = False) -> Column:
    """The text, null if blank or exactly ``nan`` where that stands for nothing."""
    blank = F.col(f"{field}_blank")
    return F.when(~(blank | (F.col(field) == "nan") if sentinel else blank), F.col(field))


def product_rows(raw: DataFrame) -> DataFrame:
    """Adds the typed product columns (prefix ``p_``), ``events`` and ``fatal``."""
    values = dict(zip(("id_v", "id_r", "count_v", "count_r", "rate_v", "rate_r"), (*integer("id"), *integer("Rate_cnt"), *rate("Rate", 100, kind="double"))))
    text = {"title_fa": "title_fa", "category1": "Category1", "category2": "Category2", "brand": "Brand", "sub_category": "sub_category"}
    rows = parsed(raw, ["id", "Rate_cnt"], values | _blanks(list(text.values())), ["Rate"])
    product_id, bad_id, count, bad_count, value, bad_rate = map(F.col, values)
    usable = bad_count.isNull() & bad_rate.isNull()
    zero = usable & (value == 0)
    rules = [
        Rule("ID-002", "id", bad_id.isNotNull(), said(bad_id, ID_SAYS), fatal=True),
        Rule("PRD-007", "Rate_cnt", bad_count.isNotNull(), said(bad_count, COUNT_SAYS), fatal=True),
        Rule("PRD-004", "Rate", bad_rate.isNotNull(), F.lit(RATE_SAYS), fatal=True),
        Rule("PRD-005", "Rate", zero & (count == 0)),
        Rule("PRD-006", "Rate", zero & (count > 0)),
        *map(_blank_text, text.values()),
    ]
    typed = with_events(rows, rules)
    return typed.select(
        *raw.columns,
        product_id.alias("p_product_id"),
        *[_kept(c).alias(f"p_{n}") for n, c in text.items()],
        F.when(~(zero & (count == 0)), value).alias("p_rate"),
        count.alias("p_rate_count"),
        (zero & (count == 0)).alias("p_is_unrated"),
        (zero & (count > 0)).alias("p_inconsistent_zero_rate"),
        "events",
        "fatal",
    )


def product_candidates(raw: DataFrame) -> DataFrame:
    """Accepted product rows with their final names."""
    rows = product_rows(raw).where("NOT fatal")
    return rows.select("source_row", *[F.col(c).alias(c[2:]) for c in rows.columns if c.startswith("p_")])


def offer_rows(raw: DataFrame) -> DataFrame:
    """Adds the typed offer columns (prefix ``o_``), ``events`` and ``fatal``."""
    values = dict(zip(("id_v", "id_r", "price_v", "price_r", "history_v", "history_r", "fake_v"), (*integer("id"), *integer("Price"), *integer("min_price_last_month", optional=True), strict_boolean(F.col("Is_Fake")))))
    rows = parsed(raw, ["id", "Price", "min_price_last_month"], values | _blanks(["Seller"]))
    product_id, bad_id, price, bad_price, history, bad_history, fake = map(F.col, values)
    rules = [
        Rule("ID-002", "id", bad_id.isNotNull(), said(bad_id, ID_SAYS), fatal=True),
        Rule("BOOL-002", "Is_Fake", fake.isNull(), F.lit(BOOLEAN_SAYS), fatal=True),
        Rule("OFF-004", "Price", bad_price.isNotNull(), said(bad_price, COUNT_SAYS), fatal=True),
        Rule("OFF-008", "min_price_last_month", bad_history.isNotNull(), said(bad_history, COUNT_SAYS), fatal=True),
        Rule("OFF-003", "Price", price == 0),
        Rule("OFF-007", "min_price_last_month", history == 0),
        _blank_text("Seller"),
    ]
    return with_events(rows, rules).select(
        *raw.columns,
        product_id.alias("o_product_id"),
        _kept("Seller").alias("o_seller"),
        F.nullif(price, F.lit(0).cast("bigint")).alias("o_price_raw"),
        (F.nullif(price, F.lit(0).cast("bigint")).cast("decimal(20,0)") / 10).cast("decimal(20,1)").alias("o_price_toman"),
        fake.alias("o_is_fake"),
        F.nullif(history, F.lit(0).cast("bigint")).alias("o_min_price_last_month"),
        F.coalesce(history == 0, F.lit(False)).alias("o_missing_price_history"),
        F.coalesce(price == 0, F.lit(False)).alias("o_invalid_price"),
        "events",
        "fatal",
    )


def offer_candidates(raw: DataFrame) -> DataFrame:
    rows = offer_rows(raw).where("NOT fatal")
    return rows.select("source_row", "id", "Price", "Seller", "Is_Fake", "min_price_last_month", *[F.col(c).alias(c) for c in rows.columns if c.startswith("o_")])


def _sentinel_rules(field: str) -> list[Rule]:
    c, blank = F.col(field), F.col(f"{field}_blank")
    rules = [Rule(SENTINEL_RULES[field], field, c == "nan")]
    if field == "seller_code":
        return [*rules, Rule("COM-011", field, c == ""), Rule("TXT-001", field, blank & (c != "")), Rule("COM-010", field, ~blank & (c != "nan"))]
    rules.append(_blank_text(field))
    if field == "body":
        rules.append(Rule("COM-009", field, blank | (c == "nan")))
    return rules


def comment_rows(raw: DataFrame) -> DataFrame:
    """Adds the typed comment columns (prefix ``c_``), ``events`` and ``fatal``."""
    names = ("id_v", "id_r", "product_v", "product_r", "likes_v", "likes_r", "dislikes_v", "dislikes_r", "rate_v", "rate_r", "rate_scale", "date_iso", "date_v", "date_r", "buyer_v")
    counts = (*integer("id"), *integer("product_id"), *integer("likes", optional=True), *integer("dislikes", optional=True))
    values = dict(zip(names, (*counts, *rate("rate", 5, 2), scale("rate"), *jalali.parsed(F.col("created_at")), strict_boolean(F.col("is_buyer")))))
    rows = parsed(raw, ["id", "product_id", "likes", "dislikes"], values | _blanks(list(SENTINEL_RULES)), ["rate"])
    comment_id, bad_id, product_id, bad_product, likes, bad_likes, dislikes, bad_dislikes, value, bad_rate, places, iso, day, bad_date, buyer = map(F.col, values)
    rules = [
        Rule("ID-002", "id", bad_id.isNotNull(), said(bad_id, ID_SAYS), fatal=True),
        Rule("ID-002", "product_id", bad_product.isNotNull(), said(bad_product, ID_SAYS), fatal=True),
        Rule("BOOL-002", "is_buyer", buyer.isNull(), F.lit(BOOLEAN_SAYS), fatal=True),
        Rule("DATE-003", "created_at", bad_date.isNotNull(), said(bad_date, DATE_SAYS), fatal=True),
        Rule("COM-005", "rate", bad_rate == "zero"),
        Rule("COM-006", "rate", bad_rate == "number"),
        Rule("COM-021", "rate", bad_rate == "scale"),
        Rule("COM-012", "likes", bad_likes.isNotNull(), said(bad_likes, COUNT_SAYS)),
        Rule("COM-012", "dislikes", bad_dislikes.isNotNull(), said(bad_dislikes, COUNT_SAYS)),
        *[r for f in ("seller_code", "seller_title", "body", "title", "recommendation_status", "advantages", "disadvantages", "true_to_size_rate") for r in _sentinel_rules(f)],
    ]
    t = lambda f: _kept(f, True).alias(f"c_{f}")
    return with_events(rows, rules).select(
        *raw.columns,
        comment_id.alias("c_comment_id"),
        product_id.alias("c_product_id"),
        t("title"),
        t("body"),
        F.col("created_at").alias("c_created_at_raw"),
        iso.alias("c_created_at_jalali"),
        day.alias("c_created_at_gregorian"),
        value.alias("c_rate"),
        F.when(places == 0, value.cast("decimal(1,0)").cast("string")).when(places == 1, value.cast("decimal(2,1)").cast("string")).otherwise(value.cast("string")).alias("c_rate_text"),
        F.coalesce(bad_rate == "zero", F.lit(False)).alias("c_is_unrated"),
        F.coalesce(bad_rate.isin("number", "scale"), F.lit(False)).alias("c_invalid_rate"),
        t("recommendation_status"),
        buyer.alias("c_is_buyer"),
        t("advantages"),
        t("disadvantages"),
        likes.alias("c_likes"),
        dislikes.alias("c_dislikes"),
        t("seller_title"),
        t("seller_code"),
        t("true_to_size_rate"),
        "events",
        "fatal",
    )


def core_digest() -> Column:
    """Digest of a typed product's core facts."""
    tags = {"rate": "F", "rate_count": "I"}
    return digest.digest([(digest.float_text(F.col(c)) if c == "rate" else F.col(c), tags.get(c, "S")) for c in PRODUCT_CORE])


def _mapped() -> dict[str, Column]:
    """A comment's mapped values: its raw texts but for the id, null where blank or a sentinel."""
    return {c: clean_text(F.col(c), "nan" if c in SENTINEL_RULES else None) for c in COMMENT_COLUMNS[1:]}


def mapped_json() -> Column:
    """The mapped values as JSON with sorted keys."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(_mapped().items())]), {"ignoreNullFields": "false"})


def ranked_comments(typed: DataFrame, *more: Column) -> DataFrame:
    """Accepted comment rows and what ranks them: ``completeness``, the number of mapped values there are, and
    ``canonical_digest``, their digest. ``rate_text`` tells 3.5 from 3.50, which are different contents."""
    mapped = list(_mapped().values())
    there = reduce(lambda a, b: a + b, [c.isNotNull().cast("bigint") for c in mapped])
    names = [c for c in typed.columns if c.startswith("c_")]
    return typed.where("NOT fatal").select("source_row", there.alias("completeness"), digest.exact_digest(mapped).alias("canonical_digest"), *more, *[F.col(c).alias(c[2:]) for c in names])


def comment_candidates(raw: DataFrame) -> DataFrame:
    """Accepted comment rows of raw ones, with what ranks them."""
    return ranked_comments(comment_rows(raw))
