"""Schemas of the published tables; ``!`` marks a column that is never null."""

from __future__ import annotations

from pyspark.sql import types as T


def schema(text: str) -> T.StructType:
    """A StructType from "name! type, ..."."""
    fields = []
    for part in filter(None, (p.strip() for p in text.replace("\n", " ").split(";"))):
        name, kind = part.split(" ", 1)
        fields.append(T.StructField(name.rstrip("!"), T._parse_datatype_string(kind.strip()) if "<" in kind or "(" in kind else _PLAIN[kind.strip()], not name.endswith("!")))
    return T.StructType(fields)


_PLAIN = {"bigint": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}

PRODUCTS = "product_id! bigint; title_fa string; category1 string; category2 string; brand string; rate double; rate_count bigint; sub_category string; is_unrated! boolean; inconsistent_zero_rate! boolean; core_attribute_conflict! boolean; canonical_source_row_number! bigint"
OFFERS = "offer_id! string; product_id! bigint; seller string; price_raw bigint; price_toman decimal(20,1); is_fake boolean; min_price_last_month bigint; missing_price_history! boolean; invalid_price! boolean; high_price_review! boolean; source_row_number! bigint"
COMMENTS = "comment_id! bigint; product_id! bigint; title string; body string; created_at_raw! string; created_at_jalali! string; created_at_gregorian! date; rate decimal(3,2); is_unrated! boolean; invalid_rate! boolean; recommendation_status string; is_buyer boolean; advantages string; disadvantages string; likes bigint; dislikes bigint; seller_title string; seller_code string; true_to_size_rate string; comment_id_conflict! boolean; canonical_source_row_number! bigint"
PRODUCT_CONFLICTS = "product_id! bigint; title_fa string; category1 string; category2 string; brand string; rate double; rate_count bigint; sub_category string; is_unrated! boolean; inconsistent_zero_rate! boolean; candidate_source_row_number! bigint; canonical_source_row_number! bigint; core_completeness! bigint; core_digest! string; raw_core_json! string; selected_as_canonical! boolean"
COMMENT_CONFLICTS = COMMENTS.partition("; comment_id_conflict!")[0] + "; candidate_source_row_number! bigint; canonical_source_row_number! bigint; completeness! bigint; canonical_digest! string; raw_mapped_json! string; selected_as_canonical! boolean"
QUARANTINE = "dataset! string; source_file! string; source_row_number! bigint; entity_id bigint; rule_ids! array<string>; reason! string; raw_record_json! string"
ROW_AUDIT = "dataset! string; source_file! string; source_row_number! bigint; entity_id bigint; field! string; raw_value string; rule_id! string; action! string; severity! string; detail string; is_lossy! boolean"
