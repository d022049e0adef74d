"""The four runs: clean products, clean comments, category inventory, profile."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq import __version__, schemas
from catalogq.functions import digest as G
from catalogq.functions.text import group_value, normal_id
from catalogq.operators import canonical as C
from catalogq.operators import counters, dedup, evidence, profile, quantile, scopes
from catalogq.operators import transforms as T
from catalogq.operators.orphans import orphan_rows
from catalogq.session import cut
from catalogq.sources import publish as P
from catalogq.sources.exact_csv import read_exact_csv, read_text
from catalogq.sources.sniff import dataset_kind, find_column, sniff

ROW = "canonical_source_row_number"
CANDIDATE = {"source_row": "candidate_source_row_number", "canonical_row": ROW, "selected": "selected_as_canonical"}
# Why a row without its product is set aside.
NO_PRODUCT = {"OFF-009": "no valid canonical product exists for product_id", "JOIN-002": "canonical comment product_id is absent from products_clean"}


class ReconciliationError(ValueError):
    """Counts that ought to add up do not."""


def _must(equations: dict[str, tuple[int, int]]) -> dict[str, bool]:
    for name, (left, right) in equations.items():
        if left != right:
            raise ReconciliationError(f"{name}: {left} and {right}")
    return dict.fromkeys(equations, True)


def _counts(df: DataFrame) -> dict:
    r = df.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct"), F.count_if("fatal").alias("quarantined")).first()
    return r.asDict() | {"repeats": r["rows"] - r["distinct"], "accepted": r["distinct"] - r["quarantined"]}


def _raw_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def _quarantine(typed: DataFrame, entity: Column, dataset: str, raw: list[str], source: str, lonely: DataFrame, rule: str | None, order: list[str]) -> DataFrame:
    """What a side sets aside: rows that fail to parse, in their order, then those without a product."""
    bad = evidence.quarantine(typed, "source_row", entity, dataset, raw).withColumns({"__late": F.lit(0), **{c: F.lit(None).cast("bigint") for c in order}})
    if rule:
        late = lonely.select("source_row", *order).join(typed, "source_row").select(F.lit(dataset).alias("dataset"), "source_row", entity.alias("entity_id"), F.array(F.lit(rule)).alias("rule_ids"), F.lit(NO_PRODUCT[rule]).alias("reason"), _raw_json(raw).alias("raw_record_json"), F.lit(1).alias("__late"), *order)
        bad = bad.unionByName(late)
    return bad.withColumn("source_file", F.lit(source)).withColumnRenamed("source_row", "source_row_number")


def _by_rule(counts: DataFrame) -> dict[str, int]:
    return {r["rule_id"]: r["n"] for r in counts.collect()}  # one row per rule


def _by_field(sides: list[tuple[str, DataFrame]]) -> dict[str, int]:
    return {f"{r['side']}:{r['rule_id']}:{r['field']}": r["n"] for name, df in sides for r in evidence.field_counts(df, name).collect()}  # one row per rule and field


def clean_products(spark: SparkSession, source: str, target: str, force: bool = False, max_rows: int | None = None, failure_injector: Callable[[str], None] | None = None) -> dict:
    """Raw products and offers to products_clean, offers_clean, product_conflicts, product_quarantine, offer_quarantine and row_audit; gives the audit."""
    inject = failure_injector or (lambda phase: None)
    before = P.checksums(spark, [source])
    with P.publication(spark, target, force, failure_injector) as out:
        raw = read_exact_csv(spark, source, T.PRODUCT_COLUMNS, max_rows=max_rows)
        distinct = dedup.first_of_equal(raw, T.PRODUCT_COLUMNS, "source_row")
        products, offers = cut(T.product_rows(distinct)), cut(T.offer_rows(distinct))
        inject("after_ingest")
        n = {"products": _counts(products), "offers": _counts(offers)}
        accepted = products.where("NOT fatal").select("source_row", _raw_json(T.CORE_COLUMNS).alias("raw_core_json"), *[F.col(c).alias(c[2:]) for c in products.columns if c.startswith("p_")])
        accepted = accepted.withColumn("core_completeness", C.completeness(T.PRODUCT_CORE)).withColumn("core_digest", T.core_digest())
        rank = [C.descending(F.col("rate_count")), C.descending(F.col("core_completeness")), F.col("core_digest"), F.col("source_row")]
        won = cut(C.canonical(accepted, "product_id", T.PRODUCT_CORE, rank, [F.col("source_row")]))
        lost = C.conflicts(accepted, "product_id", "source_row", T.PRODUCT_CORE, rank, [F.col("source_row")])
        inject("after_canonical")
        ok = offers.where("NOT fatal").select("source_row", *T.OFFER_CONTENT, *[F.col(c).alias(f"o_{c[2:]}") for c in offers.columns if c.startswith("o_")])
        kept = dedup.first_rows(ok, T.OFFER_CONTENT, "source_row")
        distinct_offers = cut(kept.select(G.text_fingerprint([F.col(c) for c in T.OFFER_CONTENT]).alias("offer_id"), "source_row", *[F.col(c).alias(c[2:]) for c in kept.columns if c.startswith("o_")]))
        lonely = cut(orphan_rows(distinct_offers.select("offer_id", "source_row", "product_id"), won.select("product_id"), [("product_id", "product_id")]))
        final = distinct_offers.join(won.select("product_id"), "product_id", "left_semi")
        rank_row = quantile.nearest_rank(final.where("price_raw > 0"), [], "price_raw", [999]).first()
        flagged = cut(final.withColumn("high_price_review", F.lit(False) if rank_row is None else F.coalesce(F.col("price_raw") > F.lit(rank_row.threshold), F.lit(False))))
        audits = evidence.audit_records(products, "source_row", F.col("p_product_id"), "products").withColumn("__side", F.lit(0)).unionByName(evidence.audit_records(offers, "source_row", F.col("o_product_id"), "offers").withColumn("__side", F.lit(1)))
        audits = audits.withColumn("source_file", F.lit(source)).withColumnRenamed("source_row", "source_row_number")
        bad_products = _quarantine(products, F.col("p_product_id"), "products", T.PRODUCT_COLUMNS, source, lonely, None, [])
        bad_offers = _quarantine(offers, F.col("o_product_id"), "offers", T.PRODUCT_COLUMNS, source, lonely, "OFF-009", [])
        tables = {
            "products_clean": P.write_table(won.withColumn("core_attribute_conflict", F.col("variants") > 1).withColumnRenamed("source_row", ROW), f"{out.path}/products_clean", schemas.schema(schemas.PRODUCTS), ["product_id"]),
            "offers_clean": P.write_table(flagged.withColumnRenamed("source_row", "source_row_number"), f"{out.path}/offers_clean", schemas.schema(schemas.OFFERS), ["product_id", "offer_id"]),
            "product_conflicts": P.write_table(lost.withColumnsRenamed(CANDIDATE), f"{out.path}/product_conflicts", schemas.schema(schemas.PRODUCT_CONFLICTS), ["product_id", "core_digest", "candidate_source_row_number"]),
            "product_quarantine": P.write_table(bad_products, f"{out.path}/product_quarantine", schemas.schema(schemas.QUARANTINE), ["source_row_number"]),
            "offer_quarantine": P.write_table(bad_offers, f"{out.path}/offer_quarantine", schemas.schema(schemas.QUARANTINE), ["__late", "source_row_number"]),
            "row_audit": P.write_table(audits, f"{out.path}/row_audit", schemas.schema(schemas.ROW_AUDIT), ["source_row_number", "__side", "position"]),
        }
        n_lonely = lonely.count()
        ids = distinct_offers.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("offer_id").alias("ids")).first()
        rules = _by_rule(counters.product_run_counts(products, offers, won, distinct_offers, flagged))
        rows = {
            "input_rows": n["products"]["rows"],
            "exact_duplicate_rows_removed": n["products"]["repeats"],
            "distinct_raw_rows_retained": n["products"]["distinct"],
            "accepted_product_candidates": n["products"]["accepted"],
            "product_quarantine_rows": n["products"]["quarantined"],
            "accepted_offer_candidates": n["offers"]["accepted"],
            "offer_transform_quarantine_rows": n["offers"]["quarantined"],
            "distinct_offer_candidates": ids["n"],
            "exact_offer_duplicates_removed": n["offers"]["accepted"] - ids["n"],
            "offers_without_canonical_product": n_lonely,
            "unique_product_count": tables["products_clean"]["rows"],
            "conflict_product_id_count": rules["PRD-003"],
            "conflict_alternative_row_count": tables["product_conflicts"]["rows"],
            "distinct_offer_count": tables["offers_clean"]["rows"],
        }
        checks = _must(
            {
                "raw_dedup": (rows["input_rows"], rows["exact_duplicate_rows_removed"] + rows["distinct_raw_rows_retained"]),
                "product_sides": (rows["distinct_raw_rows_retained"], rows["accepted_product_candidates"] + rows["product_quarantine_rows"]),
                "offer_sides": (rows["distinct_raw_rows_retained"], rows["accepted_offer_candidates"] + rows["offer_transform_quarantine_rows"]),
                "offer_ids": (ids["n"], ids["ids"]),
                "final_offers": (rows["distinct_offer_candidates"], rows["distinct_offer_count"] + n_lonely),
                "product_quarantine": (tables["product_quarantine"]["rows"], rows["product_quarantine_rows"]),
                "offer_quarantine": (tables["offer_quarantine"]["rows"], rows["offer_transform_quarantine_rows"] + n_lonely),
            }
        )
        audit = {
            "rows": rows,
            "quarantine_counts_by_rule": {s: _by_rule(evidence.quarantine_counts(q)) for s, q in (("products", bad_products), ("offers", bad_offers))},
            "aggregate_transformations": _by_field([("products", products), ("offers", offers)]),
            "rule_event_counts": rules,
            "price_review": {"valid_positive_price_population": rules["OFF-006"], "method": "nearest-rank ceil(0.999 * N), flag strictly greater", "rank": rank_row and rank_row["rank"], "threshold": rank_row and rank_row.threshold},
            "deterministic_sort_keys": {"products_clean": ["product_id"], "offers_clean": ["product_id", "offer_id"], "product_conflicts": ["product_id", "core_digest", "candidate_source_row_number"]},
            "reconciliation": {"checks_passed": checks},
        }
        _finish(spark, out, audit, {"source": source}, before, {"max_rows": max_rows}, tables)
    return audit


#: Fields whose sentinel the audit counts one by one.
_QUALITY = {"missing_or_blank_title": "TXT-001:title", "missing_or_blank_body": "COM-009:body", "missing_or_blank_recommendation_status": "TXT-001:recommendation_status", "seller_code_missing": "COM-011:seller_code", **{f"{f}_sentinel_to_null": f"{r}:{f}" for f, r in T.SENTINEL_RULES.items()}, "zero_ratings": "COM-005:rate"}


def clean_comments(spark: SparkSession, source: str, products: str, target: str, force: bool = False, max_rows: int | None = None, failure_injector: Callable[[str], None] | None = None) -> dict:
    """Raw comments to comments_clean, comment_conflicts, comment_quarantine and row_audit, against a table of products; gives the audit."""
    inject = failure_injector or (lambda phase: None)
    before = P.checksums(spark, [source, products])
    with P.publication(spark, target, force, failure_injector) as out:
        keys = P.read_key_universe(spark, products, "product_id")
        inject("after_product_index")
        raw = read_exact_csv(spark, source, T.COMMENT_COLUMNS, field_limit=64 << 20, max_rows=max_rows)
        typed = cut(T.comment_rows(dedup.first_of_equal(raw, T.COMMENT_COLUMNS, "source_row")))
        inject("after_ingest")
        n = _counts(typed)
        accepted = cut(T.ranked_comments(typed, T.mapped_json().alias("raw_mapped_json")))
        content = [c if c != "rate" else "rate_text" for c in T.COMMENT_CONTENT]
        rank = [C.descending(F.col("completeness")), F.col("canonical_digest"), F.col("source_row")]
        won = cut(C.canonical(accepted, "comment_id", content, rank))
        lost = C.conflicts(accepted, "comment_id", "source_row", content, rank)
        figures = counters.candidate_figures(accepted.select("comment_id", G.exact_digest([F.col(c).cast("string") for c in content]).alias("__content")), "comment_id", "__content").first().asDict()
        inject("after_canonical")
        lonely = cut(orphan_rows(won.select("comment_id", "source_row", "product_id"), keys, [("product_id", "product_id")]))
        kept = won.join(lonely.select("comment_id"), "comment_id", "left_anti")
        audits = evidence.audit_records(typed, "source_row", F.col("c_comment_id"), "comments").withColumn("source_file", F.lit(source)).withColumnRenamed("source_row", "source_row_number")
        lonely_order = lonely.select("source_row", F.col("product_id").alias("__product"), F.col("comment_id").alias("__comment"))
        bad = _quarantine(typed, F.col("c_comment_id"), "comments", T.COMMENT_COLUMNS, source, lonely_order, "JOIN-002", ["__product", "__comment"])
        tables = {
            "comments_clean": P.write_table(kept.withColumn("comment_id_conflict", F.col("variants") > 1).withColumnRenamed("source_row", ROW), f"{out.path}/comments_clean", schemas.schema(schemas.COMMENTS), ["comment_id"]),
            "comment_conflicts": P.write_table(lost.withColumnsRenamed(CANDIDATE), f"{out.path}/comment_conflicts", schemas.schema(schemas.COMMENT_CONFLICTS), ["comment_id", "canonical_digest", "candidate_source_row_number"]),
            "comment_quarantine": P.write_table(bad, f"{out.path}/comment_quarantine", schemas.schema(schemas.QUARANTINE), ["__late", "__product", "__comment", "source_row_number"]),
            "row_audit": P.write_table(audits, f"{out.path}/row_audit", schemas.schema(schemas.ROW_AUDIT), ["source_row_number", "position"]),
        }
        orphans = lonely.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("product_id").alias("ids")).first()
        sample = [r[0] for r in lonely.select("product_id").distinct().orderBy("product_id").limit(20).collect()]
        rules, fields = _by_rule(counters.comment_run_counts(typed, won, lonely)), _by_field([("comments", typed)])
        rows = {
            "input_rows": n["rows"],
            "exact_duplicate_rows_removed": n["repeats"],
            "distinct_raw_rows_retained": n["distinct"],
            "accepted_transformation_candidates": n["accepted"],
            "transformation_quarantine_rows": n["quarantined"],
            "repeated_comment_id_count": figures["repeated_ids"],
            "repeated_comment_id_excess_rows": figures["repeated_excess_rows"],
            "identical_clean_duplicate_id_count": figures["identical_ids"],
            "identical_clean_duplicate_id_rows_removed": figures["identical_rows_removed"],
            "conflicting_comment_id_count": figures["conflicting_ids"],
            "conflict_alternative_count": figures["conflict_alternatives"],
            "canonical_comment_count_before_fk": figures["canonical"],
            "orphan_comment_rows": orphans["n"],
            "distinct_orphan_product_ids": orphans["ids"],
            "final_comments_clean_count": tables["comments_clean"]["rows"],
        }
        checks = _must(
            {
                "raw_dedup": (rows["input_rows"], rows["exact_duplicate_rows_removed"] + rows["distinct_raw_rows_retained"]),
                "transformations": (rows["distinct_raw_rows_retained"], rows["accepted_transformation_candidates"] + rows["transformation_quarantine_rows"]),
                "canonicalization": (rows["accepted_transformation_candidates"], rows["identical_clean_duplicate_id_rows_removed"] + rows["conflict_alternative_count"] - rows["conflicting_comment_id_count"] + rows["canonical_comment_count_before_fk"]),
                "foreign_keys": (rows["canonical_comment_count_before_fk"], rows["final_comments_clean_count"] + orphans["n"]),
                "comment_conflicts": (tables["comment_conflicts"]["rows"], rows["conflict_alternative_count"]),
                "comment_quarantine": (tables["comment_quarantine"]["rows"], rows["transformation_quarantine_rows"] + orphans["n"]),
            }
        )
        days = kept.agg(*[f(c).alias(f"{k}_{w}") for k, c in (("jalali", "created_at_jalali"), ("gregorian", "created_at_gregorian")) for w, f in (("min", F.min), ("max", F.max))]).first()
        audited = _by_rule(audits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")))
        audit = {
            "rows": rows,
            "quarantine_counts_by_rule": _by_rule(evidence.quarantine_counts(bad)),
            "aggregate_transformations": fields,
            "rule_event_counts": rules,
            "row_audit_counts_by_rule": audited,
            "field_quality_counts": {k: fields.get(f"comments:{v}", 0) for k, v in _QUALITY.items()} | {"invalid_ratings": audited.get("COM-006", 0) + audited.get("COM-021", 0), "over_scale_ratings": audited.get("COM-021", 0)},
            "orphan_product_id_sample": sample,
            "accepted_date_range": days.asDict(),
            "canonical_digest": {"algorithm": "SHA-256 over collision-safe length-prefixed mapped values", "fields_in_source_order": T.COMMENT_COLUMNS[1:]},
            "deterministic_sort_keys": {"comments_clean": ["comment_id"], "comment_conflicts": ["comment_id", "canonical_digest", "candidate_source_row_number"]},
            "reconciliation": {"checks_passed": checks},
        }
        _finish(spark, out, audit, {"comments_csv": source, "products_clean": products}, before, {"max_rows": max_rows}, tables)
    return audit


def _finish(spark: SparkSession, out: P.Publication, audit: dict, sources: dict[str, str], before: dict[str, str], settings: dict, tables: dict) -> None:
    """Checks that the inputs are what they were, and writes audit and manifest."""
    after = P.checksums(spark, list(sources.values()))
    if after != before:
        raise ReconciliationError("an input changed during the run")
    audit |= {"status": "success", "sources": {k: {"path": p, "sha256_before": before[p], "sha256_after": after[p], "unchanged": True} for k, p in sources.items()}, "configuration": settings, "outputs": tables}
    out.write_json("cleaning_audit.json", audit)
    versions = {"catalogq": __version__, "pyspark": pyspark.__version__}
    run = P.run_id({k: before[p] for k, p in sources.items()}, settings | versions)
    out.write_json("run_manifest.json", {"status": "success", "run_id": run, "sources": audit["sources"], "configuration": settings, "versions": versions, "outputs": tables})


def category_inventory(spark: SparkSession, products: str, offers: str, comments: DataFrame, target: str, force: bool = False, named: list[tuple[str, str]] | None = None, expected: tuple[dict, dict] | None = None) -> DataFrame:
    """The inventory per scope as parquet, CSV and Markdown. A scope is a pair of categories, so the report is small.

    ``named`` scopes are shown beside the best ones; ``expected`` gives a scope and figures it must have, or nothing is written.
    """
    inv = cut(scopes.inventory(spark.read.parquet(products), spark.read.parquet(offers).select("product_id", F.col("price_raw").alias("price")), comments, ["category1", "category2"]))
    if broken := scopes.broken_invariants(inv).count():
        raise ReconciliationError(f"{broken} scopes contradict themselves")
    if expected and (unmet := scopes.unmet(inv, *expected)):
        raise ReconciliationError(f"{expected[0]}: {unmet}")
    with P.publication(spark, target, force) as out:
        ordered = scopes.report(inv).orderBy("scope_level", "category1", "category2")
        ordered.write.parquet(f"{out.path}/inventory")
        columns = ordered.columns
        out.write_text("inventory.csv", P.csv_report((r.asDict() for r in ordered.toLocalIterator()), columns))
        cols = ["category1", "category2", "product_count", "comment_count", "products_with_comments", *(f"products_with_at_least_{k}_comments" for k in scopes.STEPS), "median_comments_per_commented_product", "p95_comments_per_commented_product", "non_empty_body_count", "unique_brand_count", "historical_price_coverage_pct"]
        ten = F.col("products_with_at_least_10_comments").desc()
        pairs = ordered.where("scope_level = 'category1_category2'").orderBy(ten, F.col("products_with_comments").desc(), F.col("comment_count").desc(), "category1", "category2").limit(20)
        wholes = ordered.where("scope_level = 'category1'").orderBy(ten, "category1").limit(20)
        sections = [("Top 20 pairs of categories", pairs), ("Category1 summary", wholes)]
        if named:
            asked = spark.createDataFrame([(i, *x) for i, x in enumerate(named)], "__place int, __a string, __b string")
            sections.append(("Selected comparison scopes", ordered.join(F.broadcast(asked), F.col("category1").eqNullSafe(F.col("__a")) & F.col("category2").eqNullSafe(F.col("__b"))).orderBy("__place")))
        text = "# Category inventory\n" + "".join(f"\n## {t}\n\n{P.markdown_table([r.asDict() for r in df.collect()], cols)}" for t, df in sections)
        out.write_text("inventory.md", text)
    return inv


# Columns whose distribution a profile always tells, and those whose values it never lists.
DISTRIBUTED = ["rate", "recommendation_status", "is_buyer"]
UNLISTED = ["title", "body", "description", "id", "product_id"]


def profile_file(spark: SparkSession, path: str, max_rows: int | None = None) -> dict:
    """Profile of a delimited file of unknown columns; one row per column and listed value comes to the driver."""
    encoding, sep = sniff(path)
    df = cut(read_text(spark, path, max_rows=max_rows))
    columns = [c for c in df.columns if c != "source_row"]
    kind = dataset_kind(path, columns)
    rows = df.count()
    per = {r["column"]: r.asDict() for r in profile.column_profile(df, columns).collect()} if columns and rows else {}
    numeric = {c for c, r in per.items() if r["numeric"] and (not r["not_numeric"] or c.lower() in ("price", "rate"))}
    listed = [c for c in columns if c.lower() not in UNLISTED and c not in numeric]
    few = profile.few_valued(df, listed, profile.DISTRIBUTION) if listed and rows else []
    top: dict[str, dict[str, int]] = {}
    for r in profile.top_values(df, few, "source_row", 20).orderBy("column", "place").collect() if few else []:
        top.setdefault(r["column"], {})[r["value"]] = r["n"]
    report = {
        "source_file": path,
        "dataset_type": kind,
        "encoding": encoding,
        "delimiter": "\\t" if sep == "\t" else sep,
        "rows": rows,
        "column_names": columns,
        "columns_count": len(columns),
        "columns": [{"name": c, "missing_count": per[c]["missing"] if c in per else 0, "missing_percent": round(per[c]["missing"] / rows * 100, 2) if rows else 0.0} for c in columns],
        "numeric_statistics": {c: {"min": per[c]["least"], "max": per[c]["greatest"], "mean": per[c]["total"] / per[c]["numeric"]} for c in columns if c in numeric},
        "top_value_counts": top,
        "validation": _validation(df, kind, columns, rows) if kind in ("products", "comments") else {},
    }
    return report


def _validation(df: DataFrame, kind: str, columns: list[str], rows: int) -> dict:
    out: dict = {}
    ids = df.withColumn("__id", normal_id(F.col("id"))) if "id" in columns else df.withColumn("__id", F.lit(None).cast("string"))
    figures = dedup.duplicate_id_figures(ids, "__id").first()
    repeated = rows - df.groupBy(G.text_fingerprint([F.col(c) for c in columns])).agg(F.lit(1)).count()
    missing = ids.where(F.col("__id").isNull()).count() if "id" in columns else 0
    out["id"] = {"missing_count": missing, "exact_full_row_duplicate_count": repeated, "duplicate_id_excess_row_count": figures["excess_rows"], "duplicated_unique_id_count": figures["repeated_ids"], "is_unique": figures["excess_rows"] == 0}
    if kind == "products":
        there = lambda c: group_value(normal_id(F.col(c))) if c in columns else F.lit("<MISSING>")
        core = ["title_fa", "Category1", "Category2", "Brand", "Rate", "Rate_cnt", "sub_category"]
        v = dedup.variation(ids, "__id", {"product_ids_with_multiple_sellers": [there("Seller")], "product_ids_with_different_prices": [there("Price")], "product_ids_with_conflicting_core_attributes": [there(c) for c in core]}).first().asDict()
        out["product_offer_variation"] = v | {"exact_duplicate_offer_count": repeated, "core_attributes": core}
    rate = find_column(columns, ["rate"])
    if rate:
        top = 100 if kind == "products" else 5
        out[rate] = {"distribution": _distribution(df, rate), f"outside_0_{top}_count": profile.outside(df, {rate: (0, top)}).first()[0]}
    if kind == "products" and "Price" in columns:
        p = profile.number_classes(df, "Price").first()
        out["Price"] = {"missing_count": p["missing"], "zero_count": p["zero"], "negative_count": p["negative"], "non_numeric_count": p["not_numeric"]}
    if kind == "comments":
        if "product_id" in columns:
            out["missing_product_id"] = df.where(normal_id(F.col("product_id")).isNull()).count()
        for c in DISTRIBUTED[1:]:
            if c in columns:
                out[c] = {"distribution": _distribution(df, c)}
    return out


def _distribution(df: DataFrame, column: str) -> dict[str, int]:
    """Values of one column with their counts, the most frequent first, ties by first appearance; a report over few values."""
    v = normal_id(F.col(column))
    n = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("source_row").alias("f"))
    return {r["v"]: r["n"] for r in n.orderBy(F.col("n").desc(), "f").toLocalIterator()}


def profile_files(spark: SparkSession, paths: list[str], max_rows: int | None = None) -> dict:
    """Profiles of several files, and of the first comments among them whether their products occur among the first products."""
    reports = [profile_file(spark, p, max_rows) for p in paths]
    first = lambda kind: next((r["source_file"] for r in reports if r["dataset_type"] == kind), None)
    products, comments, join = first("products"), first("comments"), None
    if products and comments:
        ids = read_text(spark, products, ["id"], max_rows).select(normal_id(F.col("id")).alias("product_id")).dropna().distinct()
        refs = read_text(spark, comments, ["product_id"], max_rows).select("source_row", normal_id(F.col("product_id")).alias("product_id"))
        c = profile.coverage(refs, ids, "product_id").first()
        lost = profile.first_missing(refs, ids, "product_id", "source_row", 20)
        join = {"relationship": "products.id <- comments.product_id", "orphan_comment_count": c["rows"] - c["known_rows"], "orphan_product_ids_sample": sorted(r["product_id"] for r in lost.collect())}
    return {"max_rows": max_rows, "datasets": reports, "join_validation": join}


def write_profile(report: dict, target: str, force: bool = False) -> None:
    with P.publication(SparkSession.active(), target, force) as out:
        out.write_json("dataset_profile.json", report)
        lines = ["# Profile"]
        for d in report["datasets"]:
            lines += ["", f"## {d['dataset_type'].title()}: `{d['source_file']}`", "", f"- Shape: **{d['rows']:,} rows × {d['columns_count']} columns**", f"- Encoding: `{d['encoding']}`", f"- Delimiter: `{d['delimiter']}`", ""]
            lines.append(P.markdown_table(d["columns"], ["name", "missing_count", "missing_percent"]))
            lines += ["### Numeric statistics", "", P.markdown_table([{"name": k, **v} for k, v in d["numeric_statistics"].items()], ["name", "min", "max", "mean"]), "### Top categorical values", ""]
            lines += [f"- **{k}:** " + ", ".join(f"`{v}` ({n:,})" for v, n in counts.items()) for k, counts in d["top_value_counts"].items()]
            lines += ["", "### Dataset validation", "", "```json", json.dumps(d["validation"], ensure_ascii=False, indent=2), "```"]
        if report["join_validation"] is not None:
            lines += ["", "## Join validation", "", "```json", json.dumps(report["join_validation"], ensure_ascii=False, indent=2), "```"]
        out.write_text("dataset_profile.md", "\n".join(lines) + "\n")


def read_report(path: str) -> dict | None:
    """An earlier report, None where there is none."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return None
