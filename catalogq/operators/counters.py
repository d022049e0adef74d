"""Counters of whole runs: events, and what follows from the figures of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.operators import evidence
from catalogq.operators.rules import COMMENT_RUN_RULES, PRODUCT_RUN_RULES


def _counted(df: DataFrame, figures: dict[str, Column]) -> DataFrame:
    """``rule_id``, ``n`` of one-row aggregates, in one pass."""
    names = [f"f{i}" for i in range(len(figures))]
    one = df.agg(*[F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")).alias(n) for n, c in zip(names, figures.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("rule_id"), F.col(n).alias("n")) for n, rule in zip(names, figures)])))


def _has(rule_id: str) -> Column:
    return F.col("fatal") & F.array_contains("events.rule_id", rule_id)


def _groups(df: DataFrame, key: str, figures: dict[str, Column]) -> DataFrame:
    return _counted(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), figures)


def product_run_counts(products: DataFrame, offers: DataFrame, canonical: DataFrame, distinct_offers: DataFrame, final_offers: DataFrame) -> DataFrame:
    """``rule_id``, ``n`` of a run over the products file, zero-filled.

    ``products`` and ``offers``: typed rows of the distinct records (``copies``, ``fatal``, ``events``); ``canonical``: one row
    per product with ``variants``; ``distinct_offers``: accepted offers without exact repeats; ``final_offers``: those with a
    product, with ``price_raw`` and ``high_price_review``.
    """
    return evidence.zero_filled(
        [
            evidence.event_counts(products),
            evidence.event_counts(offers),
            _counted(products, {"RAW-001": F.sum("copies"), "PRD-001": F.sum(F.col("copies") - 1), "ID-001": F.count_if(~_has("ID-002"))}),
            _counted(offers, {"BOOL-001": F.count_if(~_has("BOOL-002")), "OFF-001": F.count_if(~F.col("fatal"))}),
            _counted(distinct_offers, {"OFF-001": -F.count(F.lit(1)), "OFF-009": F.count(F.lit(1))}),
            _counted(final_offers, {"OFF-009": -F.count(F.lit(1)), "OFF-005": F.count_if("high_price_review"), "OFF-006": F.count_if(F.col("price_raw") > 0)}),
            _groups(final_offers, "product_id", {"OFF-002": F.sum(F.col("n") - 1)}),
            _groups(products.where("NOT fatal"), "p_product_id", {"PRD-002": F.count_if(F.col("n") > 1)}),
            _counted(canonical, {"PRD-003": F.count_if(F.col("variants") > 1)}),
        ],
        PRODUCT_RUN_RULES,
    )


def comment_run_counts(comments: DataFrame, canonical: DataFrame, orphans: DataFrame) -> DataFrame:
    """``rule_id``, ``n`` of a run over the comments file, zero-filled.

    ``comments``: typed rows of the distinct records with their raw columns; ``canonical``: one row per comment with
    ``variants``; ``orphans``: those of them whose product does not exist.
    """
    kept = ~F.col("fatal")
    accepted = F.count_if(kept)
    return evidence.zero_filled(
        [
            evidence.event_counts(comments),
            _counted(
                comments,
                {
                    "RAW-001": F.sum("copies"), "COM-001": F.sum(F.col("copies") - 1), "ID-001": F.count_if(~_has("ID-002")), "BOOL-001": F.count_if(~_has("BOOL-002")),
                    "COM-004": F.count_if(kept & F.col("c_rate").isNotNull()), "COM-007": F.count_if(kept & (F.trim("rate") == "2500")), "COM-008": accepted,
                    "DATE-001": accepted, "DATE-002": accepted, "DATE-004": accepted,
                },
            ),
            _counted(canonical, {"COM-002": F.count_if(F.col("variants") > 1), "JOIN-001": F.count(F.lit(1))}),
            _counted(orphans, {"JOIN-001": -F.count(F.lit(1)), "JOIN-002": F.count(F.lit(1))}),
        ],
        COMMENT_RUN_RULES,
    )


def candidate_figures(candidates: DataFrame, key: str, digest: str) -> DataFrame:
    """One row on how often ids repeat among accepted candidates and how far their contents agree.

    ``digest`` stands for a candidate's clean content. repeated ids and their excess rows; ids of which at least two candidates are
    identical, and the rows that go for it; ids with several contents, and their contents; ids.
    """
    per = candidates.groupBy(key, digest).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contents"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return per.agg(
        F.count_if(F.col("n") > 1).alias("repeated_ids"),
        zero(F.sum(F.col("n") - 1)).alias("repeated_excess_rows"),
        F.count_if(F.col("n") > F.col("contents")).alias("identical_ids"),
        zero(F.sum(F.col("n") - F.col("contents"))).alias("identical_rows_removed"),
        F.count_if(F.col("contents") > 1).alias("conflicting_ids"),
        zero(F.sum(F.when(F.col("contents") > 1, F.col("contents")))).alias("conflict_alternatives"),
        F.count(F.lit(1)).alias("canonical"),
    )


def id_collisions(df: DataFrame, id_: Column, content: list[str]) -> DataFrame:
    """One row: rows with distinct ``content``, distinct ids, and ids that stand for more than one content (none, if ids are sound)."""
    per = df.groupBy(*content).agg(F.first(id_).alias("__id")).groupBy("__id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("contents"), F.count(F.lit(1)).alias("ids"), F.count_if(F.col("n") > 1).alias("collisions"))
