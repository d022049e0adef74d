"""Rules over raw rows: typed values, and as evidence events, counters and quarantine.

A rule is data: where it applies and whether it makes a row unusable; the catalogue says whether its events are kept as
records or only counted. ``with_events`` evaluates all rules of a side in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogq.operators.rules import CATALOGUE


@dataclass(frozen=True)
class Rule:
    """``when`` true makes an event of ``rule_id`` on ``field``; ``detail`` says why."""

    rule_id: str
    field: str
    when: Column
    detail: Column | None = None
    fatal: bool = False

    @property
    def row_level(self) -> bool:
        return CATALOGUE[self.rule_id].row_level


def said(reason: Column, texts: dict[str, str]) -> Column:
    """The text for a reason; null for none."""
    out = F.lit(None).cast("string")
    for k, t in texts.items():
        out = F.when(reason == k, t).otherwise(out)
    return out


def with_events(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``events``, in rule order, and ``fatal``. A condition that is null makes no event."""
    none = F.lit(None).cast("string")
    made = [
        F.when(r.when, F.struct(F.lit(r.field).alias("field"), F.col(r.field).cast("string").alias("raw_value"), F.lit(r.rule_id).alias("rule_id"), (none if r.detail is None else r.detail).alias("detail"), F.lit(r.row_level).alias("row_level")))
        for r in rules
    ]
    events = F.filter(F.array(*made), lambda e: e.isNotNull())
    fatal = F.lit(False)
    for r in rules:
        if r.fatal:
            fatal = fatal | F.coalesce(r.when, F.lit(False))
    return df.withColumns({"events": events, "fatal": fatal})


def accepted(df: DataFrame) -> DataFrame:
    return df.where(~F.col("fatal"))


def _info(rule_id: Column) -> dict[str, Column]:
    """Action, severity and loss of a rule, from the catalogue."""
    parts = {"action": lambda i: F.lit(i.action), "severity": lambda i: F.lit(i.severity), "is_lossy": lambda i: F.lit(i.lossy)}
    return {n: F.create_map(*[x for k, i in CATALOGUE.items() for x in (F.lit(k), of(i))])[rule_id] for n, of in parts.items()}


def audit_records(df: DataFrame, row: str, entity: Column, dataset: str) -> DataFrame:
    """One record per row-level event, with its position in the row and what the catalogue says of its rule."""
    e = df.select(F.lit(dataset).alias("dataset"), F.col(row).alias("source_row"), entity.alias("entity_id"), F.posexplode("events").alias("position", "e")).where("e.row_level")
    info = _info(F.col("e.rule_id"))
    return e.select("dataset", "source_row", "entity_id", "position", "e.field", "e.raw_value", "e.rule_id", info["action"].alias("action"), info["severity"].alias("severity"), "e.detail", info["is_lossy"].alias("is_lossy"))


def event_counts(df: DataFrame) -> DataFrame:
    """``rule_id``, ``n`` of the rules that made events."""
    return df.select(F.explode("events.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def zero_filled(counts: list[DataFrame], catalogue: list[str]) -> DataFrame:
    """``rule_id``, ``n`` for every rule of the catalogue, the counts added up; zero where there is none."""
    everything = counts[0].sparkSession.createDataFrame([(r, 0) for r in catalogue], "rule_id string, n bigint")
    for c in counts:
        everything = everything.unionByName(c)
    return everything.groupBy("rule_id").agg(F.sum("n").alias("n"))


def field_counts(df: DataFrame, side: str) -> DataFrame:
    """Counted-only events by side, rule and field."""
    e = df.select(F.explode("events").alias("e")).where("NOT e.row_level")
    return e.groupBy(F.lit(side).alias("side"), F.col("e.rule_id").alias("rule_id"), F.col("e.field").alias("field")).agg(F.count(F.lit(1)).alias("n"))


def quarantine(df: DataFrame, row: str, entity: Column, dataset: str, raw: list[str]) -> DataFrame:
    """Unusable rows: the sorted distinct rules of their row-level events, a joined reason and the raw record as JSON with sorted keys."""
    kept = F.filter("events", lambda e: e["row_level"])
    rules = F.array_sort(F.array_distinct(F.transform(kept, lambda e: e["rule_id"])))
    because = lambda e: F.coalesce(F.concat(F.lit(" ("), e["detail"], F.lit(")")), F.lit(""))
    reason = F.array_join(F.transform(kept, lambda e: F.concat(e["rule_id"], F.lit(": "), _info(e["rule_id"])["action"], because(e))), "; ")
    record = F.to_json(F.struct(*sorted(raw)), {"ignoreNullFields": "false"})
    return df.where("fatal").select(F.lit(dataset).alias("dataset"), F.col(row).alias("source_row"), entity.alias("entity_id"), rules.alias("rule_ids"), reason.alias("reason"), record.alias("raw_record_json"))


def quarantine_counts(quarantined: DataFrame) -> DataFrame:
    """Rows per rule; a row with several rules counts for each once."""
    return quarantined.select(F.explode("rule_ids").alias("rule_id")).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
