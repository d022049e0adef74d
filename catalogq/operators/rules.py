"""The rule catalogue: what a rule does, how grave it is, whether it loses information, whether its events are kept."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RuleInfo:
    """``row_level`` events are kept as records; others are only counted."""

    action: str
    severity: str
    lossy: bool
    row_level: bool


_SENTINELS = ["seller_code", "seller_title", "title", "body", "recommendation_status", "advantages", "disadvantages", "true_to_size_rate"]
# Rule of each comment field in which exactly ``nan`` stands for nothing, COM-013 to COM-020.
SENTINEL_RULES = {field: f"COM-{i:03d}" for i, field in enumerate(_SENTINELS, 13)}
# Action, severity, whether lossy, whether events are kept, of the rules that make events.
CATALOGUE = {
    "ID-002": RuleInfo("quarantine row", "error", True, True),
    "ID-003": RuleInfo("set invalid optional identifier to null", "warning", True, True),
    "BOOL-002": RuleInfo("quarantine row", "error", True, True),
    "TXT-001": RuleInfo("set blank text to null", "info", True, False),
    "PRD-004": RuleInfo("quarantine product candidate", "error", True, True),
    "PRD-005": RuleInfo("set product rate to null as unrated", "info", True, False),
    "PRD-006": RuleInfo("preserve zero product rate and flag", "warning", False, True),
    "PRD-007": RuleInfo("quarantine product candidate", "error", True, True),
    "OFF-003": RuleInfo("set zero price to null and flag", "warning", True, True),
    "OFF-004": RuleInfo("quarantine offer", "error", True, True),
    "OFF-007": RuleInfo("set unavailable price history to null", "info", True, False),
    "OFF-008": RuleInfo("quarantine offer with invalid price history", "error", True, True),
    "COM-005": RuleInfo("set comment rate to null as unrated", "info", True, False),
    "COM-006": RuleInfo("set invalid comment rate to null", "warning", True, True),
    "COM-009": RuleInfo("retain comment with missing body", "info", False, False),
    "COM-010": RuleInfo("preserve opaque seller code", "info", False, False),
    "COM-011": RuleInfo("retain missing seller code as null", "info", False, False),
    "COM-012": RuleInfo("set invalid optional count to null", "warning", True, True),
    **{rule: RuleInfo(f"set {field} lowercase nan sentinel to null", "info", True, False) for field, rule in SENTINEL_RULES.items()},
    "COM-021": RuleInfo("set over-scale comment rate to null", "warning", True, True),
    "DATE-003": RuleInfo("quarantine comment", "error", True, True),
}
# All rule ids a run reports on, zero where nothing happened.
_COMMON_RULES = ["RAW-001", "ID-001", "ID-002", "BOOL-001", "BOOL-002", "TXT-001", "TXT-002"]
PRODUCT_RUN_RULES = [*_COMMON_RULES, *(f"PRD-{i:03d}" for i in range(1, 9)), *(f"OFF-{i:03d}" for i in range(1, 10))]
COMMENT_RUN_RULES = [*_COMMON_RULES, *(f"COM-{i:03d}" for i in range(1, 22)), *(f"DATE-{i:03d}" for i in range(1, 5)), "JOIN-001", "JOIN-002"]

# What an event of a bad value says, per kind of value and reason.
ID_SAYS = {"number": "missing, blank, or non-numeric identifier", "fraction": "fractional identifier", "negative": "negative identifier", "range": "identifier exceeds signed int64"}
COUNT_SAYS = {"number": "missing or non-numeric integer", "fraction": "fractional integer", "negative": "integer outside non-negative signed-int64 range", "range": "integer outside non-negative signed-int64 range"}
BOOLEAN_SAYS = "unrecognized boolean; expected True or False"
RATE_SAYS = "product Rate must be numeric and within 0–100"
DATE_SAYS = {"missing": "missing Jalali date", "form": "expected D <Persian Jalali month name> YYYY", "year": "Jalali year is outside supported range 1–9377", "day": "invalid day for Jalali month and year"}
