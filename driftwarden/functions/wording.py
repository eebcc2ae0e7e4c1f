"""Texts of reports and alerts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwarden.functions.sql import literal

# Wording that reports, records and alerts share with existing consumers.
ADDED_HINT = (
    "New columns detected (%s). "
    "Likely a upstream producer schema migration. "
    "Check source changelog or producer deployment history."
)
REMOVED_HINT = (
    "Expected columns missing (%s). "
    "Source may have dropped/renamed columns or query projection changed. "
    "Verify source DDL and any recent ALTER TABLE statements."
)
RETYPED_HINT = (
    "Column '%s' changed type '%s' -> '%s'. "
    "Common causes: upstream cast change, CSV text promotion, or ORM mapping update."
)
TRANSFORM_HINT = (
    "Custom transform function raised an exception. "
    "Check transform logic for data-dependent failures."
)
CELL_FAILURE_DETAIL = "Individual row coercion failed during healing"
NO_DRIFT = "no drift"
NO_HEALING = "no healing applied"
BACKFILLED = "backfilled missing column '%s' (%s) with null"
KEPT_NEW = "kept new columns for schema evolution: %s"
DROPPED_NEW = "dropped unexpected columns: %s"
COERCED = "coerced column '%s' from '%s' to '%s' (%d nulled)"
LOSS_EXCEEDED = "Coercion loss %.1f%% exceeds threshold {limit}%% — batch marked for quarantine"
EVOLVED = "Schema evolved to v%d. Actions: %s"

DRIFT_TITLE = "Schema Drift Detected"
QUARANTINE_TITLE = "Records Quarantined"
FAILURE_TITLE = "Pipeline Run Failed"
DRIFT_SUMMARY = "Schema drift detected in source '%s'. %s Details: %s"
HEALED_PHRASE = "Auto-healed."
UNHEALED_PHRASE = "Could NOT auto-heal — manual review required."
QUARANTINE_SUMMARY = "%d record(s) quarantined from source '%s' due to [%s]."
FAILURE_SUMMARY = "Pipeline '%s' failed: %s"
DRIFT_ACTIONS = [
    "Review drift_events table for full change details.",
    "Notify the upstream data producer of the schema change.",
]
HEALED_ACTIONS = [
    "Validate the healed output sample before promoting to production.",
    "Update downstream consumers if new columns were added.",
]
UNHEALED_ACTIONS = [
    "Manual intervention required — check quarantine_records.",
    "Fix schema or healing config, then re-run the pipeline.",
]
QUARANTINE_ACTIONS = [
    "Review quarantine_records table for affected rows.",
    "Identify whether issue is systemic or isolated batch.",
    "Re-run with healing enabled after fixing upstream.",
]
FAILURE_ACTIONS = [
    "Check pipeline logs for full traceback.",
    "Verify source connectivity and credentials.",
    "Inspect quarantine store for partial loads.",
]
FAILURE_HINTS = [
    "Check the Spark application logs for the full traceback.",
    "Verify source file/connection is accessible.",
]
SEVERITIES = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
COLORS = {
    "DEBUG": "#95a5a6",
    "INFO": "#3498db",
    "WARNING": "#f39c12",
    "ERROR": "#e74c3c",
    "CRITICAL": "#8e44ad",
}
NOTHING_LISTED = "_none_"
# end of fixed values
MALFORMED_DETAIL = "The line could not be read"
MALFORMED_HINT = "Check the writer of the file: quoting, line ends, or a write that was cut short."


def texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def quoted(name: str) -> str:
    """SQL for a name in quotes, escaped the way a Python list prints it."""
    escaped = f"replace({name}, {literal(chr(92))}, {literal(chr(92) * 2)})"
    single, double = literal("'"), literal('"')
    plain = f"concat({single}, {escaped}, {single})"
    wrapped = f"concat({double}, {escaped}, {double})"
    both = f"concat({single}, replace({escaped}, {single}, {literal(chr(92) + chr(39))}), {single})"
    has_single, has_double = f"contains({name}, {single})", f"contains({name}, {double})"
    return f"CASE WHEN NOT {has_single} THEN {plain} WHEN NOT {has_double} THEN {wrapped} ELSE {both} END"


def listed(names: str) -> str:
    """SQL for an array of names as ``['a', 'b']``."""
    return f"concat('[', array_join(transform({names}, n -> {quoted('n')}), ', '), ']')"


def some(values: Column) -> Column:
    return F.size(values) > 0
