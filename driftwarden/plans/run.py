"""A run: one load recorded from opening to closing."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.operators import alerts, ledger, quarantine
from driftwarden.options import Options
from driftwarden.plans.load import Load, Transform
from driftwarden.plans.state import State, run_event
from driftwarden.sources.frames import pieces_of
from driftwarden.sources.pieces import BATCH, SOURCE, Piece, with_own_names
from driftwarden.sources.sinks import drop_attempts, load_into

RUNNING, SUCCESS, FAILED = "RUNNING", "SUCCESS", "FAILED"


def new_run_id(now: datetime | None = None) -> str:
    """``run-<UTC time>-<6 hex digits>``."""
    now = now or datetime.now(UTC)
    return f"run-{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:6]}"


def run(
    spark: SparkSession,
    state: State,
    source_name: str,
    destination: str,
    *,
    source_type: str = "dataframe",
    source_path: str | list[str] | None = None,
    source_frame: DataFrame | None = None,
    pieces: list[Piece] | None = None,
    source_options: dict | None = None,
    destination_path: str | None = None,
    destination_table: str | None = None,
    custom_transform: Transform | None = None,
    options: Options | None = None,
    run_id: str | None = None,
    now: datetime | None = None,
) -> dict:
    """Load one source and record schema versions, events, quarantine, alerts and the run itself.

    Repeating a run id replaces what that run recorded, and its rows in a sink of files: the attempt's rows count from its commit on
    (``State.loaded``), which is one entry. A failure is recorded, with an alert next to those the load
    raised before it, and raised again.
    """
    options = options or Options()
    run_id = run_id or new_run_id(now)
    started = now or datetime.now(UTC)
    at = F.lit(started)
    summary = {
        "run_id": run_id, "source": source_name, "status": "UNKNOWN", "rows_extracted": 0,
        "rows_loaded": 0, "rows_quarantined": 0, "schema_evolved": False, "drift_detected": False,
    }

    def record(status: str, error: str | None = None) -> None:
        finished = None if status == RUNNING else (now or datetime.now(UTC))
        state.add_run_event(run_event(
            spark, run_id, options.pipeline_name, source_name, status, summary, started, finished, error, attempt
        ))

    attempt = state.next_attempt(run_id)
    if attempt:
        state.forget(run_id)
    record(RUNNING)
    try:
        if pieces is None:
            how = dict(source_options or {})
            if options.batch_by == "rows":
                how.setdefault("batch_rows", options.batch_size)
            pieces = pieces_of(spark, source_type, source_name, source_path, source_frame, **how)
        load = Load(pieces, options, state.active([source_name], before_run=run_id), custom_transform)
        plan = load.plan
        totals = load.totals.first()
        if totals is not None:
            summary.update({k: v for k, v in totals.asDict().items() if k in summary})

        state.write_drift_events(quarantine.drift_events(plan, options.pipeline_name, run_id, at))
        state.write_records(quarantine.records(load.quarantined, options.pipeline_name, run_id, at))
        state.write_versions(ledger.registrations(plan, run_id, at))
        state.write_alerts(alerts.plan_alerts(plan, options, run_id, at))

        rows = with_own_names(load.clean.drop(SOURCE, BATCH))
        summary["rows_loaded"] = load_into(rows, destination, destination_path, destination_table, load=(run_id, attempt))
        state.commit(run_id, attempt, at)
        drop_attempts(spark, destination, destination_path, (run_id, attempt), destination_table)
        summary["status"] = SUCCESS
    except Exception as exc:
        summary["status"], summary["error"] = FAILED, str(exc)
        record(FAILED, summary["error"])
        failed = state.runs().where((F.col("run_id") == run_id) & (F.col("status") == FAILED))
        raised = alerts.failure_alerts(failed, at, f"Source: {source_type}  Destination: {destination}")
        state.add_alerts(alerts.at_least(raised, options.min_severity))
        raise
    record(SUCCESS)
    return summary
