"""Quarantined records once more: parsed back, healed against the schema of today, and resolved where they pass.

A record's JSON text is read back as the JSON source reads its lines, columns that the active schema holds as times are read as times,
and a load like any other judges and heals them. A record is not judged by its batch, though: rows whose cells all fit go to the
sink, and their ids are resolved; the others stay in quarantine as they are, without a new record.

Rows, resolutions and new schema versions of an attempt count from one commit on, so a replay that fails or is repeated under its run id
loads nothing twice. A record that an earlier replay has resolved is not replayed again.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.functions.buckets import DATETIME
from driftwarden.operators import ledger, quarantine
from driftwarden.options import Options
from driftwarden.plans.load import Load, Transform
from driftwarden.plans.run import FAILED, RUNNING, SUCCESS, new_run_id
from driftwarden.plans.state import State, run_event
from driftwarden.plans.step import HEALING_FAILED, SCHEMA_DRIFT, TRANSFORM_ERROR
from driftwarden.scratch import cut
from driftwarden.sources.json_lines import REST, key_values, keys_of, tokens
from driftwarden.sources.pieces import BATCH, SOURCE, TOKENS, Piece, safe_name, tag, with_own_names
from driftwarden.sources.sinks import drop_attempts, load_into

#: Rows of these are not in the sink. Under ``keep_nulled`` a row with a failed cell is, so its records are replayed only when asked for.
REPLAYED = (SCHEMA_DRIFT, HEALING_FAILED, TRANSFORM_ERROR)
IDS = "_ids"
#: The form in which records hold times.
RECORD_TIMES = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def rows_of(records: DataFrame) -> DataFrame:
    """The rows that records were made of: where from, the record, its ids, and how many copies there were.

    A row has a record for each failed cell, and copies of a row share their ids.
    """
    key = ["run_id", "batch_id", "record_json"]
    cells = records.groupBy(*key, "error_type", "column_name").agg(F.count(F.lit(1)).alias("copies"), F.first("id").alias("id"))
    return cells.groupBy(*key).agg(F.max("copies").alias("copies"), F.collect_set("id").alias(IDS))


def record_piece(rows: DataFrame, source_name: str, active: dict[str, str]) -> Piece:
    """Rows of records as a layout of JSON text; a batch is the batch they came from."""
    lines = rows.select(
        F.concat_ws("/", "run_id", "batch_id").alias(BATCH), IDS, F.col("record_json").alias("_line"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("_n"),
    ).drop("_n")
    keys, others = keys_of(lines)
    parsed = lines.withColumn(TOKENS, tokens())
    names = [safe_name(k) for k in keys]
    dated = frozenset(n for k, n in zip(keys, names, strict=True) if active.get(n, active.get(k)) == DATETIME)
    inferred = dict.fromkeys(names, "json") | ({REST: "rest"} if others else {})
    frame = tag(parsed.select(BATCH, TOKENS, IDS, *key_values(keys, others)), source_name, F.col(BATCH))
    return Piece(frame, inferred, carried=(IDS,), dated=dated)


def replay_load(
    spark: SparkSession, state: State, source_name: str, records: DataFrame, options: Options, custom_transform: Transform | None, run_id: str
) -> Load:
    """The load of some records against the active schema; only a change of schema is registered."""
    active = state.active([source_name], before_run=run_id)
    row = active.first()
    piece = record_piece(cut(rows_of(records)), source_name, dict(row["schema"]) if row else {})
    formats = (RECORD_TIMES, *(f for f in options.datetime_formats if f != RECORD_TIMES))
    own = options.but(
        max_coercion_loss_pct=100.0, on_coercion_failure="exclude", register_unchanged=False, datetime_formats=formats
    )
    return Load([piece], own, active, custom_transform)


def replay(
    spark: SparkSession,
    state: State,
    source_name: str,
    destination: str,
    *,
    destination_path: str | None = None,
    destination_table: str | None = None,
    error_types: tuple[str, ...] = REPLAYED,
    from_run: str | None = None,
    custom_transform: Transform | None = None,
    options: Options | None = None,
    run_id: str | None = None,
    now: datetime | None = None,
) -> dict:
    """Load what can be loaded of a source's unresolved records, and resolve it.

    Returns the run's counts: rows replayed (``rows_extracted``), loaded, left in quarantine, and the ids resolved.
    """
    options = options or Options()
    run_id, started = run_id or new_run_id(now), now or datetime.now(UTC)
    at = F.lit(started)
    summary = {
        "run_id": run_id, "source": source_name, "status": "UNKNOWN", "rows_extracted": 0, "rows_loaded": 0,
        "rows_quarantined": 0, "ids_resolved": 0, "schema_evolved": False, "drift_detected": False,
    }
    attempt = state.next_attempt(run_id)

    def record(status: str, error: str | None = None) -> None:
        finished = None if status == RUNNING else (now or datetime.now(UTC))
        state.add_run_event(run_event(
            spark, run_id, options.pipeline_name, source_name, status, summary, started, finished, error, attempt
        ))

    if attempt:
        state.forget(run_id)
    record(RUNNING)
    try:
        found = state.records(without_run=run_id).where((F.col("source_name") == source_name) & ~F.col("resolved"))
        found = found.where(F.col("error_type").isin(*error_types))
        if from_run is not None:
            found = found.where(F.col("run_id") == from_run)
        load = replay_load(spark, state, source_name, found, options, custom_transform, run_id)
        totals = load.totals.first()
        if totals is not None:
            summary.update({k: totals[k] for k in ("rows_extracted", "schema_evolved", "drift_detected")})
            state.write_drift_events(quarantine.drift_events(load.plan, options.pipeline_name, run_id, at))
            state.write_versions(ledger.registrations(load.plan, run_id, at))
            rows = with_own_names(load.clean.drop(SOURCE, BATCH, IDS))
            summary["rows_loaded"] = load_into(rows, destination, destination_path, destination_table, load=(run_id, attempt))
            passed = load.clean.select(F.explode(IDS).alias("id")).distinct()
            state.write_resolutions(passed, run_id, attempt, at)
        summary["rows_quarantined"] = summary["rows_extracted"] - summary["rows_loaded"]
        state.commit(run_id, attempt, at)
        drop_attempts(spark, destination, destination_path, (run_id, attempt), destination_table)
        summary["ids_resolved"] = state.resolutions().where((F.col("run_id") == run_id) & (F.col("attempt") == attempt)).count()
        summary["status"] = SUCCESS
    except Exception as exc:
        summary["status"], summary["error"] = FAILED, str(exc)
        record(FAILED, summary["error"])
        raise
    record(SUCCESS)
    return summary
