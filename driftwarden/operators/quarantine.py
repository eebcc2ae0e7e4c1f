"""Quarantined records and drift events as ordinary frames: review, resolve, purge, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.functions import wording as W
from driftwarden.operators import drift
from driftwarden.operators.joins import bounded_join
from driftwarden.options import Options
from driftwarden.sources.pieces import BATCH, SOURCE

RECORDS = """
    source_name string, run_id string, id string, pipeline_name string, batch_id string,
    column_name string, record_json string, error_type string, error_detail string,
    root_cause_hint string, schema_version int, quarantined_at timestamp
"""
RESOLUTIONS = "id string, resolved_at timestamp, run_id string, attempt int"
DAILY = "source_name string, run_id string, day date, error_type string, n bigint"
EVENTS = """
    source_name string, run_id string, id string, pipeline_name string, batch_id string,
    drift_type string, details_json string, healed boolean, healing_action string,
    detected_at timestamp
"""


def records(quarantined: DataFrame, pipeline_name: str, run_id: str, at: Column) -> DataFrame:
    """Healing output in store form.

    The id is a digest of where the record came from and what it holds, so repeating a run
    writes the same ids; exact copies within one batch share theirs.
    """
    digest = F.sha2(
        F.concat_ws("\x1f", F.lit(run_id), "source_name", "batch_id", "error_type",
                    F.coalesce("column_name", F.lit("")), "record_json"), 256
    )
    return quarantined.select(
        "source_name", F.lit(run_id).alias("run_id"), digest.alias("id"),
        F.lit(pipeline_name).alias("pipeline_name"), "batch_id", "column_name", "record_json",
        "error_type", "error_detail", "root_cause_hint", "schema_version", at.alias("quarantined_at"),
    )


def drift_events(plan: DataFrame, pipeline_name: str, run_id: str, at: Column) -> DataFrame:
    """One unhealed event per drifted batch, and a healed one where a new version was registered."""
    evolved = F.col("evolved_to").isNotNull()
    action = F.format_string(W.EVOLVED, F.col("evolved_to"), healing_summary())
    seen = F.struct(F.lit(False).alias("healed"), F.lit("").alias("healing_action"))
    healed = F.struct(F.lit(True).alias("healed"), action.alias("healing_action"))
    entries = F.when(evolved, F.array(seen, healed)).otherwise(F.array(seen))
    return (
        plan.where("has_drift")
        .withColumn("_details", drift.details_json())
        .withColumn("_event", F.explode(entries))
        .select(
            F.col(SOURCE).alias("source_name"), F.lit(run_id).alias("run_id"),
            F.sha2(F.concat_ws("\x1f", F.lit(run_id), SOURCE, F.col(BATCH).cast("string"),
                               F.col("_event.healed").cast("string")), 256).alias("id"),
            F.lit(pipeline_name).alias("pipeline_name"), F.col(BATCH).cast("string").alias("batch_id"),
            F.col("drift_types").alias("drift_type"), F.col("_details").alias("details_json"),
            "_event.healed", "_event.healing_action", at.alias("detected_at"),
        )
    )


def healing_summary() -> Column:
    text = F.array_join("actions", "; ")
    return F.when(text == "", F.lit(W.NO_HEALING)).otherwise(text)


def with_resolution(stored: DataFrame, resolutions: DataFrame, options: Options | None = None) -> DataFrame:
    """Records with ``resolved``, told from the ids that were resolved since."""
    done = resolutions.select("id").distinct().withColumn("_done", F.lit(True))
    joined = bounded_join(stored, done, ["id"], options or Options(), "left", salts=1)
    return joined.withColumn("resolved", F.col("_done").isNotNull()).drop("_done")


def matching(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids among ``ids`` that are really stored; copies of a record count once."""
    return ids.select("id").distinct().join(stored.select("id").distinct().hint("merge"), "id")


def latest(
    stored: DataFrame,
    source_name: str | None = None,
    run_id: str | None = None,
    error_type: str | None = None,
    resolved: bool = False,
    limit: int = 500,
) -> DataFrame:
    """Newest records first; equal times are ordered by id."""
    found = stored.where(F.col("resolved") == resolved)
    for column, value in (("source_name", source_name), ("run_id", run_id), ("error_type", error_type)):
        if value:
            found = found.where(F.col(column) == value)
    return found.orderBy(F.desc("quarantined_at"), "id").limit(limit)


def latest_events(events: DataFrame, source_name: str | None = None, limit: int = 100) -> DataFrame:
    found = events.where(F.col("source_name") == source_name) if source_name else events
    return found.orderBy(F.desc("detected_at"), "id").limit(limit)


def outdated(older_than_days: int, now: Column) -> Column:
    """Condition "resolved, and older than the given number of days"."""
    age_limit = now - F.make_dt_interval(F.lit(older_than_days))
    return F.col("resolved") & (F.col("quarantined_at") < age_limit)


def purged(stored: DataFrame, older_than_days: int, now: Column) -> DataFrame:
    """What a purge leaves: unresolved records stay, however old."""
    return stored.where(~F.coalesce(outdated(older_than_days, now), F.lit(False)))


def stats(stored: DataFrame, pipeline_name: str | None = None) -> DataFrame:
    """Total, unresolved and resolved in one pass."""
    chosen = stored.where(F.col("pipeline_name") == pipeline_name) if pipeline_name else stored
    return chosen.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
        F.count_if("resolved").alias("resolved"),
    )


def stats_sets(stored: DataFrame, pipeline_name: str | None = None) -> DataFrame:
    """Counts overall, by error type and by source, in one aggregation."""
    chosen = stored.where(F.col("pipeline_name") == pipeline_name) if pipeline_name else stored
    kind, source = F.col("error_type"), F.col("source_name")
    sets = chosen.groupingSets([[], [kind], [source]], kind, source)
    return sets.agg(F.count(F.lit(1)).alias("n"))


def count_by(stored: DataFrame, key: str | Column) -> DataFrame:
    return stored.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def daily(records: DataFrame) -> DataFrame:
    """Counts of a run's records per day and error type: rows that add up over runs."""
    day = F.to_date("quarantined_at").alias("day")
    return records.groupBy("source_name", "run_id", day, "error_type").agg(F.count(F.lit(1)).alias("n"))


def trend(counts: DataFrame) -> DataFrame:
    """Records per day, source and error type."""
    return counts.groupBy("day", "source_name", "error_type").agg(F.sum("n").alias("n"))
