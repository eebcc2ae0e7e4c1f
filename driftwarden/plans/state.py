"""State between loads: append-only tables in one folder, nothing updated in place.

A run writes its own (source_name, run_id) partition. A repeated run first forgets what its earlier
attempt wrote, so nothing of that is left even where the new attempt has no rows. One writer per source is
assumed: files give no transaction.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.operators import ledger, quarantine
from driftwarden.options import Options
from driftwarden.operators.alerts import ALERTS
from driftwarden.operators.joins import bounded_join
from driftwarden.scratch import configured, cut, partition_value, remove_matching
from driftwarden.sources import sinks
from driftwarden.sources.sinks import path_missing

# The columns of the run table.
RUNS = """
    run_id string, pipeline_name string, source_name string, status string, rows_extracted bigint,
    rows_loaded bigint, rows_quarantined bigint, drift_detected boolean, started_at timestamp,
    finished_at timestamp, error_message string, seq int
"""
SNAPSHOTS = "snapshot int, made_at timestamp"
COMMITS = "run_id string, attempt int, committed_at timestamp"
_BY_RUN = ["source_name", "run_id"]
_WRITERS = 8  # folders that a task writes to at once; only a task with rows for more of them sorts its rows


class State:
    def __init__(self, spark: SparkSession, folder: str, options: Options | None = None):
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options or Options()

    def _read(self, name: str, ddl: str) -> DataFrame:
        shape = T.DataType.fromDDL(ddl)
        try:
            return self.spark.read.schema(shape).parquet(f"{self.folder}/{name}").select(*shape.names)
        except AnalysisException as exc:
            if path_missing(exc):
                return self.spark.createDataFrame([], shape)
            raise

    def read(self, name: str, ddl: str) -> DataFrame:
        """A table that others keep beside the state's own."""
        return self._read(name, ddl)

    def append(self, name: str, ddl: str, rows: DataFrame) -> None:
        self._append(name, ddl, rows)

    def _append(self, name: str, ddl: str, rows: DataFrame) -> None:
        rows.select(*T.DataType.fromDDL(ddl).names).write.mode("append").parquet(f"{self.folder}/{name}")

    def _replace_run(self, name: str, ddl: str, rows: DataFrame) -> None:
        # what is left over from many tasks goes into files of a sensible size, hot partitions split
        writer = (
            rows.select(*T.DataType.fromDDL(ddl).names)
            .hint("rebalance")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_BY_RUN)
        )
        with configured(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(_WRITERS)):
            writer.parquet(f"{self.folder}/{name}")

    def forget(self, run_id: str) -> None:
        """Remove what an earlier attempt of a run recorded; its run events stay."""
        key = partition_value(self.spark, run_id)
        for name in ("schema_versions", self._records_table(), "quarantine_daily", "drift_events", "alerts"):
            remove_matching(self.spark, f"{self.folder}/{name}/source_name=*/run_id={key}")

    # -- attempts and commits ------------------------------------------------------------------

    def next_attempt(self, run_id: str) -> int:
        """The number of the attempt that a run begins now; earlier ones keep theirs."""
        before = self.run_events().where(F.col("run_id") == run_id).agg(F.max("seq")).first()[0]
        return 0 if before is None else before // 2 + 1

    def commits(self) -> DataFrame:
        """(run_id, attempt): the attempt of each run that counts."""
        return self._read("load_commits", COMMITS).groupBy("run_id").agg(F.max("attempt").alias("attempt"))

    def commit(self, run_id: str, attempt: int, at: Column) -> None:
        """Make what an attempt has put into sinks and resolved count, and what earlier attempts did no longer."""
        entry = self.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"), at.alias("committed_at"))
        self._append("load_commits", COMMITS, entry)

    def loaded(self, destination: str, path: str, table: str | None = None) -> DataFrame:
        """The rows of a sink that committed attempts have put there."""
        return sinks.committed(self.spark, destination, path, self.commits(), table, self.options)

    # -- schema versions -----------------------------------------------------------------------

    def versions(self) -> DataFrame:
        return self._read("schema_versions", ledger.VERSIONS)

    def write_versions(self, rows: DataFrame) -> None:
        self._replace_run("schema_versions", ledger.VERSIONS, rows)

    def active(self, source_names: list[str], before_run: str | None = None) -> DataFrame:
        """Active schemas of some sources; a repeated run does not see its own registrations."""
        found = self.versions().where(F.col("source_name").isin(*source_names))
        if before_run is not None:
            found = found.where(F.col("run_id") != before_run)
        return ledger.active(found)

    # -- quarantine ----------------------------------------------------------------------------

    def _records_table(self) -> str:
        newest = self._read("quarantine_snapshots", SNAPSHOTS).agg(F.max("snapshot")).first()[0]
        return f"quarantine_records/snapshot={newest or 0}"

    def records(self, without_run: str | None = None) -> DataFrame:
        """Quarantined records of the newest complete snapshot, with ``resolved``.

        ``without_run``: as if that run had resolved nothing.
        """
        stored = self._read(self._records_table(), quarantine.RECORDS)
        return quarantine.with_resolution(stored, self.resolutions(without_run), self.options)

    def resolutions(self, without_run: str | None = None) -> DataFrame:
        """What was resolved by hand or by an attempt that counts."""
        found = self._read("quarantine_resolutions", quarantine.RESOLUTIONS)
        if without_run is not None:
            found = found.where(F.coalesce(F.col("run_id") != without_run, F.lit(True)))
        by_run = bounded_join(found.where("run_id IS NOT NULL"), self.commits(), ["run_id", "attempt"], self.options, "left_semi")
        return found.where("run_id IS NULL").unionByName(by_run)

    def write_resolutions(self, ids: DataFrame, run_id: str, attempt: int, at: Column) -> None:
        """Ids that an attempt resolves, from its commit on."""
        mark = {"resolved_at": at, "run_id": F.lit(run_id), "attempt": F.lit(attempt)}
        self._append("quarantine_resolutions", quarantine.RESOLUTIONS, ids.select("id").withColumns(mark))

    def write_records(self, rows: DataFrame) -> None:
        self._replace_run(self._records_table(), quarantine.RECORDS, rows)
        # counted from what was written, so that a run's records are made once
        runs = rows.select(*_BY_RUN).distinct()
        written = bounded_join(self._read(self._records_table(), quarantine.RECORDS), cut(runs), _BY_RUN, self.options, "left_semi")
        self._replace_run("quarantine_daily", quarantine.DAILY, quarantine.daily(written))

    def trend(self) -> DataFrame:
        """Records per day, source and error type: sums of the daily counts of the runs, which a purge leaves as they are."""
        return quarantine.trend(self._read("quarantine_daily", quarantine.DAILY))

    def mark_resolved(self, ids: DataFrame | list[str], at: Column | None = None) -> int:
        """Resolve records by id; the count is of the ids that were found."""
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
        found = quarantine.matching(self._read(self._records_table(), quarantine.RECORDS), ids)
        when = at if at is not None else F.current_timestamp()
        nobody = {"run_id": F.lit(None).cast("string"), "attempt": F.lit(None).cast("int")}
        # counted while they are written
        seen = Observation()
        resolved = found.withColumns({"resolved_at": when, **nobody}).observe(seen, F.count(F.lit(1)).alias("rows"))
        self._append("quarantine_resolutions", quarantine.RESOLUTIONS, resolved)
        return seen.get["rows"]

    def purge(self, older_than_days: int, now: Column | None = None) -> int:
        """Drop old resolved records; only the partitions (source, run) that have some are written again.

        A purge that is cut short has done some partitions; the next one does the rest.
        """
        # one point in time for the count and for what is dropped
        now = F.lit(self.spark.range(1).select(now if now is not None else F.current_timestamp()).first()[0])
        stored, old = self.records(), quarantine.outdated(older_than_days, now)
        hit = cut(stored.groupBy(*_BY_RUN).agg(F.count_if(old).alias("gone"), F.count_if(~F.coalesce(old, F.lit(False))).alias("left")).where("gone > 0"))
        gone = hit.agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]
        if gone:
            some = bounded_join(stored, hit.select(*_BY_RUN), _BY_RUN, self.options, "left_semi")
            # a folder cannot be written while it is read: what stays is kept apart first
            kept = cut(quarantine.purged(some, older_than_days, now))
            self._replace_run(self._records_table(), quarantine.RECORDS, kept)
            for row in hit.where("left = 0").select(*_BY_RUN).toLocalIterator():
                source, run = (partition_value(self.spark, row[c]) for c in _BY_RUN)
                remove_matching(self.spark, f"{self.folder}/{self._records_table()}/source_name={source}/run_id={run}")
        return gone

    # -- drift events, alerts, runs ---------------------------------------------------------------

    def drift_events(self) -> DataFrame:
        return self._read("drift_events", quarantine.EVENTS)

    def write_drift_events(self, rows: DataFrame) -> None:
        self._replace_run("drift_events", quarantine.EVENTS, rows)

    def alerts(self) -> DataFrame:
        return self._read("alerts", ALERTS)

    def write_alerts(self, rows: DataFrame) -> None:
        self._replace_run("alerts", ALERTS, rows)

    def add_alerts(self, rows: DataFrame) -> None:
        """Alerts next to those the run has."""
        columns = T.DataType.fromDDL(ALERTS).names
        rows.select(*columns).write.mode("append").partitionBy(*_BY_RUN).parquet(f"{self.folder}/alerts")

    def run_events(self) -> DataFrame:
        return self._read("pipeline_runs", RUNS)

    def add_run_event(self, event: DataFrame) -> None:
        self._append("pipeline_runs", RUNS, event)

    def runs(self) -> DataFrame:
        return latest_runs(self.run_events())


def latest_runs(events: DataFrame) -> DataFrame:
    """One row per run: its last event."""
    fields = [c for c in events.columns if c != "run_id"]
    last = events.groupBy("run_id").agg(F.max_by(F.struct(*fields), "seq").alias("last"))
    return last.select("run_id", *[F.col(f"last.{c}").alias(c) for c in fields if c != "seq"])


OPENED, CLOSED = 0, 1


def run_event(
    spark: SparkSession,
    run_id: str,
    pipeline_name: str,
    source_name: str,
    status: str,
    counts: dict,
    started_at,
    finished_at=None,
    error: str | None = None,
    attempt: int = 0,
) -> DataFrame:
    """One event of a run; later attempts of a run id count on, so its last event is well defined."""
    row = (
        run_id, pipeline_name, source_name, status,
        counts.get("rows_extracted", 0), counts.get("rows_loaded", 0), counts.get("rows_quarantined", 0),
        counts.get("drift_detected", False), started_at, finished_at, error,
        2 * attempt + (OPENED if status == "RUNNING" else CLOSED),
    )
    return spark.createDataFrame([row], RUNS)
