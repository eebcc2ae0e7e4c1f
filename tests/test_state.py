import glob
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.fixtures import event_pieces
from driftwarden import Options, State, run
from driftwarden.operators import ledger, quarantine
from driftwarden.operators.joins import bounded_join
from driftwarden.plans.run import new_run_id
from driftwarden.scratch import folders_made, fresh_folder, remove_folders
from driftwarden.sources.pieces import Piece, tag

SF = "/root/testdata/sf0.001"
NOW = datetime(2024, 2, 1, tzinfo=UTC)
TABLES = ("versions", "records", "drift_events", "alerts")


def contents(state):
    return {
        name: sorted(str(r.asDict()) for r in getattr(state, name)().collect())
        for name in TABLES
    }


def test_a_run_is_recorded_and_can_be_repeated(spark, folder):
    state = State(spark, folder)
    summary = run(spark, state, "events", "memory", pieces=event_pieces(spark, SF), run_id="r1", now=NOW)
    assert {k: summary[k] for k in ("status", "rows_extracted", "rows_loaded", "rows_quarantined")} == {
        "status": "SUCCESS", "rows_extracted": 1000, "rows_loaded": 900, "rows_quarantined": 105,
    }
    assert summary["drift_detected"] and summary["schema_evolved"]
    before = contents(state)
    assert [len(before[n]) for n in TABLES] == [5, 105, 10, 8]

    again = run(spark, state, "events", "memory", pieces=event_pieces(spark, SF), run_id="r1", now=NOW)
    assert again == summary and contents(state) == before
    ledgered = state.runs().collect()
    assert len(ledgered) == 1 and ledgered[0]["status"] == "SUCCESS" and ledgered[0]["finished_at"] is not None

    active = state.active(["events"]).first()
    assert active["version"] == 5 and "region" in active["schema"]
    flags = ledger.flagged(state.versions(), Options()).orderBy("version").collect()
    assert [r["is_active"] for r in flags] == [False] * 4 + [True]
    assert [r["version"] for r in ledger.history(state.versions(), "events").collect()] == [1, 2, 3, 4, 5]


def test_the_next_run_starts_from_the_ledger(spark, folder):
    state = State(spark, folder)
    base = spark.createDataFrame([(1, "x")], "a int, b string")
    wider = spark.createDataFrame([(2, "y", 0.5)], "a int, b string, c double")
    for n, frame in enumerate((base, wider, wider)):
        run(spark, state, "s", "memory", source_frame=frame, run_id=f"r{n}", now=NOW)
    assert [r["version"] for r in ledger.history(state.versions(), "s").collect()] == [1, 2]
    assert {r["run_id"] for r in state.drift_events().collect()} == {"r1"}


def test_a_failure_is_recorded_and_raised(spark, folder):
    state = State(spark, folder)
    with pytest.raises(ValueError, match="unknown destination"):
        run(spark, state, "s", "xml", source_frame=spark.range(1), run_id="r1", now=NOW)
    row = state.runs().first()
    assert row["status"] == "FAILED" and "unknown destination" in row["error_message"]
    alert = state.alerts().first()
    assert alert["severity"] == "CRITICAL" and alert["root_cause_hints"][-1] == "Source: dataframe  Destination: xml"


def test_a_run_with_every_batch_held_back_succeeds(spark, folder):
    state = State(spark, folder)
    run(spark, state, "s", "memory", source_frame=spark.range(5), run_id="r0", now=NOW)
    text = spark.range(5).select(F.lit("x").alias("id"))
    summary = run(spark, state, "s", "memory", source_frame=text, run_id="r1", now=NOW)
    assert (summary["status"], summary["rows_loaded"], summary["rows_quarantined"]) == ("SUCCESS", 0, 5)


def test_batches_of_rows_by_option(spark, folder):
    state = State(spark, folder)
    options = Options(batch_by="rows", batch_size=4, strict=True)
    frame = spark.range(10).select("id", F.lit("x").alias("b"))
    summary = run(spark, state, "s", "memory", source_frame=frame, source_options={"order_by": ["id"]},
                  options=options, run_id="r0", now=NOW)
    assert (summary["rows_extracted"], summary["rows_loaded"]) == (10, 10)
    run(spark, state, "s", "memory", source_frame=frame.drop("b"), source_options={"order_by": ["id"]},
        options=options, run_id="r1", now=NOW)
    assert {r["batch_id"] for r in state.drift_events().collect()} == {"0", "1", "2"}


def test_an_empty_run(spark, folder):
    state = State(spark, folder)
    empty = Piece(tag(spark.range(0), "s"))
    summary = run(spark, state, "s", "memory", pieces=[empty], run_id="r0", now=NOW)
    assert (summary["status"], summary["rows_extracted"], summary["rows_loaded"]) == ("SUCCESS", 0, 0)
    assert state.versions().count() == 0


def test_resolve_and_purge(spark, folder):
    state = State(spark, folder)
    run(spark, state, "events", "memory", pieces=event_pieces(spark, SF), run_id="r1", now=NOW)
    ids = [r["id"] for r in state.records().select("id").orderBy("id").limit(3).collect()]
    assert state.mark_resolved([*ids, "no such id"]) == 3
    assert state.mark_resolved(ids[:1]) == 1
    stats = quarantine.stats(state.records()).first()
    assert (stats["total"], stats["unresolved"], stats["resolved"]) == (105, 102, 3)
    assert quarantine.latest(state.records(), resolved=True).count() == 3
    assert quarantine.latest(state.records(), "events", "r1", "COERCION_FAILURE", limit=500).count() <= 5

    assert state.purge(30, F.lit(NOW + timedelta(days=30))) == 0  # not older than 30 days
    assert state.purge(30, F.lit(NOW + timedelta(days=31))) == 3
    assert state.records().count() == 102
    assert state.purge(30, F.lit(NOW + timedelta(days=31))) == 0
    run(spark, state, "events", "memory", pieces=event_pieces(spark, SF), run_id="r2", now=NOW)
    assert {r["run_id"] for r in state.records().select("run_id").distinct().collect()} == {"r1", "r2"}


def test_registering_by_hand(spark, folder):
    state = State(spark, folder)
    for n in (1, 2):
        made = ledger.register(state.versions(), "s", {"a": "integer"}, f"m{n}", F.lit(NOW))
        state.write_versions(made)
    assert [r["version"] for r in ledger.history(state.versions(), "s").collect()] == [1, 2]
    assert ledger.next_version(state.versions()).first()["next_version"] == 3


def test_run_ids():
    made = new_run_id(datetime(2024, 2, 1, 3, 4, 5, tzinfo=UTC))
    assert made.startswith("run-20240201T030405-") and len(made.rsplit("-", 1)[1]) == 6


def test_a_purge_leaves_other_partitions_alone(spark, folder):
    state = State(spark, folder)
    days = {"r1": 100, "r2": 100, "r3": 1, "r=4 %": 100}
    rows = [
        ("s", run, f"{run}-{i}", "p", None, None, "{}", "SCHEMA_DRIFT", "", "", 1, NOW - timedelta(days=age))
        for run, age in days.items() for i in range(3)
    ]
    state.write_records(spark.createDataFrame(rows, quarantine.RECORDS))
    state.mark_resolved(["r1-0", "r3-0", *(f"r=4 %-{i}" for i in range(3))])
    trend = sorted(map(tuple, state.trend().collect()))

    def files(run):
        return sorted(glob.glob(f"{folder}/quarantine_records/*/source_name=s/run_id={run}/*.parquet"))

    before = {run: files(run) for run in ("r1", "r2", "r3")}
    assert state.purge(30, F.lit(NOW)) == 4
    assert sorted(r["id"] for r in state.records().collect()) == ["r1-1", "r1-2", "r2-0", "r2-1", "r2-2", "r3-0", "r3-1", "r3-2"]
    assert files("r2") == before["r2"] and files("r3") == before["r3"] and files("r1") != before["r1"]
    assert state.purge(30, F.lit(NOW)) == 0
    # the trend tells what was quarantined, also after a purge, and a repeated run counts once
    assert sorted(map(tuple, state.trend().collect())) == trend and sum(r[3] for r in trend) == 12
    state.write_records(spark.createDataFrame(rows[:3], quarantine.RECORDS))
    assert sum(r["n"] for r in state.trend().collect()) == 12


def test_folders_of_a_job_can_be_removed(spark):
    since = folders_made()
    first, second = (fresh_folder(spark, "job") for _ in range(2))
    for path in (first, second):
        spark.range(3).write.parquet(path)
    assert remove_folders(spark, since, keep=(second,)) == 1
    assert spark.read.parquet(second).count() == 3 and not glob.glob(f"{first.removeprefix('file:')}/*")
    assert remove_folders(spark, since) == 1


def joins(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_many_resolved_ids_are_neither_broadcast_nor_repeated(spark, folder):
    """Beyond the limit Spark's own estimate of the ids, from the size of their files, must not bring the broadcast back."""
    stored = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("record_json"))
    stored.where("id % 4 = 0").select("id").write.parquet(f"{folder}/done")
    done = spark.read.parquet(f"{folder}/done")
    found = quarantine.with_resolution(stored, done, Options(broadcast_limit_bytes=1))
    assert joins(found) == (0, 1) and "explode" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("resolved").count() == 250 and found.count() == 1000


def test_facts_beyond_the_limit_are_joined_by_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("key"), "id")
    facts = spark.createDataFrame([(0, "a"), (1, "b")], "key bigint, name string")
    found = bounded_join(rows, facts, ["key"], Options(broadcast_limit_bytes=1))
    assert joins(found) == (0, 1) and found.count() == 67


def test_ids_to_resolve_are_matched_without_a_broadcast(spark, folder):
    spark.createDataFrame([("a",), ("a",), ("b",)], "id string").write.parquet(f"{folder}/stored")
    spark.createDataFrame([("a",), ("c",)], "id string").write.parquet(f"{folder}/ids")
    found = quarantine.matching(spark.read.parquet(f"{folder}/stored"), spark.read.parquet(f"{folder}/ids"))
    assert joins(found) == (0, 1) and [r["id"] for r in found.collect()] == ["a"]


@pytest.mark.parametrize("sources", [2, 20])
def test_records_of_few_sources_are_written_without_sorting_rows(spark, folder, sources):
    """Rows of a task are put apart by source; held and sorted only where there are many sources."""
    state, setting = State(spark, folder), "spark.sql.maxConcurrentOutputFileWriters"
    names = T.DataType.fromDDL(quarantine.RECORDS)
    rows = spark.range(200).repartition(2).select(
        F.format_string("s%02d", F.col("id") % sources).alias("source_name"), F.lit("r").alias("run_id"), F.col("id").cast("string").alias("id"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in names.fields[3:]],
    )
    before = spark.conf.get(setting, None)
    state._replace_run("quarantine_records/snapshot=0", quarantine.RECORDS, rows)
    assert "Sort" not in last_plan(spark)
    assert spark.conf.get(setting, None) == before
    kept = state.records().select("source_name", "id").collect()
    assert sorted((r[0], int(r[1])) for r in kept) == sorted((f"s{i % sources:02d}", i) for i in range(200))


def last_plan(spark):
    """The plan of the newest write, as it was run."""
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    plans = spark._jsparkSession.sharedState().statusStore().executionsList()
    told = [plans.apply(i).physicalPlanDescription() for i in range(plans.size())]
    return [t for t in told if "InsertIntoHadoopFsRelationCommand" in t][-1]
