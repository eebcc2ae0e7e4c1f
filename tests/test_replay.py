from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from driftwarden import Options, State, replay, run
from driftwarden.operators import ledger
from driftwarden.sources import sinks
from driftwarden.sources.pieces import Piece, tag

NOW = datetime(2024, 2, 1, tzinfo=UTC)


def piece(spark, rows, ddl, batch=0):
    return Piece(tag(spark.createDataFrame(rows, ddl), "s", F.lit(batch)))


@pytest.fixture
def loaded(spark, folder):
    """A state and a sink after a load whose second batch was refused: three of its five amounts are no numbers."""
    state = State(spark, f"{folder}/state")
    first = piece(spark, [(1, 0.5, NOW), (2, None, None)], "id bigint, amount double, at timestamp")
    bad = [(3, "1.5", NOW), (4, "$2", None), (4, "$2", None), (5, "x", None), (6, None, NOW)]
    second = piece(spark, bad, "id bigint, amount string, at timestamp", 1)
    run(spark, state, "s", "jsonl", pieces=[first, second], destination_path=f"{folder}/out", run_id="r1", now=NOW)
    return state, f"{folder}/out"


def sink(state, path):
    return sorted((r["id"], r["amount"]) for r in state.loaded("jsonl", path).collect())


def unresolved(state):
    return sorted(r["record_json"] for r in state.records().where(~F.col("resolved")).collect())


def again(spark, state, path, run_id, **how):
    return replay(spark, state, "s", "jsonl", destination_path=path, run_id=run_id, now=NOW, **how)


def test_only_what_passes_is_loaded_and_resolved(spark, loaded):
    state, path = loaded
    assert sink(state, path) == [(1, 0.5), (2, None)] and len(unresolved(state)) == 5
    told = again(spark, state, path, "p1")
    assert (told["rows_extracted"], told["rows_loaded"], told["rows_quarantined"], told["ids_resolved"]) == (5, 2, 3, 2)
    assert sink(state, path) == [(1, 0.5), (2, None), (3, 1.5), (6, None)]
    left = unresolved(state)
    assert len(left) == 3 and all("$2" in r or '"x"' in r for r in left)
    times = {r["id"]: r["at"] for r in state.loaded("jsonl", path).collect()}
    assert times[3] == "2024-02-01 00:00:00.000000"
    # no version, though the healed batch had a change of type
    assert state.versions().count() == 1


def test_twice_gives_the_same(spark, loaded):
    state, path = loaded
    first = again(spark, state, path, "p1")
    rows, left = sink(state, path), unresolved(state)
    # the same run id again: its attempt takes the place of the one before
    assert again(spark, state, path, "p1") == first
    assert (sink(state, path), unresolved(state)) == (rows, left)
    # a new run id: only the rest is looked at, and nothing of it passes
    told = again(spark, state, path, "p2")
    assert (told["rows_extracted"], told["rows_loaded"], told["ids_resolved"]) == (3, 0, 0)
    assert (sink(state, path), unresolved(state)) == (rows, left)


def test_a_changed_schema_lets_the_rest_pass(spark, loaded):
    state, path = loaded
    again(spark, state, path, "p1")
    changed = ledger.register(state.versions(), "s", {"id": "integer", "amount": "string", "at": "datetime"}, "by-hand", F.lit(NOW))
    state.write_versions(changed)
    told = again(spark, state, path, "p2")
    # copies of a row are rows of their own, under one id
    assert (told["rows_loaded"], told["ids_resolved"], told["rows_quarantined"]) == (3, 2, 0)
    assert sorted(str(r["amount"]) for r in state.loaded("jsonl", path).collect()) == ["$2", "$2", "0.5", "1.5", "None", "None", "x"]
    assert unresolved(state) == []


def test_a_transform_mends_records(spark, loaded):
    state, path = loaded
    told = again(spark, state, path, "p1", custom_transform=lambda f: f.withColumn("amount", F.regexp_replace("amount", "[$]", "")))
    assert (told["rows_loaded"], told["ids_resolved"]) == (4, 3)
    assert (4, 2.0) in sink(state, path)
    assert len(unresolved(state)) == 1


def test_a_replay_that_fails_changes_nothing(spark, loaded):
    state, path = loaded
    before = sink(state, path), unresolved(state)
    with pytest.raises(ValueError, match="unknown destination"):
        replay(spark, state, "s", "xml", destination_path=path, run_id="p1", now=NOW)
    assert state.runs().where("run_id = 'p1'").first()["status"] == "FAILED"
    # rows are in the sink, but the attempt was never committed
    rows = spark.createDataFrame([(9, 9.0)], "id bigint, amount double")
    sinks.load_into(rows, "jsonl", path, load=("p1", 0))
    state.write_resolutions(state.records().select("id"), "p1", 0, F.lit(NOW))
    assert (sink(state, path), unresolved(state)) == before
    assert again(spark, state, path, "p1")["rows_loaded"] == 2
    assert (9, 9.0) not in sink(state, path)


def test_failed_cells_under_exclude_and_new_columns(spark, folder):
    state, path = State(spark, f"{folder}/state"), f"{folder}/out"
    options = Options(max_coercion_loss_pct=100, on_coercion_failure="exclude")
    first = piece(spark, [(1, 1, True)], "a bigint, b bigint, c boolean")
    second = piece(spark, [("2", "x", "maybe"), ("3", "4", "yes")], "a string, b string, c string", 1)
    run(spark, state, "s", "db", pieces=[first, second], destination_path=path, run_id="r1", now=NOW, options=options)
    assert state.records().count() == 2 and state.loaded("db", path).count() == 2
    fixed = {"x": "7", "maybe": "no"}

    def mend(frame):
        return frame.replace(fixed, subset=["b", "c"]).withColumn("note", F.lit("mended"))

    told = replay(
        spark, state, "s", "db", destination_path=path, run_id="p1", now=NOW, options=options,
        error_types=("COERCION_FAILURE",), custom_transform=mend,
    )
    assert (told["rows_extracted"], told["rows_loaded"], told["ids_resolved"], told["schema_evolved"]) == (1, 1, 2, True)
    rows = sorted((r["a"], r["b"], r["c"], r["note"]) for r in state.loaded("db", path).collect())
    assert rows == [(1, 1, True, None), (2, 7, False, "mended"), (3, 4, True, None)]
    assert state.active(["s"]).first()["schema"]["note"] == "string"


def test_strict_and_nothing_to_replay(spark, loaded):
    state, path = loaded
    told = again(spark, state, path, "p0", error_types=("TRANSFORM_ERROR",))
    assert (told["status"], told["rows_extracted"], told["rows_loaded"]) == ("SUCCESS", 0, 0)
    told = again(spark, state, path, "p1", options=Options(strict=True))
    assert (told["rows_extracted"], told["rows_loaded"], told["ids_resolved"]) == (5, 0, 0)
    assert len(unresolved(state)) == 5
