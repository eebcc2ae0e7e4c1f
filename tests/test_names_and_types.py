from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from driftwarden.operators.joins import size_of
from driftwarden.options import Options
from driftwarden.plans.load import Load
from driftwarden.plans.run import run
from driftwarden.plans.state import State
from driftwarden.sources.delimited import column_names, delimited
from driftwarden.sources.frames import frame_pieces
from driftwarden.sources.json_lines import json_lines
from driftwarden.sources.pieces import BATCH, SOURCE, Piece, own_name, safe_name, tag


def test_names_are_set_apart_and_come_back():
    for name in ("_source", "_BATCH", "_number_a", "data:_source", "data:data:_error", "_move_1"):
        assert safe_name(name) != name and own_name(safe_name(name)) == name
    for name in ("source", "a", "data:x", "_other", ""):
        assert safe_name(name) == name == own_name(name)


def test_repeated_and_empty_header_names(spark, tmp_path):
    assert column_names(["a", "a", "", "a", "b", ""]) == ["a", "a.1", "Unnamed: 2", "a.2", "b", "Unnamed: 5"]
    (tmp_path / "one.csv").write_text("a,a,,_batch\n1,2,3,4\n")
    row = Load(delimited(spark, str(tmp_path), "s")).clean.first()
    assert [row[c] for c in ("a", "a.1", "Unnamed: 2", "data:_batch")] == [1, 2, 3, 4]


def test_json_records_with_internal_keys(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text('{"k":1,"_source":"x","_error":"e","_tokens":2}\n')
    load = Load(json_lines(spark, str(tmp_path), "s"))
    row = load.clean.first()
    assert [row[c] for c in ("k", "data:_source", "data:_error", "data:_tokens")] == [1, "x", "e", 2]
    assert load.plan.first()["disposition"] == "CLEAN"


def test_error_column_without_a_transform_is_data(spark):
    rows = spark.createDataFrame([(1, None), (2, "bad")], "a int, _error string")
    load = Load(frame_pieces(rows, "s"))
    assert load.clean.count() == 2
    held = Load(frame_pieces(rows.select("a"), "s"), custom_transform=lambda f: f.withColumn("_error", F.when(F.col("a") == 2, "bad")))
    assert held.plan.first()["disposition"] == "TRANSFORM_ERROR"


def test_any_exception_of_a_transform_holds_its_batch_back(spark):
    def broken(frame):
        raise RuntimeError("no such luck")

    load = Load(frame_pieces(spark.range(3), "s"), custom_transform=broken)
    assert [r["error_detail"] for r in load.quarantined.collect()] == ["no such luck"] * 3


def test_odd_nested_names_are_healed(spark):
    odd = "struct<`a-b`: int, `c d`: array<struct<`e.f`: string>>>"
    full = spark.createDataFrame([(1, (2, [("x",)]))], f"k int, s {odd}")
    pieces = [Piece(tag(full, "s", F.lit(0))), Piece(tag(full.drop("s"), "s", F.lit(1)))]
    rows = {r[BATCH]: r["s"] for r in Load(pieces).clean.collect()}
    assert rows[0][0] == 2 and rows[0][1][0][0] == "x" and rows[1] is None


def test_unknown_column_gets_its_type_and_then_drifts(spark):
    values = [F.lit(None), F.lit(5), F.lit("text")]
    pieces = [Piece(tag(spark.range(2).withColumn("late", v), "s", F.lit(i))) for i, v in enumerate(values)]
    plan = Load(pieces, Options(strict=True)).plan.orderBy(BATCH).collect()
    assert [r["disposition"] for r in plan] == ["CLEAN", "CLEAN", "SCHEMA_DRIFT"]
    assert [dict(r["observed"])["late"] for r in plan][1:] == ["integer", "string"]


def test_size_counts_bytes(spark):
    assert size_of(spark.createDataFrame([("é" * 300,)], "a string")) >= 600


def test_retry_keeps_failure_alerts_and_forgets_the_first_attempt(spark, folder):
    now = datetime(2024, 1, 1, tzinfo=UTC)
    state = State(spark, folder)
    a, b = spark.range(4), spark.range(4).withColumn("x", F.lit(1))
    pieces = [Piece(tag(a, "s", F.lit(0))), Piece(tag(b, "s", F.lit(1)))]
    with pytest.raises(ValueError):
        run(spark, state, "s", "nowhere", pieces=pieces, run_id="r*[1]", now=now)
    assert state.runs().first()["status"] == "FAILED"
    assert {r["severity"] for r in state.alerts().collect()} == {"WARNING", "CRITICAL"}
    run(spark, state, "s", "memory", pieces=pieces[:1], run_id="r*[1]", now=now)
    assert state.runs().first()["status"] == "SUCCESS"
    assert state.alerts().count() == 0 and state.drift_events().count() == 0
    assert state.versions().agg(F.max("version")).first()[0] == 1


def test_source_and_batch_columns_of_a_user_survive_a_run(spark, folder):
    rows = spark.createDataFrame([(1, "mine", 7)], "a int, _source string, _batch int")
    out = f"{folder}/out"
    run(spark, State(spark, f"{folder}/state"), "s", "jsonl", source_frame=rows, destination_path=out)
    got = spark.read.json(out).first()
    assert (got["a"], got[SOURCE], got[BATCH]) == (1, "mine", 7)
