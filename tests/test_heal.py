import json
import math

from pyspark.sql import functions as F

from checks.fixtures import event_pieces
from driftwarden import Load, Options, Piece, tag
from driftwarden.plans.step import HEALED

SF = "/root/testdata/sf0.001"


def pieces(*frames):
    return [Piece(tag(f, "s", F.lit(i).cast("bigint"))) for i, f in enumerate(frames)]


def rows(frame):
    names = [c for c in frame.columns if not c.startswith("_")]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def test_excluded_rows_and_loaded_rows_add_up(spark):
    load = Load(event_pieces(spark, SF), Options(on_coercion_failure="exclude"))
    held = load.quarantined.select("batch_id", F.get_json_object("record_json", "$.event_id").alias("e")).distinct()
    assert load.clean.count() + held.count() == 1000


def test_healing_healed_rows_changes_nothing(spark):
    first = Load(event_pieces(spark, SF))
    once = first.clean
    again = Load([Piece(once)], first.options)
    assert {r["disposition"] for r in again.plan.collect()} == {"CLEAN"}
    assert rows(again.clean) == rows(once)


def test_partitioning_does_not_matter(spark):
    spread = [Piece(p.frame.repartition(7), p.inferred) for p in event_pieces(spark, SF)]
    one, many = Load(event_pieces(spark, SF)), Load(spread, Options(batches_per_task=2))
    assert rows(one.clean) == rows(many.clean)
    assert rows(one.quarantined) == rows(many.quarantined)


def test_two_failed_cells_of_a_row_are_two_records_of_the_raw_row(spark):
    good = spark.createDataFrame([(i, 1, 1.0) for i in range(40)], "k int, a int, b double")
    bad = spark.createDataFrame(
        [(i, "x" if i == 3 else "1", "y" if i in (3, 4) else "2.5") for i in range(100)], "k int, a string, b string"
    )
    load = Load(pieces(good, bad))
    records = load.healing.failures.collect()
    assert sorted((r["column_name"], json.loads(r["record_json"])["k"]) for r in records) == [("a", 3), ("b", 3), ("b", 4)]
    assert {json.loads(r["record_json"])["b"] for r in records} == {"y"}
    assert load.clean.count() == 140
    assert load.totals.first()["rows_quarantined"] == 3
    excluded = Load(pieces(good, bad), Options(on_coercion_failure="exclude"))
    assert excluded.clean.count() == 138


def test_physical_types_stay_where_nothing_changes(spark):
    frame = spark.sql("select cast(1 as smallint) a, 1.5f b, timestamp_ntz'2024-01-01 00:00:00' c, 1.50 d, array(1) e")
    load = Load(pieces(frame, frame))
    kept = {c: t for c, t in load.clean.dtypes if not c.startswith("_")}
    assert kept == {"a": "smallint", "b": "float", "c": "timestamp_ntz", "d": "decimal(3,2)", "e": "array<int>"}


def test_names_with_dots_quotes_and_case(spark):
    odd = spark.createDataFrame([(1, "2"), (2, "x")], "`a.b` int, `it's` string")
    base = spark.createDataFrame([(1, 2)] * 30, "`a.b` int, `it's` int")
    load = Load(pieces(base, odd), Options(max_coercion_loss_pct=60.0))
    assert load.clean.count() == 32
    assert load.plan.where("_batch = 1").first()["summary"] == """type_changes={"it's": 'integer->string'}"""
    upper = spark.createDataFrame([(1,)], "`A.B` int")
    plan = Load(pieces(base, upper)).plan
    assert plan.where("_batch = 1").first()["added"] == ["A.B"]


def test_mixed_types_without_coercion_become_text(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q",)], "x string")
    load = Load(pieces(a, b), Options(type_coercion=False))
    assert rows(load.clean) == [("1",), ("q",)]
    assert [r["evolved_to"] for r in load.plan.orderBy("_batch").collect()] == [None, 2]


def test_without_backfill_a_lost_column_leaves_the_schema(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(1, 3)], "x int, z int")
    plan = Load(pieces(a, b, a), Options(column_backfill=False)).plan.orderBy("_batch").collect()
    assert [r["added"] for r in plan] == [[], ["z"], ["y"]]
    assert [r["removed"] for r in plan] == [[], ["y"], ["z"]]


def test_nan_is_no_failure(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(math.nan,), (2.0,), (2.5,)] + [(1.0,)] * 97, "x double")
    load = Load(pieces(a, b))
    assert load.plan.where("_batch = 1").first()["loss"] == 1
    assert load.healing.failures.count() == 1


def test_transform_that_cannot_apply_holds_back_its_layout(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(1,), (2,)], "x int")
    load = Load(pieces(a, b), custom_transform=lambda f: f.withColumn("y", F.col("y") + 1))
    assert [r["disposition"] for r in load.plan.orderBy("_batch").collect()] == ["CLEAN", "TRANSFORM_ERROR"]
    held = load.quarantined.collect()
    assert {r["error_type"] for r in held} == {"TRANSFORM_ERROR"}
    assert sorted(json.loads(r["record_json"])["x"] for r in held) == [1, 2]
    assert all(r["schema_version"] is None for r in held)


def test_raw_baseline_makes_a_transform_drift(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    change = lambda f: f.withColumn("z", F.lit("new"))
    raw = Load(pieces(a), Options(baseline_from="raw"), custom_transform=change).plan.first()
    assert (raw["disposition"], raw["added"], raw["evolved_to"]) == (HEALED, ["z"], 2)
    assert Load(pieces(a), custom_transform=change).plan.first()["disposition"] == "CLEAN"


def test_strict_holds_back_every_drifted_batch(spark):
    load = Load(event_pieces(spark, SF), Options(strict=True))
    assert load.clean.count() == 300 and load.quarantined.count() == 700
    assert load.plan.where("evolved_to is not null").count() == 0


def test_large_plans_are_joined_by_salted_shuffle(spark):
    small = Load(event_pieces(spark, SF), Options(broadcast_limit_bytes=0))
    assert rows(small.clean) == rows(Load(event_pieces(spark, SF)).clean)
    assert small.quarantined.count() == Load(event_pieces(spark, SF)).quarantined.count()
