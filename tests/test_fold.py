import random

import pytest
from pyspark.sql import functions as F

from checks.fixtures import event_pieces
from driftwarden import Load, Options, Piece, tag
from driftwarden.plans import fold as fold_module
from driftwarden.plans import step
from driftwarden.plans.fold import fold
from driftwarden.plans.step import Position, advance, rules_of

SF = "/root/testdata/sf0.001"
SUMMARY = """
    _source string, _batch bigint, piece int, n_rows bigint, error string,
    observed array<struct<column:string,ordinal:int,bucket:string,present:bigint,lost:map<string,bigint>>>
"""


def summary(source, batch, columns, rows=10, lost=None, error=None):
    cells = [(c, i, b, rows, (lost or {}).get(c, {})) for i, (c, b) in enumerate(columns.items())]
    return (source, batch, 0, rows, error, cells)


def verdicts(frame):
    return {
        (r["_source"], r["_batch"]): (r["disposition"], r["expected_version"], r["evolved_to"], r["loss"])
        for r in frame.collect()
    }


def in_sequence(rows, options):
    """Brute force: one source after the other, one batch after the other."""
    found, positions = {}, {}
    for row in sorted(rows, key=lambda r: r[:2]):
        names = ("_source", "_batch", "piece", "n_rows", "error", "observed")
        batch = dict(zip(names, row, strict=True))
        cell = ("column", "ordinal", "bucket", "present", "lost")
        batch["observed"] = [dict(zip(cell, c, strict=True)) for c in batch["observed"]]
        opening = row[0] not in positions
        at = positions.setdefault(row[0], Position(None, None))
        v = advance(at, batch, rules_of(options), opening)
        found[row[:2]] = (v["disposition"], v["expected_version"], v["evolved_to"], v["loss"])
    return found


@pytest.mark.parametrize("seed", range(4))
def test_partitioned_fold_equals_the_sequence(spark, seed):
    dice = random.Random(seed)
    rows = []
    for source in ("a", "b", "c"):
        for batch in range({"a": 60, "b": 3, "c": 17}[source]):
            columns = {c: dice.choice(["integer", "float", "string"]) for c in "xyz" if dice.random() < 0.7}
            lost = {c: {"integer": dice.choice([0, 0, 1, 5]), "float": 0} for c in columns}
            rows.append(summary(source, batch, columns, lost=lost, error="bad" if dice.random() < 0.05 else None))
    options = Options(
        type_coercion=seed != 1, column_backfill=seed != 2, schema_evolution=seed != 3, batches_per_task=9,
        max_coercion_loss_pct=20.0,
    )
    profile = spark.createDataFrame(rows, SUMMARY)
    assert verdicts(fold(profile, None, options)) == in_sequence(rows, options)


@pytest.mark.parametrize("partitions", [8, 30])
def test_jobs_do_not_grow_when_every_partition_changes_the_schema(spark, monkeypatch, partitions):
    """Every second batch brings a new column, so the end of every partition depends on all before it."""
    rows = [summary("a", b, {f"c{k}": "integer" for k in range(b // 2 + 1)}) for b in range(2 * partitions)]
    rows += [summary("b", b, {"x": "integer" if b < 3 else "string"}, lost={"x": {"integer": 1}}) for b in range(5)]
    folds, plain = [], fold_module._ends
    monkeypatch.setattr(fold_module, "_ends", lambda *given: folds.append(1) or plain(*given))
    options = Options(batches_per_task=2, max_coercion_loss_pct=20.0)
    assert verdicts(fold(spark.createDataFrame(rows, SUMMARY), None, options)) == in_sequence(rows, options)
    assert len(folds) <= fold_module.ROUNDS + 1


def test_known_outcome_of_drifting_events(spark):
    plan = Load(event_pieces(spark, SF)).plan
    found = {r["_batch"]: (r["disposition"], r["expected_version"], r["evolved_to"]) for r in plan.collect()}
    assert found == {
        0: ("CLEAN", 1, None), 1: ("CLEAN", 1, None), 2: ("CLEAN", 1, None), 3: ("HEALED", 1, 2),
        4: ("HEALED", 2, None), 5: ("HEALED", 2, 3), 6: ("HEALED", 3, 4), 7: ("HEALING_FAILED", 4, None),
        8: ("HEALED", 4, 5), 9: ("CLEAN", 5, None),
    }


def test_empty_first_batch_switches_detection_off(spark):
    rows = [summary("a", 0, {}, rows=0), summary("a", 1, {"x": "integer"}), summary("a", 2, {"x": "string", "y": "float"})]
    plan = fold(spark.createDataFrame(rows, SUMMARY), None, Options())
    assert {v[:3] for v in verdicts(plan).values()} == {("CLEAN", None, None)}


def test_gate_is_strictly_greater(spark):
    rows = [summary("a", 0, {"x": "integer"}, rows=100)]
    rows += [summary("a", 1, {"x": "string"}, rows=100, lost={"x": {"integer": 5}})]
    rows += [summary("a", 2, {"x": "string"}, rows=100, lost={"x": {"integer": 6}})]
    found = verdicts(fold(spark.createDataFrame(rows, SUMMARY), None, Options()))
    assert found["a", 1] == ("HEALED", 1, 2, 5)
    assert found["a", 2] == ("HEALING_FAILED", 2, None, 6)


def test_removed_only_registers_nothing(spark):
    rows = [summary("a", 0, {"x": "integer", "y": "float"}), summary("a", 1, {"x": "integer"})]
    found = verdicts(fold(spark.createDataFrame(rows, SUMMARY), None, Options()))
    assert found["a", 1] == ("HEALED", 1, None, 0)


def test_unknown_bucket_never_drifts(spark):
    rows = [summary("a", 0, {"x": "integer"}), summary("a", 1, {"x": "unknown"}), summary("a", 2, {"x": "integer"})]
    found = verdicts(fold(spark.createDataFrame(rows, SUMMARY), None, Options()))
    assert {v[0] for v in found.values()} == {"CLEAN"}


def test_ledger_schema_is_the_start(spark):
    active = spark.createDataFrame(
        [("a", 7, {"x": "integer"})], "source_name string, version int, schema map<string,string>"
    )
    rows = [summary("a", 0, {"x": "integer"}), summary("a", 1, {"x": "integer", "y": "string"}), summary("b", 0, {"q": "float"})]
    found = verdicts(fold(spark.createDataFrame(rows, SUMMARY), active, Options()))
    assert found == {
        ("a", 0): ("CLEAN", 7, None, 0), ("a", 1): ("HEALED", 7, 8, 0), ("b", 0): ("CLEAN", 1, None, 0)
    }


def test_a_batch_has_one_layout(spark):
    rows = [summary("a", 0, {"x": "integer"}), summary("a", 0, {"x": "string"})]
    with pytest.raises(Exception, match="more than one layout"):
        fold(spark.createDataFrame(rows, SUMMARY), None, Options()).collect()


def test_three_runs_in_a_row(spark):
    """Clean data, then a hopeless price column, then one new and one missing column."""
    order = F.col("id")
    base = spark.range(1, 101).select(
        order.alias("order_id"), (order + 1000).alias("customer_id"), (order * 1.5).alias("amount"),
        F.lit("pending").alias("status"),
    )
    drifted = base.select(
        "order_id", "customer_id", F.format_string("$%.2f", "amount").alias("amount"), F.lit("EMEA").alias("region")
    )
    after = base.where("order_id <= 50").select("order_id", "customer_id", "amount", F.lit("AMER").alias("region"))
    options = Options(max_coercion_loss_pct=10.0)
    active = None
    outcomes = []
    for frame, size in ((base, 50), (drifted, 50), (after, 50)):
        key = F.expr(f"(order_id - 1) div {size}")
        load = Load([Piece(tag(frame, "orders", key))], options, active)
        totals = load.totals.first()
        outcomes.append((totals["rows_clean"], totals["rows_quarantined"], load.plan.count()))
        last = load.plan.select(F.explode("registrations").alias("r")).select("r.*").orderBy("version").collect()
        if last:
            rows = [("orders", last[-1]["version"], last[-1]["schema"])]
            active = spark.createDataFrame(rows, "source_name string, version int, schema map<string,string>")
    assert outcomes == [(100, 0, 2), (0, 100, 2), (50, 0, 1)]
    row = active.first()
    assert row["version"] == 2
    assert row["schema"] == {
        "order_id": "integer", "customer_id": "integer", "amount": "float", "status": "string", "region": "string",
    }


def test_dispositions_are_distinct():
    kinds = {step.CLEAN, step.HEALED, step.SCHEMA_DRIFT, step.HEALING_FAILED, step.TRANSFORM_ERROR, step.COERCION_FAILURE}
    assert len(kinds) == 6
