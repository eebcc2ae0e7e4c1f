import pytest

from driftwarden.options import Options
from driftwarden.scratch import fresh_folder, shared_folder


def test_defaults():
    made = Options()
    assert (made.pipeline_name, made.batch_size, made.max_coercion_loss_pct) == ("etl_pipeline", 1000, 5.0)
    assert made.type_coercion and made.column_backfill and made.schema_evolution and not made.strict
    assert made.min_severity == "WARNING"


def test_from_text_values():
    made = Options.from_mapping({
        "strict": "TRUE", "type_coercion": "false", "batch_size": "50", "max_coercion_loss_pct": "7.5",
        "datetime_formats": "yyyy|MM/dd/yyyy", "epoch_unit": "ms",
    })
    assert made.strict and not made.type_coercion and made.batch_size == 50
    assert made.max_coercion_loss_pct == 7.5 and made.datetime_formats == ("yyyy", "MM/dd/yyyy")
    assert made.epoch_unit == "ms"
    with pytest.raises(ValueError, match="unknown options: nope"):
        Options.from_mapping({"nope": "1"})


@pytest.mark.parametrize("bad", [
    {"on_coercion_failure": "drop"}, {"baseline_from": "x"}, {"epoch_unit": "h"}, {"batch_size": 0},
])
def test_bad_values(bad):
    with pytest.raises(ValueError):
        Options(**bad)


def test_from_session(spark):
    spark.conf.set("spark.driftwarden.strict", "true")
    try:
        assert Options.from_session(spark).strict
    finally:
        spark.conf.unset("spark.driftwarden.strict")
    assert not Options.from_session(spark).strict


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named
    assert fresh_folder(spark, "x") != fresh_folder(spark, "x")
    assert fresh_folder(spark, "x").startswith(shared_folder(spark).rstrip("/"))
