import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from driftwarden.operators import alerts

NOW = datetime(2024, 2, 1, tzinfo=UTC)


def one(spark, hints, actions, severity="ERROR"):
    row = ("s", "r1", "Title", severity, "p", "0", "What happened.", hints, actions, {"rows": "5"}, NOW)
    return spark.createDataFrame([row], alerts.ALERTS)


def test_severity_order(spark):
    assert alerts.severity_rank("debug") < alerts.severity_rank("INFO") < alerts.severity_rank("Warning")
    with pytest.raises(KeyError):
        alerts.severity_rank("loud")
    both = one(spark, [], [], "WARNING").union(one(spark, [], [], "CRITICAL"))
    assert [r["severity"] for r in alerts.at_least(both, "error").collect()] == ["CRITICAL"]


def test_payload(spark):
    payload = json.loads(one(spark, [], ["do this"]).select(alerts.chat_payload("foot")).first()[0])
    (attachment,) = payload["attachments"]
    assert attachment["color"] == "#e74c3c" and attachment["title"] == "[ERROR] Title"
    values = {f["title"]: (f["value"], f["short"]) for f in attachment["fields"]}
    assert values["Root-cause hints"] == ("_none_", False)
    assert values["Suggested actions"] == ("• do this", False)
    assert values["Time"] == ("2024-02-01T00:00:00.000000+00:00", True)


def test_record(spark):
    record = json.loads(one(spark, ["h"], ["a"]).select(alerts.record_json()).first()[0])
    assert record["alert"]["pipeline"] == "p" and record["metrics"] == {"rows": 5}
    assert record["root_cause_hints"] == ["h"]


def test_text_leaves_empty_sections_out(spark):
    text = one(spark, [], []).select(alerts.human_text()).first()[0].split("\n")
    assert text[0] == text[-1] == "=" * 60
    assert "Metrics" in text and "  rows: 5" in text
    assert "Root-cause hints" not in text and "Suggested actions" not in text


def test_failure_alert(spark):
    runs = spark.createDataFrame([("r1", "p", "s", "no such file")], "run_id string, pipeline_name string, source_name string, error_message string")
    row = alerts.failure_alerts(runs, F.lit(NOW)).first()
    assert row["severity"] == "CRITICAL" and row["summary"] == "Pipeline 'p' failed: no such file"
    assert len(row["root_cause_hints"]) == 2 and len(row["suggested_actions"]) == 3


def test_metrics_of_a_record_have_types(spark):
    made = one(spark, [], []).withColumn("metrics", F.expr("map('actions', '12', 'batch_index', 'file \"a\", 1', 'rows', '-7', 'zero', '007')"))
    record = json.loads(made.select(alerts.record_json()).first()[0])
    assert record["metrics"] == {"actions": "12", "batch_index": 'file "a", 1', "rows": -7, "zero": "007"}
