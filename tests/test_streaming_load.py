import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from driftwarden import Options, State, run
from driftwarden.streaming import load as streaming
from driftwarden.streaming.load import StreamingLoad

NOW = datetime(2024, 2, 1, tzinfo=UTC)


def put(folder, number, rows):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{number}.json")
    with open(path, "w") as out:
        out.writelines(json.dumps(r) + "\n" for r in rows)
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def batches():
    made = [[{"id": 10 * b + i, "price": i + 0.5} for i in range(4)] for b in range(6)]
    for row in made[2]:
        row["region"] = "x"
    made[3][1]["price"] = "$2"
    for row in made[4]:
        row["price"] = "free"
    return made


def contents(state, path):
    rows = sorted(str(sorted((k, v) for k, v in r.asDict().items() if v is not None)) for r in state.loaded("jsonl", path).collect())
    records = sorted((r["error_type"], r["record_json"]) for r in state.records().collect())
    versions = [tuple(sorted(r["schema"].items())) for r in state.versions().orderBy("version").collect()]
    return rows, records, versions


OPTIONS = Options(max_coercion_loss_pct=50.0)


def stream(spark, folder, **how):
    return StreamingLoad(
        spark, State(spark, f"{folder}/state"), "orders", "s", f"{folder}/in", "jsonl", destination_path=f"{folder}/out", options=OPTIONS, **how
    )


def test_a_stream_loads_what_a_batch_load_does(spark, folder, monkeypatch):
    made = batches()
    for b in range(3):
        put(f"{folder}/in", b, made[b])
    first = stream(spark, folder, max_files=2)
    assert [t["rows_extracted"] for t in first.drain(NOW)] == [8, 4]
    assert first.drain(NOW) == []
    # the second drain dies in a micro-batch, after its rows are in the sink and before they count
    for b in range(3, 6):
        put(f"{folder}/in", b, made[b])
    broken = stream(spark, folder, max_files=2)
    plain = State.commit

    def cut_short(self, run_id, *given):
        if run_id.endswith("3"):
            raise RuntimeError("lost")
        plain(self, run_id, *given)

    monkeypatch.setattr(State, "commit", cut_short)
    with pytest.raises(RuntimeError, match="lost"):
        broken.drain(NOW)
    monkeypatch.setattr(State, "commit", plain)
    again = stream(spark, folder, max_files=2)
    assert [t["rows_extracted"] for t in again.drain(NOW)] == [4]
    got = contents(again.state, f"{folder}/out")

    whole = State(spark, f"{folder}/whole")
    run(
        spark, whole, "s", "jsonl", source_type="jsonl", source_path=f"{folder}/in", destination_path=f"{folder}/once", options=OPTIONS,
        run_id="all", now=NOW,
    )
    assert got == contents(whole, f"{folder}/once")
    assert len(got[0]) == 20 and len(got[1]) == 5


def test_a_stream_starts_from_the_ledger(spark, folder):
    put(f"{folder}/in", 1, [{"id": "7", "price": 1.5}])
    loading = stream(spark, folder)
    schema = spark.createDataFrame([("s", "r0", 3, {"id": "integer", "price": "float"}, "manual", None, NOW)], "source_name string, run_id string, version int, schema map<string,string>, kind string, batch_id string, registered_at timestamp")
    loading.state.write_versions(schema)
    assert [t["drift_detected"] for t in loading.drain(NOW)] == [True]
    assert [r["id"] for r in loading.state.loaded("jsonl", f"{folder}/out").collect()] == [7]
    assert loading.state.versions().agg(F.max("version")).first()[0] == 4
    assert streaming.StreamingLoad.run_id(loading, 0) == "orders-00000000"
