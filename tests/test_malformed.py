import json
import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from driftwarden import Load, Options, State, run
from driftwarden.sources.delimited import delimited
from driftwarden.sources.json_lines import json_lines

NOW = datetime(2024, 2, 1, tzinfo=UTC)
CSV = {"1.csv": 'a,b\n1,x\n2,y,z\n\n3,"q,r"\n4,"k ""l""",m,n\n5\n', "2.csv": "b,a,c\nu,6,0.5\nv,7,1.5,w\n", "3.csv": "a,b\n8,x,y,z,w\n"}
JSON = {"1.json": '{"a": 1, "b": "x"}\n{"a": 2, \n\n[1, 2]\n"text"\n{"a": 3}\n', "2.json": "no\n{x}\n"}


def put(folder, files):
    os.makedirs(folder, exist_ok=True)
    for age, (name, text) in enumerate(files.items()):
        path = os.path.join(folder, name)
        with open(path, "w") as out:
            out.write(text)
        os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))
    return folder


def records(load):
    rows = [(r["batch_id"], json.loads(r["record_json"])) for r in load.quarantined.where("error_type = 'MALFORMED'").collect()]
    return sorted((os.path.basename(x["file"]), x["place"], x["line"]) for batch, x in rows if x["file"].split("/")[-1] in batch)


@pytest.mark.parametrize("rows", [None, 2])
def test_delimited_lines_that_are_too_long(spark, folder, rows):
    files = CSV if rows is None else {k: v for k, v in CSV.items() if k != "2.csv"}
    pieces = delimited(spark, put(f"{folder}/in", files), "s", rows, on_malformed="quarantine")
    load = Load(pieces, Options(max_coercion_loss_pct=100))
    got = load.quarantined.where("error_type = 'MALFORMED'").select("record_json").collect()
    found = sorted((os.path.basename(x["file"]), x["place"], x["line"]) for x in (json.loads(r[0]) for r in got))
    want = [("1.csv", 2, "2,y,z"), ("1.csv", 4, '4,"k ""l""",m,n'), ("3.csv", 1, "8,x,y,z,w")]
    want = want if rows else sorted([*want, ("2.csv", 2, "v,7,1.5,w")])
    assert found == want
    clean = sorted((r["a"], r["b"]) for r in load.clean.collect())
    assert clean == sorted([(1, "x"), (3, "q,r"), (5, None)] + ([] if rows else [(6, "u")]), key=lambda r: r[0])
    totals = load.totals.first()
    assert totals["rows_extracted"] == len(clean) + len(want) and totals["rows_quarantined"] == len(want)


def test_json_lines_that_are_no_objects(spark, folder):
    load = Load(json_lines(spark, put(f"{folder}/in", JSON), "s", on_malformed="quarantine"))
    assert records(load) == [("1.json", 2, '{"a": 2, '), ("1.json", 3, "[1, 2]"), ("1.json", 4, '"text"'), ("2.json", 1, "no"), ("2.json", 2, "{x}")]
    assert sorted((r["a"], r["b"]) for r in load.clean.collect()) == [(1, "x"), (3, None)]
    # a file without any record that can be read is no drift
    plan = {r["_batch"][-6:]: (r["n_rows"], r["n_malformed"], r["disposition"], r["has_drift"]) for r in load.plan.collect()}
    assert plan == {"1.json": (2, 3, "CLEAN", False), "2.json": (0, 2, "CLEAN", False)}


def test_places_over_several_splits(spark, folder):
    lines = [f'{{"a": {i}}}' if i % 500 else f"bad {i}" for i in range(1, 20_001)]
    path = put(f"{folder}/in", {"1.json": "\n".join(lines) + "\n", "2.json": "\n".join(lines[:700])})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        load = Load(json_lines(spark, path, "s", on_malformed="quarantine"))
        got = records(load)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("1.json", i, f"bad {i}") for i in range(500, 20_001, 500)] + [("2.json", 500, "bad 500")])


def test_a_run_counts_and_a_transform_does_not_see_them(spark, folder):
    path, state = put(f"{folder}/in", JSON), State(spark, f"{folder}/state")
    with pytest.raises(Exception):
        run(spark, state, "s", "memory", source_type="jsonl", source_path=path, run_id="r1", now=NOW)

    def mend(frame):
        return frame.withColumns({"b": F.coalesce("b", F.lit("none")), "_error": F.when(F.col("a").isNull(), F.lit("no a"))})

    told = run(
        spark, state, "s", "jsonl", source_type="jsonl", source_path=path, source_options={"on_malformed": "quarantine"},
        destination_path=f"{folder}/out", custom_transform=mend, run_id="r1", now=NOW,
    )
    assert (told["rows_extracted"], told["rows_loaded"], told["rows_quarantined"]) == (7, 2, 5)
    assert sorted((r["a"], r["b"]) for r in state.loaded("jsonl", f"{folder}/out").collect()) == [(1, "x"), (3, "none")]
    assert state.records().groupBy("error_type").count().collect()[0].asDict() == {"error_type": "MALFORMED", "count": 5}


def test_the_choice_is_checked(spark, folder):
    with pytest.raises(ValueError, match="on_malformed"):
        json_lines(spark, put(f"{folder}/in", JSON), "s", on_malformed="drop")
