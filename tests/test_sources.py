import json
import os

import pytest
from pyspark.sql import functions as F

from driftwarden import Load, Options
from driftwarden.operators import heal
from driftwarden.operators.profile import profile
from driftwarden.sources import sinks
from driftwarden.sources.batching import in_rows, positions
from driftwarden.sources.delimited import _header_lines, delimited
from driftwarden.sources.frames import frame_pieces, pieces_of
from driftwarden.sources.json_lines import json_lines
from driftwarden.sources.pieces import BATCH, Piece, tag, with_own_names


def put(folder, name, text, age):
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        out.write(text)
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def data(frame):
    names = sorted(c for c in frame.columns if not c.startswith("_"))
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def test_values_follow_their_header(spark, folder):
    put(folder, "1.csv", "a,b\n1,x\n2,y\n", 0)
    put(folder, "2.csv", "b,a,c\nz,3,0.5\n", 1)
    load = Load(delimited(spark, folder, "s"))
    assert data(load.clean) == sorted([(1, "x", None), (2, "y", None), (3, "z", 0.5)], key=repr)
    plan = load.plan.orderBy("_batch").collect()
    assert [r["disposition"] for r in plan] == ["CLEAN", "HEALED"]
    assert plan[1]["added"] == ["c"]


def test_types_are_told_per_file(spark, folder):
    put(folder, "1.csv", "n,f,t,b\n1,1.5,x,True\n2,2,y,false\n", 0)
    put(folder, "2.csv", "n,f,t,b\n3.5,1,7,1\n4,2,8,0\n", 1)
    plan = Load(delimited(spark, folder, "s"), Options(max_coercion_loss_pct=60)).plan.orderBy("_batch").collect()
    assert plan[0]["observed"] == {"n": "integer", "f": "float", "t": "string", "b": "boolean"}
    assert plan[1]["observed"] == {"n": "float", "f": "integer", "t": "integer", "b": "integer"}
    assert plan[1]["lost"] == {"n": 1}


def test_inferred_values_are_read_before_they_are_coerced(spark, folder):
    put(folder, "1.csv", "flag,word,count\ntrue,x,1\n", 0)
    put(folder, "2.csv", "flag,word,count\n2,007,True\n0,8,False\n", 1)
    load = Load(delimited(spark, folder, "s"))
    # columns in name order: count, flag, word
    assert data(load.clean) == sorted([(1, True, "x"), (1, True, "7"), (0, False, "8")], key=repr)
    assert load.quarantined.count() == 0


def test_short_lines_are_filled_and_long_ones_fail(spark, folder):
    put(folder, "1.csv", "a,b\n1\n2,y\n", 0)
    assert data(Load(delimited(spark, folder, "s")).clean) == sorted([(1, None), (2, "y")], key=repr)
    assert data(Load(delimited(spark, folder, "s", headers="same")).clean) == sorted([(1, None), (2, "y")], key=repr)
    put(folder, "2.csv", "a,b\n1,x,extra\n", 1)
    for headers in ("mixed", "same"):
        with pytest.raises(Exception, match="more values than columns"):
            Load(delimited(spark, folder, "s", headers=headers)).plan.count()


def test_promised_header_is_checked(spark, folder):
    put(folder, "1.csv", "a,b\n1,x\n", 0)
    put(folder, "2.csv", "b,a\ny,2\n", 1)
    with pytest.raises(Exception, match="header"):
        Load(delimited(spark, folder, "s", headers="same")).plan.count()


def test_quotes_and_line_breaks(spark, folder):
    put(folder, "1.csv", 'a,b\n1,"say ""hi"", ok"\n2,"two\nlines"\n', 0)
    load = Load(delimited(spark, folder, "s", multi_line=True))
    assert data(load.clean) == [(1, 'say "hi", ok'), (2, "two\nlines")]


def test_missing_words(spark, folder):
    put(folder, "1.csv", "a,b\n1,x\nNA,null\n,N/A\nnan,\n", 0)
    load = Load(delimited(spark, folder, "s"))
    assert load.plan.first()["observed"] == {"a": "integer", "b": "string"}
    assert data(load.clean) == sorted([(1, "x")] + [(None, None)] * 3, key=repr)


def test_batches_of_lines_keep_file_order(spark, folder):
    put(folder, "1.csv", "a\n" + "".join(f"{i}\n" for i in range(10)), 0)
    (piece,) = delimited(spark, folder, "s", batch_rows=4)
    found = {r["_batch"]: r["v"] for r in piece.frame.groupBy("_batch").agg(F.sort_array(F.collect_list("a")).alias("v")).collect()}
    assert found == {0: ["0", "1", "2", "3"], 1: ["4", "5", "6", "7"], 2: ["8", "9"]}


def test_json_columns_are_the_keys_of_the_batch(spark, folder):
    put(folder, "1.jsonl", '{"a": 1, "b": "x"}\n\n   \n{"a": 2, "c": null}\n', 0)
    put(folder, "2.jsonl", '{"a": 3.5, "b": "5"}\n{"a": 4, "b": "6", "d": {"z": [1]}}\n', 1)
    load = Load(json_lines(spark, folder, "s"), Options(max_coercion_loss_pct=60))
    plan = load.plan.orderBy("_batch").collect()
    assert [r["n_rows"] for r in plan] == [2, 2]
    assert plan[0]["observed"] == {"a": "integer", "b": "string", "c": "unknown"}
    assert plan[1]["observed"] == {"a": "float", "b": "string", "d": "string"}
    assert plan[1]["lost"] == {"a": 1}
    assert (4, "6", None, '{"z":[1]}') in data(load.clean)
    assert load.quarantined.first()["record_json"] == '{"a":3.5,"b":"5"}'


def test_json_booleans_and_mixed_tokens(spark, folder):
    put(folder, "1.jsonl", '{"f": true, "m": 1}\n{"f": false, "m": "x"}\n', 0)
    plan = Load(json_lines(spark, folder, "s")).plan.first()
    assert plan["observed"] == {"f": "boolean", "m": "string"}


def test_malformed_json_fails(spark, folder):
    put(folder, "1.jsonl", '{"a": 1}\n{"a": \n', 0)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        Load(json_lines(spark, folder, "s")).plan.count()


def test_positions_survive_a_hot_key(spark):
    frame = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    placed = positions(frame.repartition(5), "p", ["k", "id"]).orderBy("p").collect()
    assert [r["p"] for r in placed] == list(range(3000))
    assert [r["id"] for r in placed] == [i for i in range(3000) if i % 3] + list(range(0, 3000, 3))
    equal = positions(frame.withColumn("k", F.lit(1)), "p", ["k"])
    assert sorted(r["p"] for r in equal.collect()) == list(range(3000))


def test_row_batches(spark):
    counts = in_rows(spark.range(10), 4, ["id"]).groupBy("_batch").count().orderBy("_batch").collect()
    assert [tuple(r) for r in counts] == [(0, 4), (1, 4), (2, 2)]
    with pytest.raises(ValueError, match="positive"):
        in_rows(spark.range(10), 0, ["id"])


def test_unknown_kinds(spark):
    with pytest.raises(ValueError, match="unknown source type"):
        pieces_of(spark, "xml", "s")
    with pytest.raises(ValueError, match="unknown destination"):
        sinks.load_into(spark.range(1), "xml", "/nowhere")


def test_delimited_sink_matches_by_name(spark, folder):
    path = os.path.join(folder, "out")
    assert sinks.load_into(spark.createDataFrame([(1, "x")], "a int, b string"), "csv", path) == 1
    assert sinks.load_into(spark.createDataFrame([("y", 2.5, 2)], "b string, c double, a int"), "csv", path) == 1
    assert sinks.load_into(spark.createDataFrame([(3,)], "a int"), "csv", path) == 1
    assert sinks.existing_columns(spark, path) == ["a", "b", "c"]
    expected = [(1, "x", None), (2, "y", 2.5), (3, None, None)]
    assert data(Load(delimited(spark, path, "s")).clean) == sorted(expected, key=repr)


def test_table_sink_modes(spark, folder):
    path, frame = os.path.join(folder, "db"), spark.range(3)
    assert sinks.load_into(frame, "db", path, "t", "errorifexists") == 3
    sinks.load_into(frame, "db", path, "t")
    assert spark.read.parquet(f"{path}/t").count() == 6
    sinks.load_into(frame, "db", path, "t", "overwrite")
    assert spark.read.parquet(f"{path}/t").count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.load_into(frame, "db", path, "t", "errorifexists")


def test_json_sink_keeps_nulls(spark, folder):
    path = os.path.join(folder, "out")
    sinks.load_into(spark.createDataFrame([(1, None)], "a int, b string"), "jsonl", path)
    assert spark.read.text(path).first()[0] == '{"a":1,"b":null}'


def test_memory_sink_counts(spark):
    assert sinks.load_into(spark.range(42), "memory") == 42


def test_wide_delimited_files(spark, folder):
    names = [f"c{i}" for i in range(250)]
    line = ",".join(str(i % 7) if i % 2 else f"w{i}" for i in range(250))
    put(folder, "1.csv", ",".join(names) + "\n" + (line + "\n") * 20, 0)
    load = Load(delimited(spark, folder, "s"))
    seen = load.plan.first()["observed"]
    assert len(seen) == 250 and set(seen.values()) == {"integer", "string"}
    assert load.clean.count() == 20


def test_batches_of_rows_over_files_with_different_headers(spark, folder):
    put(folder, "1.csv", "a,b\n" + "".join(f"{i},x\n" for i in range(7)), 0)
    put(folder, "2.csv", "a,b\n" + "".join(f"{i},x\n" for i in range(7, 10)), 1)
    put(folder, "3.csv", "b,a,c\n" + "".join(f"x,{i},0.5\n" for i in range(10, 15)), 2)
    put(folder, "4.csv", "a,b\n15,x\n16,x\n", 3)
    pieces = delimited(spark, folder, "s", batch_rows=4)
    assert len(pieces) == 2
    found = {}
    for piece in pieces:
        for row in piece.frame.select("_batch", "a").collect():
            found.setdefault(row["_batch"], []).append(int(row["a"]))
    # ten rows of one header, five of another, two of the first again: a batch never holds two headers
    assert {k: sorted(v) for k, v in found.items()} == {
        0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9], 3: [10, 11, 12, 13], 4: [14], 5: [15, 16]
    }
    plan = Load(pieces).plan.orderBy("_batch").collect()
    assert [(r["n_rows"], r["disposition"]) for r in plan] == [
        (4, "CLEAN"), (4, "CLEAN"), (2, "CLEAN"), (4, "HEALED"), (1, "CLEAN"), (2, "HEALED")
    ]


def test_rare_keys_are_kept_in_one_column(spark, folder):
    common = "".join(f'{{"id": {i}, "v": 1.5, "k{i}": {i}, "n{i}": null}}\n' for i in range(3000))
    put(folder, "1.json", common, 0)
    put(folder, "2.json", '{"id": 3000, "v": 2}\n', 1)
    (piece,) = json_lines(spark, folder, "s", most_keys=2)
    assert piece.columns == ["id", "v", "_other_keys"]
    load = Load([piece])
    rows = {r["id"]: r["_other_keys"] for r in load.clean.collect()}
    assert len(rows) == 3001 and rows[3000] is None
    assert json.loads(rows[17]) == {"k17": 17, "n17": None}
    plan = load.plan.orderBy("_batch").collect()
    assert plan[0]["observed"] == {"id": "integer", "v": "float", "_other_keys": "string"}
    # a file without rare keys lacks the column
    assert plan[1]["removed"] == ["_other_keys"] and plan[1]["disposition"] == "HEALED"


def test_many_refused_batches_are_asked_for_by_ranges(spark, folder, monkeypatch):
    for n in range(30):
        put(folder, f"{n:02}.json", f'{{"id": {n}, "v": {n if n % 3 or not n else chr(34) + "x" + chr(34)}}}\n', n)
    options = Options(max_coercion_loss_pct=0)
    one_by_one = Load(json_lines(spark, folder, "s"), options)
    want = sorted(r["record_json"] for r in one_by_one.quarantined.collect())
    monkeypatch.setattr(heal, "_FEW", 3)
    monkeypatch.setattr(heal, "_RANGES", 4)
    by_range = Load(json_lines(spark, folder, "s"), options)
    assert by_range.healing.few is None and 1 <= len(by_range.healing.ranges) <= 4
    assert sorted(r["record_json"] for r in by_range.quarantined.collect()) == want and len(want) == 9
    (piece,) = by_range.pieces
    assert by_range.healing._narrowed(piece.rows, 0, "HEALING_FAILED").count() < 30


def sorts(frame):
    """How many aggregates of a plan sort their rows first."""
    return frame._jdf.queryExecution().executedPlan().toString().count("SortAggregate")


def test_the_profile_of_text_counts_without_sorting(spark, folder):
    spark.range(20).select("id", F.lit("x").alias("word")).write.json(f"{folder}/in")
    made = profile(json_lines(spark, f"{folder}/in", "s"), Options())
    assert sorts(made) == 0
    assert made.agg(F.sum("n_rows")).first()[0] == 20


@pytest.mark.parametrize("inferred", [{}, {"a": "text"}])
def test_the_least_message_of_a_batch_is_told(spark, inferred):
    rows = [(0, "1", "z"), (0, "2", None), (0, "3", "b"), (0, "x", "z"), (1, "1", None), (1, None, None)]
    frame = tag(spark.createDataFrame(rows, "k int, a string, _error string"), "s", F.col("k")).drop("k")
    made = profile([Piece(frame, inferred, judged=True)], Options()).orderBy(BATCH).collect()
    assert [(r["n_rows"], r["error"]) for r in made] == [(4, "b"), (2, None)]
    if inferred:
        assert [(c["bucket"], c["present"]) for r in made for c in r["observed"]] == [("string", 4), ("integer", 1)]


def test_headers_are_found_without_sorting_lines(spark, folder):
    for name, text in (("a", "k,v\n1,2\n"), ("b", "v\n3\n"), ("c", "k,v\n4,5\n6,7\n")):
        with open(f"{folder}/{name}.csv", "w") as out:
            out.write(text)
    found = _header_lines(spark, folder)
    assert sorts(found) == 0
    assert sorted((r["file"][-5:], r["line"]) for r in found.collect()) == [("a.csv", "k,v"), ("b.csv", "v"), ("c.csv", "k,v")]


def test_reserved_names_are_loaded_without_sorting_rows(spark, folder):
    """Data called ``_error`` is no message of a transform: no batch takes the least of it, from any kind of source."""
    given = spark.range(30).selectExpr("id", "'x' AS _source", "concat('e', id) AS _error", "id % 7 AS _tokens", "id / 2 AS _batch")
    sinks.write_delimited(given, f"{folder}/csv")
    sinks.write_jsonl(given, f"{folder}/jsonl")
    for pieces in (frame_pieces(given, "s", F.expr("_tokens % 3")), delimited(spark, f"{folder}/csv", "s"), json_lines(spark, f"{folder}/jsonl", "s")):
        assert sorts(profile(pieces, Options())) == 0
        found = with_own_names(Load(pieces).clean.drop("_source", "_batch")).select(*given.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, given.collect()))
