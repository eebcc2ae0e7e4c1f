import os

from checks.fixtures import event_pieces
from driftwarden import Load, Options, Piece
from driftwarden.streaming.stream import judge, publish, read_summaries

SF = "/root/testdata/sf0.001"


def drain(summaries, out, checkpoint):
    query = (
        judge(summaries, Options()).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert query.exception() is None


def test_stream_reaches_the_verdicts_of_the_batch_fold(spark, folder):
    inbox, out, checkpoint = (os.path.join(folder, n) for n in ("in", "out", "check"))
    pieces = event_pieces(spark, SF)
    known = {"value": {"float"}, "event_id": {"integer"}}
    # the query stops and is started again between two arrivals
    for low, high in ((0, 4), (5, 9)):
        arrived = [Piece(p.frame.where(f"_batch between {low} and {high}"), p.inferred) for p in pieces]
        publish(arrived, inbox, Options(), known)
        drain(read_summaries(spark, inbox, 1000), out, checkpoint)
    columns = ["disposition", "expected_version", "evolved_to", "loss", "n_rows"]
    got = {int(r["batch_id"]): tuple(r[c] for c in columns) for r in spark.read.parquet(out).collect()}
    plan = Load(event_pieces(spark, SF)).plan
    assert got == {r["_batch"]: tuple(r[c] for c in columns) for r in plan.collect()}
    # nothing new: nothing emitted twice
    drain(read_summaries(spark, inbox, 1000), out, checkpoint)
    assert spark.read.parquet(out).count() == 10
