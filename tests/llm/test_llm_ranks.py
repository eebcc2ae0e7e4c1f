import random

from driftwarden.llm.ranks import running


def test_ranks_and_sums_are_gapless_within_a_key(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), i, rng.randrange(0, 5)) for i in range(700)]
    frame = spark.createDataFrame(rows, "k string, i long, w long").repartition(7)
    weight = {i: w for _, i, w in rows}
    ranks, sums = {}, {}
    for r in running(frame, "k", "i").collect():
        ranks.setdefault(r["k"], []).append(r["rank"])
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(len(v))) for k, v in ranks.items()}
    for r in running(frame, "k", "i", "w", "at").collect():
        sums.setdefault(r["k"], []).append((r["at"], weight[r["i"]]))
    for held in sums.values():
        at = 0
        for start, w in sorted(held):
            assert start == at
            at += w
    assert sum(map(len, sums.values())) == len(rows)


def test_no_rows(spark):
    assert running(spark.createDataFrame([], "k string, i long"), "k", "i").count() == 0
