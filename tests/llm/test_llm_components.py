import random

import numpy as np

from driftwarden.llm.components import components, least_labels


def expected(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root) if find(x) != x}


def test_against_brute_force(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)] + [(7, 7)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").repartition(16)
    assert {r["node"]: r["component"] for r in components(frame).collect()} == expected(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert len(least_labels(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0
