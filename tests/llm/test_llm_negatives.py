import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwarden.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, part string, positive int"


def whole(vector):
    bound = math.floor(math.sqrt(2**56 / len(vector))) if vector else 0
    return tuple(math.floor(max(-bound, min(bound, 256 * float(np.float32(x))))) for x in vector)


def brute_force(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    good = {
        (r[0], r[2], whole(r[1])) for r in rows
        if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    }
    out = []
    for anchor in (g for g in good if is_anchor(g[0])):
        met = [
            (-sum(x * y for x, y in zip(anchor[2], g[2], strict=True)), g[0], g[1] == anchor[1], g[0] != anchor[0])
            for g in good if len(g[2]) == len(anchor[2])
        ]
        for cost, positive in sorted((c, i) for c, i, same, other in met if same and other)[:positives]:
            window = sorted((c, i) for c, i, same, _ in met if not same and low * -cost <= high * -c <= high * -cost)
            out += [(anchor[0], positive, k + 1, i, -cost, -c) for k, (c, i) in enumerate(window[:negatives])]
    return sorted(out)


def answer(spark, rows, is_anchor, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = negatives.mine(negatives.usable(frame), is_anchor, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize(("per_anchor", "per_tile"), [(1024, 4096), (3, 2)])
def test_against_brute_force(spark, per_anchor, per_tile):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        kind = rng.random()
        base = [rng.gauss(0, 1) for _ in range(12)] if kind < 0.6 else [0.5] * 12
        label = 0 if rng.random() < 0.4 else rng.randrange(5)
        rows.append((i, base, label, 1.0, "a", 1))
    rows += [(900, None, 1, 1.0, "a", 1), (910, [0.1] * 12, None, 1.0, "a", 1), (920, [0.1] * 11 + [None], 1, 1.0, "a", 1)]
    rows += [(930, [math.inf] * 12, 1, 1.0, "a", 1), (940, [math.nan] * 12, 1, 1.0, "a", 1), (None, [0.5] * 12, 1, 1.0, "a", 1)]
    rows += [(950, [1.0, 2.0], 1, 1.0, "a", 1), (951, [1.0, 1.9], 1, 1.0, "a", 1), (952, [1.0, 1.8], 2, 1.0, "a", 1), (960, [], 1, 1.0, "a", 1), (961, [], 2, 1.0, "a", 1)]
    rows += [(970, [3e38] * 12, 1, 1.0, "a", 1), (971, [2e30] * 12, 1, 1.0, "a", 1), (972, [1e30] * 12, 0, 1.0, "a", 1)]
    rows += rows[:20] + [(30, [0.25] * 12, 3, 1.0, "a", 1), (30, [0.25] * 12, 4, 1.0, "a", 1)]
    got = answer(spark, rows, F.col("vec_id") % 10 == 0, per_anchor=per_anchor, per_tile=per_tile, leaf=2)
    assert got == brute_force(rows, lambda i: i % 10 == 0)
    assert len(got) > 100


def test_many_tiles_merge_in_steps(spark, monkeypatch):
    monkeypatch.setattr(negatives, "FAN", 2)
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.5, 0.25]) for _ in range(4)], i % 3, 1.0, "a", 1) for i in range(90)]
    got = answer(spark, rows, F.col("vec_id") % 30 == 0, per_tile=4, positives=2, negatives=3, low=50)
    assert got == brute_force(rows, lambda i: i % 30 == 0, 2, 3, 50)


def test_no_rows_and_no_anchors(spark):
    assert answer(spark, [], F.col("vec_id") % 10 == 0) == []
    assert answer(spark, [(1, [1.0], 1, 1.0, "a", 1), (2, [1.0], 2, 1.0, "a", 1)], F.col("vec_id") % 10 == 0) == []
    assert answer(spark, [(10, [1.0], 1, 1.0, "a", 1), (2, [1.0], 2, 1.0, "a", 1)], F.col("vec_id") % 10 == 0) == []


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 9), (33, 65, 40), (70, 64, 129), (0, 3, 4), (3, 0, 2)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(3)
    m, k, n = shape
    a = rng.integers(-(1 << 25), 1 << 25, (m, k))
    b = rng.integers(-(1 << 25), 1 << 25, (k, n))
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, c, strict=True)) for c in b.T] for r in a], object).reshape(m, n)
    for leaf in (1, 4, 32):
        assert (negatives.strassen(a, b, leaf) == want).all()
