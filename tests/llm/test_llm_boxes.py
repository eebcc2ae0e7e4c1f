"""The join of near vectors by boxes: passes, chunks, dense groups, and what it leaves on disk."""

import glob
import os

import numpy as np
import pytest

from driftwarden import scratch
from driftwarden.llm import boxes, vectors

SCHEMA = "vec_id long, label int, embedding array<float>"


def links(made, labels, cosine=0.98):
    unit = made.astype(np.float64) / np.linalg.norm(made.astype(np.float64), axis=1)[:, None]
    near = (unit @ unit.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    least = np.arange(len(made))
    while True:
        lower = np.minimum(least, np.where(near, least[None, :], len(made)).min(1))
        if (lower == least).all():
            return near.sum(1), least
        least = lower


def cloud(rng, n, size, spread):
    """Random vectors; a third of them lie around others, some just within and some just beyond the limit."""
    made = rng.normal(size=(n, size))
    made[-n // 3 :] = made[: n // 3 + (n % 3 > 0)] + rng.uniform(0, spread, size=(len(made[-n // 3 :]), 1)) * rng.normal(size=(len(made[-n // 3 :]), size))
    return made.astype(np.float32)


@pytest.mark.parametrize("size", [64, 100, 20, 3])
@pytest.mark.parametrize("dense", [False, True])
def test_every_pair_is_met_once(size, dense):
    rng = np.random.default_rng(size)
    made = cloud(rng, 900, size, 0.3)
    if dense:
        made[:300] = rng.normal(size=size) + 0.12 * rng.normal(size=(300, size))
    ids, copies = np.arange(len(made)), rng.integers(1, 4, size=len(made))
    near, least = links(made, np.zeros(len(made)))
    group = boxes.Group(made, ids, copies, 0.98)
    for number in range(len(group.parts)):
        start = boxes.start_of(0.98, size, number)
        group.pairs_of(start, start.open, 30)
    counts, root = group.found()
    unit = made.astype(np.float64) / np.linalg.norm(made.astype(np.float64), axis=1)[:, None]
    both = unit @ unit.T >= 0.98
    np.fill_diagonal(both, False)
    assert (counts == both @ copies).all()
    assert len(np.unique(root)) == len(np.unique(least)) and (least[root] == least).all()


@pytest.mark.parametrize("chunk", [200, 40])
def test_large_labels_take_several_passes(spark, monkeypatch, chunk):
    rng = np.random.default_rng(chunk)
    made = cloud(rng, 1200, 64, 0.3)
    # a group that no cut makes smaller
    made[:150] = rng.normal(size=64) + 0.1 * rng.normal(size=(150, 64))
    labels = rng.integers(0, 3, size=len(made))
    labels[labels == 2] = rng.integers(2, 60, size=np.count_nonzero(labels == 2))
    for name, value in (("CHUNK", chunk), ("CELL_TARGET", 16), ("PASS_LEAST", 1), ("SEEN", 20)):
        monkeypatch.setattr(vectors, name, value)
    taken = []
    monkeypatch.setattr(vectors.Plan, "passes", lambda self, *a, f=vectors.Plan.passes: taken.append(f(self, *a)) or taken[-1])
    rows = spark.createDataFrame([(i, int(labels[i]), made[i].tolist()) for i in range(len(made))], SCHEMA).repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(rows).collect()}
    n, least = links(made, labels)
    assert got == {i: (int(n[i]), int(least[i]), bool(least[i] == i)) for i in range(len(made))}
    assert len(taken[0]) > 1


def test_no_vector_is_left_in_the_shared_folder(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    made = cloud(rng, 3000, 64, 0.3)
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    rows = spark.createDataFrame([(i, i % 2, made[i].tolist()) for i in range(len(made))], SCHEMA).repartition(4)
    assert vectors.near_vectors(rows).count() == len(made)
    left = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/**/*.parquet", recursive=True))
    assert 0 < left < made.nbytes / 4
