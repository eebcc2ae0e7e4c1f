import numpy as np
import pytest

from driftwarden.llm import vectors


def expected(rows, cosine):
    good = {}
    for i, (number, label, e) in enumerate(rows):
        if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            good[i] = np.array(e, np.float32).astype(float)
    links = {i: set() for i in range(len(rows))}
    for i, x in good.items():
        for j, y in good.items():
            if i != j and rows[i][1] == rows[j][1] and len(x) == len(y):
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[i].add(j)
    made = {}
    for i, (number, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += [k for k in links[todo.pop()] if k not in seen and not seen.add(k)]
        made[number] = (len(links[i]), min(rows[k][0] for k in seen))
    return made


@pytest.fixture
def rows():
    rng = np.random.default_rng(5)
    made = []
    for centre in rng.normal(size=(25, 32)):
        for _ in range(rng.integers(1, 12)):
            made.append((centre * rng.uniform(0.1, 9) + 0.05 * rng.normal(size=32)).astype(np.float32).tolist())
    made += [made[0]] * 20 + [[0.0] * 32, None, [], [1.0, None], [float("nan")] * 32, [float("inf")] * 32, [1.0] * 5, [2.0] * 5]
    return [(i, None if i % 17 == 3 else i % 2, e) for i, e in enumerate(made)]


@pytest.mark.parametrize("chunk", [1000, 4])
def test_links_and_components_against_brute_force(spark, rows, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    monkeypatch.setattr(vectors, "CELL_TARGET", 10)
    table = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, label int, embedding array<float>, block int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(table.repartition(3)).collect()}
    assert got == expected(rows, 0.98)


def test_no_rows(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
