import re

import numpy as np
import pytest

from driftwarden.llm import jaccard


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def expected(prose, k, percent):
    sets = {i: shingles(t, k) for i, t in prose}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def answer(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_components_against_brute_force(documents, prose, k, percent):
    assert answer(jaccard.near_groups(documents, jaccard.Shingles(k, percent))) == expected(prose, k, percent)


def test_blocks_cut_into_chunks_lose_no_link(documents, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    assert answer(jaccard.near_groups(documents, jaccard.Shingles(4, 85))) == expected(prose, 4, 85)


def test_tree_finds_all_pairs_that_are_linked():
    rng = np.random.default_rng(0)
    rule = jaccard.Shingles(4, 85)
    base = [np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64)) for _ in range(20)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.03, rng.integers(0, 1 << 62, len(b), dtype=np.uint64), b)) for b in base * 6]
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    sets, n = [sets[i] for i in order], n[order]
    maps = jaccard.bitmaps(np.concatenate(sets), np.concatenate(([0], np.cumsum(n))), jaccard.width_of(int(n.max())))
    found = {(a, b) for x, y in jaccard.candidates(maps, n, rule) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (n[a] + n[b] - both):
                assert (a, b) in found
    assert len(found) < len(sets) ** 2 / 4


def test_keep_first_repeated_rows_and_no_rows(spark, documents, prose, no_documents):
    left = jaccard.keep_first(documents)
    assert left.columns == documents.columns
    want = sorted(i for i, (_, c) in expected(prose, 5, 80).items() if c == i)
    assert sorted(r["doc_id"] for r in left.collect()) == want
    assert jaccard.near_groups(no_documents).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (2, "A B c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_groups(rows).collect())) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_different_texts_under_one_id_are_documents_of_their_own(spark):
    def text(name, n=30):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [(3, text("a")), (5, text("a") + " end"), (5, text("b")), (7, text("b") + " end"), (5, text("c")), (8, text("c")), (5, "the last"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in jaccard.keep_first(docs).collect()), key=str)
    assert left == sorted([(3, text("a")), (5, text("b")), (5, text("c")), (5, "the last"), (9, None)], key=str)
    got = sorted((r.doc_id, r.component_id) for r in jaccard.near_groups(docs).collect())
    assert got == sorted([(3, 3), (5, 3), (5, 5), (7, 5), (5, 5), (8, 5), (5, 5), (9, 9)])
