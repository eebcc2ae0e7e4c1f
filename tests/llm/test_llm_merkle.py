import random
import zlib

import numpy as np
import pytest

from driftwarden.llm import merkle
from driftwarden.llm.merkle_query import tampered

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, block string"


def leaf_of(row):
    told = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5])
    return merkle.digest("".join(told))


def tree_of(digests):
    """Root, and for each leaf the siblings of its way up, as (before, after)."""
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([merkle.digest("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    ways = []
    for at in range(len(digests)):
        way = []
        for level in levels[:-1]:
            low = at // 16 * 16
            way.append(("".join(level[low:at]), "".join(level[at + 1 : low + 16])))
            at //= 16
        ways.append(way)
    return levels[-1][0], ways


def brute_force(rows, tamper):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    made, subroots = [], []
    for source in order:
        own = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroot, ways = tree_of([leaf_of(r) for r in own])
        subroots.append(subroot)
        made.append(list(zip(own, ways, strict=True)))
    root, tops = tree_of(subroots)
    out = []
    for subroot, top, own in zip(subroots, tops, made, strict=True):
        for row, way in own:
            changed = (*row[:4], tamper(row), *row[5:])
            end = merkle.folded(leaf_of(changed), way + top)
            proof = merkle.digest("".join(a + b for a, b in way + top))
            out.append((row[0], leaf_of(row), subroot, root, proof, end, end == root))
    return sorted(out, key=str)


def lower(row):
    hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4]) if hit and row[4] is not None else row[4]


def rows_of(n, sources, seed):
    rng = random.Random(seed)
    names = [None, "", "ä", "\U0001f600", "￿", "Z", *(f"s{i}" for i in range(sources))]
    made = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(names)
        text = rng.choice([None, "", "Text Ü", "same", f"T{i}", "x" * rng.randrange(3000)])
        made.append((i if rng.random() < 0.95 else None, source, rng.choice([None, "en"]), rng.choice([None, -i, i]), text, "a", 1, "b"))
    return made + made[:9] + [made[3]] * 40


@pytest.mark.parametrize(("n", "sources", "together"), [(700, 30, 7), (900, 1, 64), (300, 400, 4096)])
def test_against_brute_force(spark, n, sources, together):
    rows = rows_of(n, sources, n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(docs, tampered(), together=together)
    assert [f.split()[0] for f in merkle.PROOFS.split(", ")] == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, lower)


def test_a_lone_leaf_is_its_own_root_and_no_rows_give_none(spark):
    row = (7, "s", "en", 3, "A b", "a", 1, "b")
    only = merkle.manifest(spark.createDataFrame([row], SCHEMA)).first()
    assert (only.leaf, only.subroot, only.root, only.folded_root) == (leaf_of(row),) * 4
    assert only.proof == merkle.digest("")
    assert only.verified
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), tampered()).count() == 0


def test_a_multiproof_asks_for_the_least():
    """Nodes asked for are neither seen nor derived, and with the leaves' own they make every run whole."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 16, 17, 300, 5000):
        some = np.sort(rng.choice(n, min(n, 12), replace=False))
        known, size = set(some.tolist()), n
        for _, asked in merkle.octopus(some, n):
            runs = {k // 16 for k in known}
            whole = {k for run in runs for k in range(run * 16, min(size, run * 16 + 16))}
            assert set(asked.tolist()) == whole - known
            known, size = runs, -(-size // 16)
        assert size == 1
