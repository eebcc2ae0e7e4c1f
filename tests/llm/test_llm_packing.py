import random

import numpy as np
import pyarrow as pa
import pytest

from driftwarden.llm import mixing, packing
from driftwarden.llm.packing_query import digest, vocabulary
from driftwarden.llm.tokens import Encoder

ODD = [
    "", None, "a  b", "x   y", "x    z <|endoftext|> q", "<|endoftext|>", " lead", "trail  ", "\n\n a\t\tb'll we're  I'd",
    "é　 f\u0085 g", "1 23  4.5...!!! ok", "\x1c a \x1f  b", "日本 語 です", "a\r\n\r\nb", "a < b <| c", "word " * 4000, " thin space line",
]


def reference(texts):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary())
    return [[*made.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def test_ids_are_those_of_the_tokenizer(prose):
    texts = ODD + [t for _, t in prose] + ODD
    coder, got = Encoder(vocabulary()), []
    for ids, first, _ in coder.documents(pa.array(texts)):
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == reference(texts)


def test_memory_of_runs_is_bounded(prose, monkeypatch):
    monkeypatch.setattr("driftwarden.llm.tokens.REMEMBERED_RUNS", 50)
    monkeypatch.setattr("driftwarden.llm.tokens.RECENT_RUNS", 10)
    texts, coder, got = [t for _, t in prose], Encoder(vocabulary()), []
    for part in (texts[:80], texts[80:], texts[:80]):
        for ids, first, _ in coder.documents(pa.array(part, pa.string())):
            got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == reference([*texts, *texts[:80]])


def test_closest_subset_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = packing.closest(counts, room)
        assert sum(x * k for x, k in used.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[x] for x, k in used.items())


@pytest.mark.parametrize("lengths", [[600] * 50, [1023] * 9, [1], [5, 6, 7] * 40, list(range(1, 1024))])
def test_plan_fills_all_but_the_last_sequence(lengths):
    counts = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    filled = {}
    for length, (bounds, first, row, table) in packing._tables(packing.plan(counts, 1024, 3)).items():
        for rank in range(counts[length]):
            i = np.searchsorted(bounds, rank, "right") - 1
            at = 0
            for start, size, sequence, offset in (
                (t[2], t[3], t[4] + rank - t[0], t[5]) for t in table[row[first[i] : first[i + 1]]]
            ):
                assert start == at
                at += size
                filled.setdefault(sequence, []).append((offset, size))
            assert at == length
    gaps = []
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        gaps.append(1024 - at)
    assert min(gaps) >= 0 and sum(g > 0 for g in gaps) <= 1


def test_pieces_cover_every_document(spark):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, row int").repartition(2)
    rows = packing.pack(docs, vocabulary(), capacity=64).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert len(r["ids"]) == r["length"]
        if r["doc_id"] not in (3, None):
            got.setdefault(r["doc_id"], []).extend(r["ids"])
    for (i, _), ids in zip(texts, reference([t for _, t in texts]), strict=True):
        assert i in (3, None) or got[i] == ids
    assert sum(r["length"] for r in rows) == sum(map(len, reference([t for _, t in texts])))
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert at.get(r["sequence_id"], 0) == r["offset"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 64 and sum(x < 64 for x in at.values()) <= 1


def test_no_rows(no_documents):
    assert digest(packing.pack(no_documents, vocabulary())).count() == 0


def test_sequences_keep_the_mix(spark, tmp_path):
    """Any thousand sequences in a row hold the sources by their target weights, and rows stay close to their place."""
    rng = random.Random(8)
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    rows = []
    for source, weight in weights.items():
        for _ in range(int(24_000 * weight)):
            rows.append((len(rows), " ".join("word" for _ in range(rng.randrange(1, 25))), source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    mixing.in_order(docs, weights=weights, block=4).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    pieces = packing.pack(mixed, vocabulary(), capacity=64, in_order=True).select("doc_id", "sequence_id", "offset", "length").collect()
    source = {i: s for i, _, s in rows}
    held = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], []).append(r)
    assert sorted(held) == list(range(len(held)))
    assert sum(sum(r["length"] for r in h) < 64 for h in held.values()) <= 1
    for at in range(0, len(held) - 1000, 500):
        counts = dict.fromkeys(weights, 0)
        for sequence in range(at, at + 1000):
            for r in held[sequence]:
                counts[source[r["doc_id"]]] += r["length"]
        for name, weight in weights.items():
            assert abs(counts[name] / 64_000 - weight) < 0.06, (at, counts)


def test_rows_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    spark.range(0, 1000, 1, 7).selectExpr("id as doc_id", "cast(id as string) as text").write.parquet(f"{tmp_path}/t")
    found = packing.numbered(spark.read.parquet(f"{tmp_path}/t")).collect()
    assert sorted((r["_pack_row"], r["doc_id"]) for r in found) == [(i, i) for i in range(1000)]
