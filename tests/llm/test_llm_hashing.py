"""Words that a polynomial modulo a power of two cannot tell apart."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from driftwarden.llm import hashing, jaccard, packing, substring
from driftwarden.llm.packing_query import vocabulary
from driftwarden.llm.tokens import Encoder


def pair(size, a="a", b="b"):
    """A Thue-Morse word and its complement."""
    word = "".join((a, b)[bin(i).count("1") % 2] for i in range(size))
    return word, word.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("size", [1024, 4096, 1 << 15])
@pytest.mark.parametrize("seed", [1, 2, 7])
def test_thue_morse_words_have_hashes_of_their_own(size, seed):
    for letters in ("ab", "01", "xz"):
        (words,) = hashing.slices(pa.array([" ".join(pair(size, *letters))]))
        first, second = words.hashes(seed)
        assert first != second


def test_hashes_follow_the_bytes_and_not_their_place():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \0") for _ in range(rng.randrange(2000))) for _ in range(60)] + ["\0", "\0\0"]
    told = {}
    for words in hashing.slices(pa.array(texts), limit=3000):
        for start, end, hashed in zip(words.starts, words.ends, words.hashes().tolist(), strict=True):
            told.setdefault(words.data[start:end].tobytes(), set()).add(hashed)
    assert all(len(found) == 1 for found in told.values())
    assert len({min(found) for found in told.values()}) == len(told)


def test_very_long_words_take_a_digest(monkeypatch):
    monkeypatch.setattr(hashing, "_SUMMED", 100)
    data = np.frombuffer(("x" * 200 + "y" + "x" * 200).encode(), np.uint8)
    starts, ends = np.array([0, 201, 0, 0]), np.array([200, 401, 99, 201])
    a, b, c, d = hashing.byte_runs(data, starts, ends).tolist()
    assert a == b
    assert len({a, c, d}) == 3


def test_removed_words(spark):
    first, second = pair(1024)
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{first} {rest}"), (2, f"{second} {rest}"), (3, f"{first} {rest}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring.dedup_substrings(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_linked_sets(spark):
    first, second = pair(2048)
    docs = spark.createDataFrame([(1, first), (2, second), (3, second)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_groups(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def reference(texts):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary())
    return [[*made.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def encoded(coder, texts):
    out = []
    for ids, first, _ in coder.documents(pa.array(texts)):
        out += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def test_ids(spark):
    texts = ["x " + word for word in pair(1024)]
    assert encoded(Encoder(vocabulary()), texts) == reference(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = packing.tokenized(docs, vocabulary()).collect()
    assert {r.doc_id: r.doc_tokens for r in tokens} == {i: len(ids) for i, ids in enumerate(reference(texts))}


def test_ids_where_all_hashes_collide(prose, monkeypatch):
    """Bytes decide: within a slice, against remembered runs, and for runs too long to be remembered."""
    monkeypatch.setattr("driftwarden.llm.tokens.byte_runs", lambda data, starts, ends: np.zeros(len(starts), np.uint64) + (ends - starts) % 2)
    coder = Encoder(vocabulary())
    texts = [t for _, t in prose if t and len(t) < 3000][:30] + ["long" * 40, "gnol" * 40, "long" * 40]
    want = reference(texts)
    for some in (slice(0, 5), slice(3, 40), slice(0, 40)):
        assert encoded(coder, texts[some]) == want[some]


def test_sequences_of_few_hashes():
    words = np.array([int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in "abbabaabbaababba"], np.uint64)
    hashed, _ = hashing.windows(words, np.array([0, 8, 16]), 8)
    assert hashed[0] != hashed[1]
