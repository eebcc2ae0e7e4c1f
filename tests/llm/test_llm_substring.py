import re

import pytest

from driftwarden.llm import substring


def expected(prose):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in prose}
    least = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][k : k + 13]), i)
    made = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        made[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return made


def answer(frame):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in frame.collect()}


def test_kept_words_against_brute_force(documents, prose):
    assert answer(substring.dedup_substrings(documents)) == expected(prose)


@pytest.mark.parametrize(("part_bits", "fewest"), [(18, 1), (0, 64), (3, 1 << 12)])
def test_slices_ranges_and_parts_do_not_matter(documents, prose, monkeypatch, part_bits, fewest):
    monkeypatch.setattr(substring, "LEAST_SLICE", 500)
    monkeypatch.setattr(substring, "MOST_SLICE", 700)
    monkeypatch.setattr(substring, "FEWEST_RANGES", fewest)
    monkeypatch.setattr(substring, "PART_BITS", part_bits)
    assert answer(substring.dedup_substrings(documents)) == expected(prose)


def test_a_crowded_sketch_loses_nothing(documents, prose, monkeypatch):
    monkeypatch.setattr(substring, "CELL_BITS", 3)
    assert answer(substring.dedup_substrings(documents)) == expected(prose)


def test_the_load_of_a_cell_does_not_grow():
    for size in (10**9, 10**11, 10**12, 10**13, 10**14):
        sketch = substring.Sketch.of(size)
        windows = size / substring.BYTES_A_WINDOW
        assert windows / 2 ** (sketch.bits + sketch.cell_bits) <= 1 / substring.CELLS_A_WINDOW
        # a row of a slice has dozens of windows, and a part stays small enough for one task
        assert sketch.slice_bytes / substring.BYTES_A_WINDOW / sketch.parts >= 32
        assert windows / sketch.parts * sketch.width < 4 * 10**8


@pytest.mark.parametrize("digest", [False, True])
def test_repeated_rows_missing_ids_and_no_rows(spark, no_documents, sha, digest):
    assert substring.dedup_substrings(no_documents, digest).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "new " + text), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, substring.dedup_substrings(rows, digest).collect()))
    tell = sha if digest else str
    assert got == [(1, 20, 0, tell(text)), (1, 20, 0, tell(text)), (2, 21, 20, tell("new")), (3, 0, 0, tell(""))]


def test_rows_of_one_id_with_different_texts(spark):
    def text(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    first, second, own = text("a", 20), text("b", 31), text("own", 17)
    rows = [(1, first), (2, second), (5, f"{own} {first}"), (5, f"{second} tail"), (5, text("c", 15)), (6, f"{text('c', 15)} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["kept"]) for r in substring.dedup_substrings(docs).collect())
    assert got == sorted(
        [(1, 20, first), (2, 31, second), (5, 37, own), (5, 32, "tail"), (5, 15, text("c", 15)), (6, 16, "end")]
    )
