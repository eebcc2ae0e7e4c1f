from bisect import bisect_left

import pytest

from driftwarden.llm import mixing


def test_every_slot_is_within_one_block_of_the_target():
    for weights in ({"a": 1, "b": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {f"s{i}": i + 1 for i in range(40)}, {"only": 3}):
        held = mixing.earliest_deadline_first(mixing.whole_shares(weights), dict.fromkeys(weights, 200))
        ends, total = sum(map(len, held.values())), sum(weights.values())
        assert ends >= 200
        assert sorted(x for v in held.values() for x in v) == list(range(ends))
        for source, weight in weights.items():
            for t in range(ends + 1):
                assert abs(bisect_left(held[source], t) - t * weight / total) < 1


def test_phases_place_every_block_once():
    blocks = {"a": 17, "b": 3, "c": 40, "late": 5}
    made = mixing.stretches(blocks, {"a": 1, "b": 1, "c": 2})
    places = {}
    for p in made:
        for k, slot in enumerate(p.slots):
            assert places.setdefault(p.first_slot + slot, (p.source, p.first_block + k)) == (p.source, p.first_block + k)
    assert sorted(places) == list(range(sum(blocks.values())))
    assert len(set(places.values())) == sum(blocks.values())
    assert next(s for s in sorted(places) if places[s][0] == "late") == 60


@pytest.mark.parametrize("limits", [{}, {"most_sources": 2}, {"most_sources": 2, "most_slots": 9}])
def test_all_documents_are_placed(documents, prose, limits):
    rows = mixing.mix_sources(documents, block=4, **limits).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in prose]
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r["slot"], []).append(r)
    if not limits:
        assert sorted(by_slot) == list(range(len(by_slot)))
    for held in by_slot.values():
        assert len({r["source"] for r in held}) == 1
        assert sorted(r["place"] for r in held) == list(range(len(held)))
    counts = {}
    for r in rows:
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    assert "" in counts and sum(counts.values()) == len(prose)


def test_thousands_of_sources_in_two_levels(spark):
    """Groups hold their share, and so does the one large source within its group."""
    rows = [(i, "hot") for i in range(12_000)] + [(12_000 + i, f"site{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    found = mixing.mix_sources(docs, block=1, exponent=1.0, most_sources=1000).collect()
    assert sorted(r["doc_id"] for r in found) == [i for i, _ in rows]
    # one block of a slot holds one source
    assert len({(r["slot"], r["source"]) for r in found}) == len({r["slot"] for r in found})
    # exponent 1 keeps the sources' own shares: the large one is spread over the whole mix
    order = [r["source"] == "hot" for r in sorted(found, key=lambda r: (r["slot"], r["place"]))]
    tenths = [sum(order[i : i + 1500]) / 1500 for i in range(0, 15_000, 1500)]
    assert min(tenths) > 0.3


def test_blocks_grow_so_that_slots_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}") for i in range(5000)], "doc_id long, source string")
    slots = {r["slot"] for r in mixing.mix_sources(docs, block=1, most_slots=100).collect()}
    assert slots == set(range(len(slots))) and len(slots) <= 103


def test_no_rows_and_repeated_rows(spark, no_documents):
    assert mixing.mix_sources(no_documents).count() == 0
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "doc_id long, source string")
    assert sorted(r["doc_id"] for r in mixing.mix_sources(rows).collect()) == [1, 1, 2]


def test_given_weights_hold_over_hundreds_of_periods():
    weights = {"big": 0.61803, "mid": 0.38192, "rare": 0.00004, "odd": 0.00001}
    blocks = {"big": 250_000, "mid": 200_000, "rare": 500, "odd": 500}
    first = [p for p in mixing.stretches(blocks, weights) if p.phase == 0]
    ends, total = sum(p.blocks for p in first), sum(weights.values())
    assert ends > 300_000
    for p in first:
        share = weights[p.source] / total
        for k, slot in enumerate(p.slots):
            assert abs(k - slot * share) < 1 and abs(k + 1 - (slot + 1) * share) < 1
        assert abs(p.blocks - ends * share) < 1
    assert sorted(s for p in first for s in p.slots) == list(range(ends))


def test_blocks_have_the_size_asked_for_in_a_long_corpus(spark):
    rows = (1 << 20) + 1000
    docs = spark.range(rows).selectExpr("id AS doc_id", "concat('s', id % 3) AS source")
    found = mixing.mix_sources(docs, block=1).selectExpr("max(place)", "count(DISTINCT slot)", "max(slot)").first()
    assert tuple(found) == (0, rows, rows - 1)
