"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block`` documents. The k-th block of a source with the share w of all weights has the window
from floor(k / w) to ceil((k + 1) / w); earliest deadline first fills the slots, one block each. Windows follow from the weights
themselves, as ratios of whole numbers without rounding, so at every slot each source has had its share to within less than
one block, however long the corpus and however small the share. The driver computes the slots, at eight bytes for a block, and tasks
look up the slot of each document's block. Blocks have the size asked for however many there are, so that a place in the mix does not
depend on how large the corpus is; only a caller that gives ``most_slots`` has larger blocks from that number on.

Beyond ``MOST_SOURCES`` sources there are two levels: sources are dealt to groups, tasks schedule the sources of a group over slots of its
own, and the driver schedules the groups, in chunks of their slots, by the same rule. A source is then within less than a block of
its share of its group, and the group within less than a chunk of its share.

When a source runs out, the target can no longer be met: a new phase begins, with the weights of the sources
that are left. Phase 0 is the part of the corpus (of a group) that is on target. Sources without a weight come last.

Defined results: a null source is the empty name; repeated rows are documents of their own; rows without a doc_id are left
out; an empty table gives an empty schedule.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.ranks import running
from driftwarden.llm.tables import stored

#: Sources that the driver schedules one by one.
MOST_SOURCES = 50_000
SCHEDULE = "doc_id long, source string, phase int, slot long, place int"


def whole_shares(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def earliest_deadline_first(shares: dict[str, int], have: dict[str, int]) -> dict[str, array]:
    """The slots of each source, until a source is due that has none of its ``have`` blocks left."""
    total = sum(shares.values())
    ready = [(-(-total // c), s) for s, c in shares.items()]
    heapq.heapify(ready)
    released: dict[int, list[tuple[int, str]]] = {}
    held = {s: array("q") for s in shares}
    for slot in range(sum(have.values())):
        for job in released.pop(slot, ()):
            heapq.heappush(ready, job)
        source = heapq.heappop(ready)[1]
        k, c = len(held[source]) + 1, shares[source]
        if k > have[source]:
            break
        held[source].append(slot)
        job = (-(-(k + 1) * total // c), source)
        if (release := k * total // c) <= slot + 1:
            heapq.heappush(ready, job)
        else:
            released.setdefault(release, []).append(job)
    return held


@dataclass(frozen=True)
class Stretch:
    """Blocks of one source in one phase."""

    source: str
    phase: int
    first_block: int
    blocks: int
    first_slot: int
    slots: array


def stretches(blocks: dict[str, int], weights: dict[str, float]) -> list[Stretch]:
    """All phases of a mix of ``blocks`` per source, by ``weights``; the rest follows by the blocks it has."""
    shares = whole_shares({s: w for s, w in weights.items() if s in blocks and w > 0})
    used, made, phase, at = dict.fromkeys(blocks, 0), [], 0, 0
    while left := {s: n - used[s] for s, n in blocks.items() if n > used[s]}:
        wanted = {s: shares[s] for s in left if s in shares} or left
        held = earliest_deadline_first(wanted, {s: left[s] for s in wanted})
        ends = sum(map(len, held.values()))
        for s, slots in held.items():
            if slots:
                made.append(Stretch(s, phase, used[s], len(slots), at, slots))
            used[s] += len(slots)
        at, phase = at + ends, phase + 1
    return made


def tempered(counts: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares between the sources' own (1) and equal ones (0)."""
    return {s: float(n) ** exponent for s, n in counts.items()}


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, block: int = 32, exponent: float = 0.5, most_slots: int | None = None,
    most_sources: int = MOST_SOURCES,
) -> DataFrame:
    """Every document's place in the mix: doc_id, source, phase, slot, place within the slot's block.

    Without ``weights`` the target is the tempered share of each source. ``block`` is the size of a block, and with ``most_slots`` the least size.
    """
    named = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source")
    )
    sizes = stored(named.groupBy("source").count(), "mix-sizes")
    many = sizes.agg(F.count("*").alias("sources"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    if most_slots is not None:
        block = max(block, -(-many["rows"] // most_slots))
    ranked = running(named, "source", "doc_id").select("doc_id", "source", "rank")
    if many["sources"] > most_sources:
        return _by_groups(ranked, sizes, weights, block, exponent, most_slots, most_sources, many["sources"])
    counts = {row["source"]: row["count"] for row in sizes.collect()}
    weights = tempered(counts, exponent) if weights is None else weights
    parts: dict[str, list[Stretch]] = {}
    for part in stretches({s: -(-n // block) for s, n in counts.items()}, weights):
        parts.setdefault(part.source, []).append(part)
    held = docs.sparkSession.sparkContext.broadcast({s: _table(own) for s, own in parts.items()})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            code = batch.column("source").dictionary_encode()
            index = code.indices.to_numpy(zero_copy_only=False)
            phase, slot = np.zeros(len(rank), np.int32), np.zeros(len(rank), np.int64)
            for i, source in enumerate(code.dictionary.to_pylist()):
                mine = np.flatnonzero(index == i)
                number = rank[mine] // block
                first_block, phases, slots = plan[source]
                slot[mine] = slots[number]
                phase[mine] = phases[np.searchsorted(first_block, number, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("source"), pa.array(phase), pa.array(slot),
                    pa.array((rank % block).astype(np.int32)),
                ],
                names=["doc_id", "source", "phase", "slot", "place"],
            )

    return ranked.mapInArrow(placed, SCHEDULE)


_LOCAL = "group long, source string, number long, phase int, slot long, weight double"


def _by_groups(
    ranked: DataFrame, sizes: DataFrame, weights: dict[str, float] | None, block: int, exponent: float, most_slots: int | None, most_sources: int, sources: int
) -> DataFrame:
    """Both levels: blocks get their slot within the group in tasks, groups their slots on the driver."""

    def schedule(table: pa.Table) -> pa.Table:
        counts = dict(zip(table.column("source").to_pylist(), table.column("count").to_pylist(), strict=True))
        wanted = tempered(counts, exponent) if weights is None else {s: weights[s] for s in counts if s in weights}
        parts = stretches({s: -(-n // block) for s, n in counts.items()}, wanted)
        size = [p.blocks for p in parts]
        return pa.table({
            "group": pa.array(np.full(sum(size), table.column("group")[0].as_py(), np.int64)),
            "source": pa.array([p.source for p in parts for _ in range(p.blocks)], pa.string()),
            "number": pa.array(np.concatenate([p.first_block + np.arange(p.blocks) for p in parts])),
            "phase": pa.array(np.repeat([p.phase for p in parts], size).astype(np.int32)),
            "slot": pa.array(np.concatenate([p.first_slot + np.frombuffer(p.slots, np.int64) for p in parts])),
            "weight": pa.array(np.full(sum(size), sum(wanted.values()), np.float64)),
        })

    groups = -(-2 * sources // most_sources)
    dealt = sizes.withColumn("group", F.expr(f"pmod(xxhash64(source), {groups})"))
    local = stored(dealt.groupBy("group").applyInArrow(schedule, _LOCAL), "mix-local")
    held = {r["group"]: r for r in local.groupBy("group").agg(F.count("*").alias("n"), F.max("weight").alias("weight")).collect()}
    chunk = 1 if most_slots is None else max(1, -(-sum(r["n"] for r in held.values()) // most_slots))
    names = {str(g): r for g, r in held.items()}
    weighted = {g: r["weight"] for g, r in names.items() if r["weight"] > 0}
    above = stretches({g: -(-r["n"] // chunk) for g, r in names.items()}, weighted)
    table = {g: _table([p for p in above if p.source == g])[2] for g in names}
    shared = ranked.sparkSession.sparkContext.broadcast(table)

    def lifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, slot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "slot"))
            whole = np.zeros(len(slot), np.int64)
            for g in np.unique(group):
                mine = np.flatnonzero(group == g)
                whole[mine] = shared.value[str(g)][slot[mine] // chunk] * chunk + slot[mine] % chunk
            columns = [batch.column("source"), batch.column("number"), batch.column("phase"), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "number", "phase", "slot"])

    slots = local.mapInArrow(lifted, "source string, number long, phase int, slot long")
    blocks = ranked.withColumn("number", F.expr(f"rank div {block}"))
    return blocks.join(slots, ["source", "number"]).select(
        "doc_id", "source", "phase", "slot", F.expr(f"cast(rank % {block} as int)").alias("place")
    )


def _table(parts: list[Stretch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one source: where its phases begin, their numbers, and the slot of each of its blocks."""
    slots = [p.first_slot + np.frombuffer(p.slots, np.int64) for p in parts]
    return np.array([p.first_block for p in parts]), np.array([p.phase for p in parts], np.int32), np.concatenate(slots)


def in_order(docs: DataFrame, **options) -> DataFrame:
    """Every row with all its columns, sorted by its place in the mix over the partitions; rows without a doc_id come last.

    Rows equal in doc_id and source stand together at the place of the first.
    """
    key, name = F.col("doc_id").cast("long"), F.coalesce("source", F.lit(""))
    places = (
        mix_sources(docs, **options)
        .groupBy(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"))
        .agg(F.min(F.struct("slot", "place")).alias("_mix_at"))
    )
    named = docs.where("doc_id is not null")
    placed = named.join(places, (key == F.col("_mix_id")) & (name == F.col("_mix_source")), "left")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "_mix_at").sortWithinPartitions("_mix_at").select(*docs.columns)
    return ordered.unionByName(docs.where("doc_id is null"))
