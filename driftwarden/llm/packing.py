"""Packing by minimum bin slack: documents' tokens into sequences of a fixed capacity.

1. Documents are tokenized and cut at multiples of the capacity. Full pieces are sequences of their own; what is left
   of a document is an item of 1 to capacity - 1 tokens.
2. The plan works on the histogram of item lengths, which has at most capacity - 1 bins however large the corpus
   is. The longest length opens a sequence; a subset-sum over bitsets finds the multiset of remaining lengths that
   comes closest to the capacity, backtracking tells how many of each, and the multiset is repeated as often as the
   counts allow. If a gap stays although items are left, one of them is cut to fill it (a text may be cut anywhere)
   and its rest goes back to the histogram. Only the last sequence can have a gap.
3. Items get their rank within their length (no task holds a whole length), and rank tells sequence and
   offset. Pieces then take their ids from the stored ids of their document.
4. *In order.* Rows of a stored table can be packed in the order of its files: ranks follow the rows, and sequences are numbered by the row
   of their first piece, so sequences that follow each other hold rows that did. A mix of sources stays one.

Defined results: a null or empty text is the single end id; every row is a document of its own, also with a doc_id that is null or
repeated; an empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.llm.hashing import take_ranges
from driftwarden.llm.ranks import running
from driftwarden.llm.tables import stored
from driftwarden.llm.tokens import encoder

CAPACITY, ROWS_AT_ONCE = 1024, 1000
_TOKENIZED = "row long, doc_id long, doc_tokens long, token_ids binary"
_PLACES = "row long, start long, length long, sequence_id long, offset long"
_PIECES = _PLACES.replace("row", "doc_id") + ", doc_tokens long, ids array<int>"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows of a stored table with ``row``, their place in the order of its files; the files' sizes are all that is gathered."""
    places = docs.select(*docs.columns, F.col("_metadata.file_path").alias("_pack_file"), F.col("_metadata.row_index").alias("_pack_at"))
    sizes = places.groupBy("_pack_file").agg((F.max("_pack_at") + 1).alias("n"))
    before = Window.orderBy("_pack_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(sizes.select("_pack_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_pack_start")), "file-starts")
    return places.join(starts, "_pack_file").select(*docs.columns, (F.col("_pack_start") + F.col("_pack_at")).alias("_pack_row"))


def tokenized(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows numbered, with doc_id, the number of its ids (the end id included) and the ids, two bytes each where that suffices.

    Rows keep the number in ``_pack_row`` where they have one.
    """
    ordered = "_pack_row" in docs.columns

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        width, at = coder.width, TaskContext.get().partitionId() << 33
        # some rows at a time: no copy of a whole batch of long texts
        for batch in (whole.slice(i, ROWS_AT_ONCE) for whole in batches for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
            for ids, first, rows in coder.documents(batch.column("text")):
                raw = ids.astype(f"<u{width}")
                held = pa.BinaryArray.from_buffers(
                    pa.binary(), len(first) - 1, [None, pa.py_buffer((first * width).astype(np.int32)), pa.py_buffer(raw)]
                )
                size = rows.stop - rows.start
                row = batch.column("_pack_row").slice(rows.start, size) if ordered else pa.array(np.arange(at, at + size))
                yield pa.RecordBatch.from_arrays(
                    [row, batch.column("doc_id").slice(rows.start, size), pa.array(np.diff(first)), held],
                    names=["row", "doc_id", "doc_tokens", "token_ids"],
                )
                at += size

    own = ["_pack_row"] if ordered else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own).mapInArrow(coded, _TOKENIZED)


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum comes closest to ``room`` from below."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most = min(counts[length], room // length)
        if not most:
            continue
        steps.append((length, reach, most))
        left, k = most, 1
        while left:
            k = min(k, left)
            reach |= (reach << (k * length)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, before, most in reversed(steps):
        k = next(k for k in range(most + 1) if at >= k * length and before >> (at - k * length) & 1)
        if k:
            used[length] = k
            at -= k * length
    return used


def patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[list[tuple[int, int]], int, tuple[int, int] | None]]:
    """Lengths with their multiplicity, how often the sequence is made, and (length, part) of an item cut to fill it."""
    counts = {length: n for length, n in counts.items() if n}
    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        used = closest(rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        gap = capacity - sum(length * k for length, k in used.items())
        cut = None
        if gap:
            spare = [x for x, n in counts.items() if n > used.get(x, 0) and x > gap]
            cut = (max(spare), gap) if spare else None
        need = used | ({cut[0]: used.get(cut[0], 0) + 1} if cut else {})
        repeats = min(counts[length] // k for length, k in need.items())
        for length, k in need.items():
            counts[length] -= k * repeats
        if cut:
            counts[cut[0] - gap] = counts.get(cut[0] - gap, 0) + repeats
        counts = {length: n for length, n in counts.items() if n}
        yield sorted(used.items(), reverse=True), repeats, cut


def plan(counts: dict[int, int], capacity: int, first_sequence: int) -> dict[int, list[tuple[int, int, int, int, int, int]]]:
    """By item length: (first rank, ranks, start in the item, length, first sequence, offset).

    Consecutive ranks of a row lie in consecutive sequences.
    """
    queues = {length: deque([(length, 0, n, 0)]) for length, n in counts.items()}
    made: dict[int, list[tuple[int, int, int, int, int, int]]] = {length: [] for length in counts}

    def taken(length: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        while n:
            origin, rank, have, start = queues[length].popleft()
            if have > n:
                queues[length].appendleft((origin, rank + n, have - n, start))
            yield origin, rank, min(have, n), start
            n -= min(have, n)

    sequence = first_sequence
    for used, repeats, cut in patterns(counts, capacity):
        offset = 0
        for length, k in [*((x, 1) for x, k in used for _ in range(k)), *([(cut, 1)] if cut else [])]:
            of, size = length if isinstance(length, tuple) else (length, length)
            at = sequence
            for origin, rank, n, start in taken(of, repeats * k):
                made[origin].append((rank, n, start, size, at, offset))
                at += n
                if size < of:
                    queues.setdefault(of - size, deque()).append((origin, rank, n, start + size))
            offset += size
        sequence += repeats
    return made


def _tables(made: dict[int, list[tuple[int, int, int, int, int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: bounds of rank intervals, and the rows that hold for each interval."""
    found = {}
    for length, rows in made.items():
        table = np.array(rows, np.int64).reshape(-1, 6)
        bounds = np.unique(np.concatenate([table[:, 0], table[:, 0] + table[:, 1]]))
        low, high = np.searchsorted(bounds, table[:, 0]), np.searchsorted(bounds, table[:, 0] + table[:, 1])
        interval = take_ranges(low, high - low)
        row = np.repeat(np.arange(len(table)), high - low)
        order = np.lexsort((table[row, 2], interval))
        first = np.searchsorted(interval[order], np.arange(len(bounds) + 1))
        found[length] = (bounds, first, row[order], table)
    return found


def placements(lengths: DataFrame, capacity: int = CAPACITY, in_order: bool = False) -> DataFrame:
    """Where every piece lies: row, start, length, sequence_id, offset. ``lengths``: row, doc_tokens (stored)."""
    full = lengths.selectExpr("row", f"doc_tokens div {capacity} as pieces", "0 as one").where("pieces > 0")
    whole = running(full, "one", "row", "pieces", in_order=in_order).join(full.drop("one"), "row")
    whole = whole.selectExpr("row", "rank", "explode(sequence(0L, pieces - 1)) as k").selectExpr(
        "row", f"k * {capacity} as start", f"{capacity}L as length", "rank + k as sequence_id", "0L as offset"
    )
    items = lengths.selectExpr("row", "doc_tokens", f"doc_tokens % {capacity} as length").where("length > 0")
    histogram = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    sequences = full.agg(F.coalesce(F.sum("pieces"), F.lit(0))).first()[0]
    table = lengths.sparkSession.sparkContext.broadcast(_tables(plan(histogram, capacity, sequences)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens, length, rank = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "doc_tokens", "length", "rank")
            )
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                bounds, first, row, made = table.value[int(size)]
                interval = np.searchsorted(bounds, rank[mine], "right") - 1
                many = first[interval + 1] - first[interval]
                found = made[row[take_ranges(first[interval], many)]]
                item = np.repeat(mine, many)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[item]), pa.array(tokens[item] - size + found[:, 2]), pa.array(found[:, 3]),
                        pa.array(found[:, 4] + rank[item] - found[:, 0]), pa.array(found[:, 5]),
                    ],
                    names=["row", "start", "length", "sequence_id", "offset"],
                )

    ranked = running(items, "length", "row", in_order=in_order).join(items.select("row", "doc_tokens"), "row")
    return whole.unionByName(ranked.select("row", "doc_tokens", "length", "rank").mapInArrow(placed, _PLACES))


def pieces(tokens: DataFrame, places: DataFrame) -> DataFrame:
    """Every placed piece with its ids. A document's pieces come to it as one list, no longer than the text."""
    listed = places.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("places")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, total = batch.column("places"), batch.column("doc_tokens").to_numpy(zero_copy_only=False)
            many, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            start, length, sequence, offset = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            doc = np.repeat(np.arange(len(many)), many)
            held = batch.column("token_ids")
            bounds = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
            size = int(bounds[-1] - bounds[0]) // max(1, int(total.sum()))
            ids = np.frombuffer(held.buffers()[2], f"<u{size or 2}", (bounds[-1] - bounds[0]) // (size or 2), bounds[0])
            first = np.concatenate(([0], np.cumsum(total)))
            at = np.concatenate(([0], np.cumsum(length)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(sequence),
                    pa.array(offset), pa.array(total[doc]),
                    pa.ListArray.from_arrays(
                        pa.array(at, pa.int32()), pa.array(ids[take_ranges(first[doc] + start, length)].astype(np.int32))
                    ),
                ],
                names=["doc_id", "start", "length", "sequence_id", "offset", "doc_tokens", "ids"],
            )

    return tokens.join(listed, "row").select("doc_id", "doc_tokens", "token_ids", "places").mapInArrow(cut, _PIECES)


def renumbered(places: DataFrame) -> DataFrame:
    """Places with their sequences numbered by the row, and the start in it, of the first piece."""
    first = places.where("offset = 0").select(F.lit(0).alias("one"), F.struct("row", "start", "sequence_id").alias("at"))
    numbers = running(first, "one", "at", in_order=True).select(F.col("at.sequence_id").alias("sequence_id"), "rank")
    return places.join(numbers, "sequence_id").select("row", "start", "length", F.col("rank").alias("sequence_id"), "offset")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, in_order: bool = False) -> DataFrame:
    """Documents packed into sequences: one row per piece, with its ids. ``in_order``: ``docs`` is a stored table, packed in its order."""
    tokens = stored(tokenized(numbered(docs) if in_order else docs, vocabulary), "tokenized")
    places = stored(placements(tokens.select("row", "doc_tokens"), capacity, in_order), "places")
    return pieces(tokens, stored(renumbered(places), "places-in-order") if in_order else places)
