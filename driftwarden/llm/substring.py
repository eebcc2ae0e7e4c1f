"""Substring dedup with a count-min prefilter.

A window is 13 consecutive words. A word goes if a window covers it whose word sequence also starts in a document of smaller id.

1. *Sketch.* Slices of the corpus (about two megabytes of text) hash their windows to the cells of one sketch row, with eight
   cells a window. The sketch is cut into ranges of cells; every slice sends its cells to the ranges, three bytes a window, and
   a range adds up what the slices sent. A cell hit at least twice overestimates its windows' counts, so no repeated window is
   lost. The answer is one bit a window. What a slice sees twice itself it reports once and need not ask, so a
   passage that stands in a third of all documents costs one cell a slice.
2. *Exact pass.* Windows estimated repeated are grouped by a 96-bit hash of their words; again a slice asks once for each
   distinct window, and the answer tells whether a smaller document has it. The 96 bits come from two hashes of independent bases.
3. *Removal.* Rows take their bits back by id and hash of the text, and drop the covered words.

The sketch grows with the corpus, eight cells a window however large that is, and is never in one place: not on the driver, not in a
broadcast. Ranges are asked in parts. With more parts slices get larger, up to 64 megabytes, so that a slice has some dozens of windows for
each part and rows stay in proportion to windows; beyond ``PART_BITS`` a part gathers several ranges.

Defined results: a null text has no words; a text of fewer than 13 words has no window. A window that repeats inside one document
only removes nothing. Rows that share a doc_id count as one document, each with its own text; rows without one are left out. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.hashing import Words, slices, take_ranges, windows
from driftwarden.llm.tables import stored

WINDOW = 13
#: Cells of a range (bits), cells for each window, bytes of text taken for a window, and the least number of ranges.
CELL_BITS, CELLS_A_WINDOW, BYTES_A_WINDOW, FEWEST_RANGES = 24, 8, 6, 32
#: Bounds of the parts that a slice asks (bits) and of a slice (bytes), and the windows that a slice should have for a part.
PART_BITS, LEAST_SLICE, MOST_SLICE, WINDOWS_A_PART = 18, 1 << 21, 1 << 26, 32
_ASKED = "slice long, part int, docs binary, counts binary, asked binary, told binary"
_ANSWERED = "slice long, part int, docs binary, counts binary, bits binary"
_BITS = "doc_id long, mark long, n long, bits binary"
KEPT = "doc_id long, n_words long, n_removed long, kept string"
_KEY = np.dtype([("high", "<u8"), ("low", "<u4")])
_DOC = np.dtype([("at", "<i4"), ("id", "<i8")])
#: A row: rows that share an id and a text have the same windows, and so the same bits.
_ROW = np.dtype([("id", "<i8"), ("mark", "<i8")])


@dataclass(frozen=True)
class Sketch:
    """Bits of the number of ranges, of the parts that are asked for them, and of the cells of a range; bytes of a slice."""

    bits: int
    part_bits: int
    cell_bits: int
    slice_bytes: int

    @staticmethod
    def of(total_bytes: int) -> Sketch:
        """The sketch of a corpus of ``total_bytes``."""
        cells = total_bytes // BYTES_A_WINDOW * CELLS_A_WINDOW
        bits = (max(FEWEST_RANGES, -(-cells >> CELL_BITS)) - 1).bit_length()
        part_bits = min(bits, PART_BITS)
        wanted = (WINDOWS_A_PART << part_bits) * BYTES_A_WINDOW
        return Sketch(bits, part_bits, CELL_BITS, min(max(LEAST_SLICE, wanted), MOST_SLICE))

    @property
    def parts(self) -> int:
        return 1 << self.part_bits

    @property
    def address_bits(self) -> int:
        """Bits of a cell's address within its part."""
        return self.bits + self.cell_bits - self.part_bits

    @property
    def width(self) -> int:
        return -(-self.address_bits // 8)

    def part(self, hashed: np.ndarray) -> np.ndarray:
        return (hashed >> np.uint64(64 - self.part_bits)).astype(np.int64) if self.part_bits else np.zeros(len(hashed), np.int64)

    def spot(self, hashed: np.ndarray) -> np.ndarray:
        """Cells of the whole sketch."""
        return hashed >> np.uint64(64 - self.bits - self.cell_bits)

    def packed(self, spots: np.ndarray) -> np.ndarray:
        """Addresses within the parts, ``width`` bytes each."""
        address = spots & np.uint64((1 << self.address_bits) - 1)
        return address.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width].copy()

    def unpacked(self, raw: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(raw) // self.width, 8), np.uint8)
        wide[:, : self.width] = raw.reshape(-1, self.width)
        return wide.view("<u8").ravel()


def _pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _by_part(part: np.ndarray, doc: np.ndarray, parts: int) -> np.ndarray:
    """Order of the windows by (document, part)."""
    return np.argsort(doc * parts + part, kind="stable")


def _rows(
    number: int, own: np.ndarray, doc: np.ndarray, part: np.ndarray, known: np.ndarray, ask: np.ndarray,
    asked: np.ndarray, told_part: np.ndarray, told: np.ndarray, parts: int,
) -> dict[str, list]:
    """A slice's questions: one row a part, and one row that goes along unanswered with what the slice knows itself.

    ``own`` are the slice's documents, ids or rows of ``_ROW``.

    Windows come in (document, place) order with their ``part``; ``known`` are the bits known, ``ask`` the windows
    asked for, each by its row of ``asked``; ``told`` are reports that need no answer.
    """
    docs, ids = len(own), own["id"] if own.dtype.names else own
    out: dict[str, list] = {k: [] for k in ("slice", "part", "docs", "counts", "asked", "told")}
    order = _by_part(part, doc, parts)
    per_doc = np.bincount(doc, minlength=docs).astype("<i4")
    state = np.where(ask, 2, known)[order].astype(np.uint8)  # two bits a window: known bit, or to be answered
    both = np.stack([state >> 1, state & 1], 1)
    _add(out, number, -1 - ((number >> 32) * 31 + number) % parts, own.tobytes(), per_doc.tobytes(), _pack(both.ravel()), b"")
    at = np.flatnonzero(ask)
    at = at[np.argsort(part[at], kind="stable")]
    cut = np.searchsorted(part[at], np.arange(parts + 1))
    told_cut = np.searchsorted(told_part, np.arange(parts + 1))
    for p in np.flatnonzero((np.diff(cut) > 0) | (np.diff(told_cut) > 0)):
        mine = at[cut[p] : cut[p + 1]]
        some, counts = np.unique(doc[mine], return_counts=True)
        _add(
            out, number, int(p), _named(some, ids).tobytes(), counts.astype("<i4").tobytes(),
            asked[mine].tobytes(), told[told_cut[p] : told_cut[p + 1]].tobytes(),
        )
    return out


def _named(own: np.ndarray, ids: np.ndarray) -> np.ndarray:
    made = np.zeros(len(own), _DOC)
    made["at"], made["id"] = own, ids[own]
    return made


def slice_numbers() -> Iterator[int]:
    """Numbers for the slices of a task that no other task gives."""
    return itertools.count(TaskContext.get().partitionId() << 32)


def _add(out: dict[str, list], *values) -> None:
    for column, value in zip(out.values(), values, strict=True):
        column.append(value)


def _batch(out: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(out[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _hashed(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window, its document, and where the documents' windows begin."""
    hashed, first = windows(words.hashes(), words.first, WINDOW)
    return hashed, np.repeat(np.arange(len(first) - 1), np.diff(first)), first


def _numbers(batch: pa.RecordBatch, words: Words) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)[words.rows]


def _marked(batch: pa.RecordBatch, words: Words) -> np.ndarray:
    ids = _numbers(batch, words)
    made = np.zeros(len(ids), _ROW)
    made["id"], made["mark"] = ids, batch.column("mark").to_numpy(zero_copy_only=False)[words.rows]
    return made


def ask_cells(number: int, own: np.ndarray, hashed: np.ndarray, doc: np.ndarray, sketch: Sketch) -> pa.RecordBatch:
    """A slice's questions to the sketch: was the cell of each hash (in document order) hit at least twice?"""
    spots = sketch.spot(hashed)
    spot, index, times = np.unique(spots, return_inverse=True, return_counts=True)
    again, twice = times[index] > 1, spot[times > 1]
    told_part = (twice >> np.uint64(sketch.address_bits)).astype(np.int64)
    return _batch(
        _rows(number, own, doc, sketch.part(hashed), again, ~again, sketch.packed(spots), told_part, sketch.packed(twice), sketch.parts), _ASKED
    )


def _sketch(sketch: Sketch):
    """Ask the ranges of the sketch about every window."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = slice_numbers()
        for batch in batches:
            for words in slices(batch.column("text"), limit=sketch.slice_bytes):
                hashed, doc, _ = _hashed(words)
                if len(hashed):
                    yield ask_cells(next(numbers), _marked(batch, words), hashed, doc, sketch)

    return ask


def count_cells(sketch: Sketch):
    """One part of the merged sketch: which of the cells asked for were hit at least twice."""

    def answered(asked: list[np.ndarray], told: list[np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
        cells = [sketch.unpacked(x) for x in asked]
        every = np.concatenate([*cells, *(np.repeat(sketch.unpacked(x), 2) for x in told)])
        spot, times = np.unique(every, return_counts=True)
        mine = np.concatenate(cells)
        return times[np.searchsorted(spot, mine)] > 1 if len(mine) else np.zeros(0, bool)

    def count(group: pa.Table) -> pa.Table:
        return _answer(group, sketch.width, answered)

    return count


def _smaller_elsewhere(group: pa.Table) -> pa.Table:
    """One part of the windows estimated repeated: which of those asked for also start in a smaller document."""

    def answered(asked: list[np.ndarray], told: list[np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
        keys = np.concatenate(asked).view(_KEY) if asked else np.zeros(0, _KEY)
        owner = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        order = np.lexsort((owner, keys["low"], keys["high"]))
        sorted_keys, sorted_owner = keys[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        least = sorted_owner[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else owner
        bits = np.zeros(len(order), bool)
        bits[order] = least < sorted_owner
        return bits

    return _answer(group, _KEY.itemsize, answered)


def _answer(group: pa.Table, width: int, answered) -> pa.Table:
    """Answer the rows of one part; rows of negative part go through, their bits unchanged."""
    rows = group.select(["slice", "part", "docs", "counts", "asked", "told"]).to_pylist()
    ask = [r for r in rows if r["part"] >= 0]
    raw = [np.frombuffer(r["asked"], np.uint8) for r in ask]
    owners = [np.repeat(np.frombuffer(r["docs"], _DOC)["id"], np.frombuffer(r["counts"], "<i4")) for r in ask]
    bits = answered(raw, [np.frombuffer(r["told"], np.uint8) for r in ask], owners) if ask else np.zeros(0, bool)
    at = np.concatenate(([0], np.cumsum([len(x) // width for x in raw]))).astype(int)
    out: dict[str, list] = {k: [] for k in ("slice", "part", "docs", "counts", "bits")}
    for i, r in enumerate(ask):
        if r["asked"]:
            _add(out, r["slice"], r["part"], r["docs"], r["counts"], _pack(bits[at[i] : at[i + 1]]))
    for r in rows:
        if r["part"] < 0:
            _add(out, r["slice"], r["part"], r["docs"], r["counts"], r["asked"])
    return pa.Table.from_batches([_batch(out, _ANSWERED)])


def _slice_bits(group: pa.Table, kind: np.dtype | str = "<i8") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: its documents, how many windows each has, and their bits by document in the order of (part, place)."""
    rows = sorted(group.to_pylist(), key=lambda r: r["part"])
    own, answers = rows[0], rows[1:]
    ids, n = np.frombuffer(own["docs"], kind), np.frombuffer(own["counts"], "<i4")
    both = _unpack(own["bits"], 2 * int(n.sum())).reshape(-1, 2)
    bits, open_bits = both[:, 1].copy(), np.flatnonzero(both[:, 0])
    docs, got = [], []
    for r in answers:
        counts = np.frombuffer(r["counts"], "<i4")
        docs.append(np.repeat(np.frombuffer(r["docs"], _DOC)["at"], counts))
        got.append(_unpack(r["bits"], int(counts.sum())))
    if docs:
        order = np.argsort(np.concatenate(docs), kind="stable")
        bits[open_bits] = np.concatenate(got)[order]
    return ids, n, bits


def _assemble(group: pa.Table) -> pa.Table:
    """The bits of each document of a slice that has any set."""
    ids, n, bits = _slice_bits(group, _ROW)
    at = np.concatenate(([0], np.cumsum(n)))
    out: dict[str, list] = {k: [] for k in ("doc_id", "mark", "n", "bits")}
    for i in np.flatnonzero(bits_set(bits, at)):
        _add(out, int(ids["id"][i]), int(ids["mark"][i]), int(n[i]), _pack(bits[at[i] : at[i + 1]]))
    return pa.Table.from_batches([_batch(out, _BITS)])


def bits_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits each stretch has set."""
    total = np.concatenate(([0], np.cumsum(bits)))
    return total[at[1:]] - total[at[:-1]]


def _in_place(raw: pa.Array, part: np.ndarray, doc: np.ndarray, first: np.ndarray, parts: int) -> np.ndarray:
    """Bits of a slice's windows in (document, place) order, from each document's in (part, place) order."""
    order = _by_part(part, doc, parts)
    bits = np.zeros(len(part), bool)
    for i, packed in enumerate(raw.to_pylist()):
        if packed is not None:
            bits[first[i] : first[i + 1]] = _unpack(packed, first[i + 1] - first[i])
    made = np.zeros(len(part), bool)
    made[order] = bits
    return made


def _exactly(sketch: Sketch):
    """Ask about the windows estimated repeated."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = slice_numbers()
        for batch in batches:
            for words in slices(batch.column("text"), limit=sketch.slice_bytes):
                hashed, doc, first = _hashed(words)
                own = _marked(batch, words)
                ids = own["id"]
                part = sketch.part(hashed)
                raw = batch.column("bits").slice(words.rows.start, len(ids))
                at = np.flatnonzero(_in_place(raw, part, doc, first, sketch.parts))
                if not len(at):
                    continue
                second, _ = windows(words.hashes(2), words.first, WINDOW)
                keys = np.zeros(len(at), _KEY)
                keys["high"], keys["low"] = hashed[at], (second[at] >> np.uint64(32)).astype(np.uint32)
                # the first place of a window in the smallest document of the slice asks; later documents know already
                order = np.lexsort((at, ids[doc[at]], keys["low"], keys["high"]))
                new = np.ones(len(at), bool)
                new[1:] = keys[order][1:] != keys[order][:-1]
                lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                known, wants = np.zeros(len(hashed), bool), np.zeros(len(hashed), bool)
                known[at[order]] = ids[doc[at[lead]]] < ids[doc[at[order]]]
                wants[at[order]] = ids[doc[at[lead]]] == ids[doc[at[order]]]
                asked = np.zeros(len(hashed), _KEY)
                asked[at] = keys
                none = np.zeros(0, np.int64)
                yield _batch(_rows(next(numbers), own, doc, part, known, wants, asked, none, none, sketch.parts), _ASKED)

    return ask


def _removed(words: Words, gone: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words that a removed window covers."""
    begin = words.first[:-1][np.repeat(np.arange(len(first) - 1), np.diff(first))] + (
        np.arange(len(gone)) - np.repeat(first[:-1], np.diff(first))
    )
    step = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(step, begin[gone], 1)
    np.add.at(step, begin[gone] + WINDOW, -1)
    return np.cumsum(step)[:-1] > 0


def _remaining(words: Words, kept: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    starts, size = words.starts[kept], (words.ends - words.starts)[kept]
    at = np.concatenate(([0], np.cumsum(size + 1)))
    out = np.full(at[-1], 32, np.uint8)
    out[take_ranges(at[:-1], size)] = words.data[take_ranges(starts, size)]
    many = np.concatenate(([0], np.cumsum(kept)))[words.first]
    return [out[at[a] : max(at[a], at[b] - 1)].tobytes() for a, b in zip(many[:-1], many[1:], strict=True)]


def _rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash that tells the texts of one id apart."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))


def removal_bits(docs: DataFrame) -> tuple[DataFrame, Sketch]:
    """doc_id, mark, n, bits: which windows go, for rows that lose any; and the sketch whose parts order them."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sketch = Sketch.of(total)
    rows = _rows_of(docs)
    cells = rows.mapInArrow(_sketch(sketch), _ASKED).groupBy("part").applyInArrow(count_cells(sketch), _ANSWERED)
    repeated = stored(cells.groupBy("slice").applyInArrow(_assemble, _BITS), "estimated-repeats")
    repeated = repeated.groupBy("doc_id", "mark").agg(F.max("bits").alias("bits"))
    asked = rows.join(repeated.hint("merge"), ["doc_id", "mark"]).select("doc_id", "text", "mark", "bits").mapInArrow(_exactly(sketch), _ASKED)
    exact = asked.groupBy("part").applyInArrow(_smaller_elsewhere, _ANSWERED)
    return stored(exact.groupBy("slice").applyInArrow(_assemble, _BITS), "repeats"), sketch


def dedup_substrings(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space; with ``digest`` their sha256 instead of them."""
    gone, sketch = removal_bits(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text"), limit=sketch.slice_bytes):
                hashed, doc, first = _hashed(words)
                part = sketch.part(hashed)
                raw = batch.column("bits").slice(words.rows.start, len(first) - 1)
                removed = _removed(words, _in_place(raw, part, doc, first, sketch.parts), first)
                lost = np.concatenate(([0], np.cumsum(removed)))[words.first]
                texts = _remaining(words, ~removed)
                if digest:
                    texts = [hashlib.sha256(t).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_numbers(batch, words)), pa.array(words.counts()), pa.array(np.diff(lost)),
                        pa.array([t if digest else t.decode() for t in texts], pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    rows = _rows_of(docs)
    per_id = gone.groupBy("doc_id", "mark").agg(F.max("bits").alias("bits"))
    whole = rows.join(per_id.hint("merge"), ["doc_id", "mark"], "left")
    return whole.select("doc_id", "text", "bits").mapInArrow(cut, KEPT)
