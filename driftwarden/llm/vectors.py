"""Embedding near-dedup: a join of near vectors by boxes, with little on disk.

1. *Classes.* Equal vectors of a label are one class; a vector is kept as the bytes of its components.
2. *Plan.* A label of at most ``CHUNK`` vectors (of 64 dimensions, fewer if they are longer) meets in one task. A larger one is cut into boxes of about so many,
   for each of the starts that a linked pair can have (``boxes``). Some of its vectors, one in ``CHUNK / SEEN``, tell where to cut and how much each box
   will hold; the result does not depend on them. A box that no cut makes smaller is cut into chunks, which meet pairwise in different tasks.
3. *Passes.* The boxes are taken so many at a time that a pass writes about ``PASS_SHARE`` copies of all vectors; its shuffle files go before the next pass.
4. *Links.* Within a task the boxes are cut on, down to ``CELL_TARGET`` vectors, which are compared by the first block of the start. What is close there is verified by the cosine in
   double precision on the values as given, so no link is missed and none is wrong. A link is counted at its one start, in its one box, so a vector's
   links are summed without writing a pair; tasks hand on a spanning forest of what they connect.

Defined results: a vector that is null or zero, holds a null or a component that is not finite, or has no label links with
nothing. Vectors of different lengths do not link. Equal vectors link, also under one vec_id; rows that
share a vec_id get one answer each, rows without one are left out. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from driftwarden.llm.boxes import SEEN, WORTH, Group, Start, start_of, turned
from driftwarden.llm.components import components
from driftwarden.llm.hashing import mix
from driftwarden.llm.jaccard import whole_groups
from driftwarden.scratch import configured, folders_made, fresh_folder, remove_folders

CHUNK, CELL_TARGET = 200_000, 2048
#: Copies of all vectors that a pass writes, and vectors that one pass takes in any case.
PASS_SHARE, PASS_LEAST = 2.0, 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PACKED = "vec_id long, label_key long, vector binary"
_DEALT = "label_key long, part int, side int, below long, class_id long, copies long, vector binary"
_FOUND = "a long, b long, n long"


def _stored(frame: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``frame`` written to the shared folder and read back, and its path; the shuffle files that made it are gone."""
    path = fresh_folder(frame.sparkSession, label)
    with configured(frame.sparkSession, _CLEANUP, "true"):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label_key, vector of the vectors that can link: label_key stands for label and length, vector holds the components."""
    kind = "float" if rows.select("embedding").schema[0].dataType.elementType == FloatType() else "double"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("embedding")
            at = lists.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            # zero has one sign, a null is not finite
            values = lists.flatten().to_numpy(zero_copy_only=False) + np.zeros((), f"<f{4 if kind == 'float' else 8}")
            with np.errstate(over="ignore", invalid="ignore"):
                length = np.add.reduceat(np.square(values, dtype=np.float64), at[:-1])
            bytes_at = (at * values.itemsize).astype(np.int32)
            vectors = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bytes_at), pa.py_buffer(values)])
            made = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label_key"), vectors], names=["vec_id", "label_key", "vector"])
            yield made.filter(pa.array((length > 0) & (length < np.inf)))

    typed = rows.where("vec_id is not null and label is not null and size(embedding) > 0").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("label", F.size("embedding")).alias("label_key"),
        F.col("embedding").cast(f"array<{kind}>").alias("embedding"),
    )
    return typed.mapInArrow(packed, _PACKED)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length, as rows."""
    vectors = vectors.cast(pa.large_binary())
    at = np.frombuffer(vectors.buffers()[1], np.int64)[vectors.offset : vectors.offset + len(vectors) + 1]
    return np.frombuffer(vectors.buffers()[2], np.uint8)[at[0] : at[-1]].view(f"<f{width}").reshape(len(vectors), -1)


@dataclass
class Box:
    """A box of a label at one start: its lower sides, about how many vectors it holds, and into how many chunks it is cut."""

    label_key: int
    start: int
    low: np.ndarray
    rows: float
    chunks: int


@dataclass(frozen=True)
class Part:
    """Two chunks of a box that meet in one task, or one with itself."""

    box: int
    low: int
    high: int


class Plan:
    """Boxes of the large labels, and the passes that take them."""

    def __init__(self, cosine: float, width: int) -> None:
        self.cosine, self.width = cosine, width
        self.boxes: list[Box] = []
        self.parts: list[Part] = []
        #: By label: the cuts of every start as (coordinate, value, below, above), or the box.
        self.trees: dict[int, list[tuple]] = {}

    def add(self, label_key: int, seen: np.ndarray, weight: float, most: int) -> None:
        """Cut a label, of which ``seen`` are some vectors that stand for ``weight`` each, into boxes of ``most`` vectors."""
        size = seen.shape[1]
        own = turned(seen)

        def made(start: Start, at: np.ndarray, rows: np.ndarray, spent: np.ndarray, low: np.ndarray):
            n = max(1, len(rows)) * weight
            if n > most and len(rows) > 1:
                k, value, left = start.cut(at[rows], low)
                if left < WORTH:
                    lower, upper = start.sides(at, rows, spent, low, k, value)
                    raised = low.copy()
                    raised[k] = value
                    return k, value, made(start, at, *lower, low), made(start, at, *upper, raised)
            self.boxes.append(Box(label_key, start.number, low, n, -(-2 * int(n) // most) if n > most else 1))
            return len(self.boxes) - 1

        trees = []
        for number in range(start_of(self.cosine, size, 0).blocks):
            start = start_of(self.cosine, size, number)
            at = start.of(own)
            trees.append(made(start, at, np.arange(len(at)), start.spent(at, start.open), start.open))
        self.trees[label_key] = trees

    def passes(self, small: float, most: float) -> list[dict[int, list[int]]]:
        """The parts of each box that a pass takes; the first also takes the ``small`` vectors of other labels."""
        taken: list[dict[int, list[int]]] = [{}]
        full = small
        for number, box in enumerate(self.boxes):
            for low, high in itertools.combinations_with_replacement(range(box.chunks), 2):
                n = box.rows / box.chunks * (1 + (low < high))
                if full and full + n > most:
                    taken.append({})
                    full = 0
                full += n
                taken[-1].setdefault(number, []).append(len(self.parts))
                self.parts.append(Part(number, low, high))
        return taken

    def pruned(self, tree, wanted: dict[int, list[int]]):
        """A tree without the cuts that lead to no wanted box."""
        if not isinstance(tree, tuple):
            return tree if tree in wanted else None
        below, above = self.pruned(tree[2], wanted), self.pruned(tree[3], wanted)
        return None if below is None and above is None else (*tree[:2], below, above)


def _leaves(start: Start, at: np.ndarray, tree) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The boxes that are left of a tree, their rows and their lower sides."""
    todo = [(tree, np.arange(len(at)), start.spent(at, start.open), start.open)]
    while todo:
        tree, rows, spent, low = todo.pop()
        if tree is None or not len(rows):
            continue
        if not isinstance(tree, tuple):
            yield tree, rows, low
            continue
        k, value, below, above = tree
        lower, upper = start.sides(at, rows, spent, low, k, value)
        raised = low.copy()
        raised[k] = value
        todo += [(below, *lower, low), (above, *upper, raised)]


def _dealt(plan: Plan, wanted: dict[int, list[int]], first: bool) -> Callable:
    """Each vector in the parts of a pass that it belongs to or visits; the labels without boxes in the first pass."""
    large, cosine, width = np.array(sorted(plan.trees), np.int64), plan.cosine, plan.width
    trees = {key: [(n, t) for n, t in enumerate(plan.pruned(x, wanted) for x in made) if t is not None] for key, made in plan.trees.items()}
    parts = {box: (plan.boxes[box].chunks, [(k, plan.parts[k].low, plan.parts[k].high) for k in mine]) for box, mine in wanted.items()}

    def of_label(rows: np.ndarray, classes: np.ndarray, made: list[tuple]) -> Iterator[tuple[np.ndarray, ...]]:
        own = turned(rows)
        for number, tree in made:
            start = start_of(cosine, rows.shape[1], number)
            at = start.of(own)
            for box, here, low in _leaves(start, at, tree):
                below = start.below(at[here], low)
                chunks, mine = parts[box]
                side = (mix(classes[here].astype(np.uint64)) % np.uint64(chunks)).astype(np.int32)
                for part, low_side, high_side in mine:
                    among = (side == low_side) | (side == high_side)
                    yield here[among], np.full(np.count_nonzero(among), part, np.int32), side[among], below[among]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("label_key").to_numpy(zero_copy_only=False)
            classes = batch.column("class_id").to_numpy(zero_copy_only=False)
            boxed = np.isin(keys, large)
            some = np.flatnonzero(~boxed) if first else np.zeros(0, np.int64)
            found = [(some, np.full(len(some), -1, np.int32), np.zeros(len(some), np.int32), np.zeros(len(some), np.int64))]
            for key in np.unique(keys[boxed]).tolist():
                if trees[key]:
                    rows = np.flatnonzero(keys == key)
                    of = of_label(_matrix(batch.column("vector").take(pa.array(rows)), width), classes[rows], trees[key])
                    found += [(rows[here], *rest) for here, *rest in of]
            rows, part, side, below = (np.concatenate(x) for x in zip(*found, strict=True))
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label_key").take(rows), pa.array(part), pa.array(side), pa.array(below),
                    *(batch.column(c).take(rows) for c in ("class_id", "copies", "vector")),
                ],
                names=["label_key", "part", "side", "below", "class_id", "copies", "vector"],
            )

    return dealt


def _linked(plan: Plan, wanted: dict[int, list[int]], most: int) -> Callable:
    """Links of the vectors that meet: counts, and a forest of what they connect."""
    cosine, width = plan.cosine, plan.width
    boxes = {k: (plan.boxes[box].start, plan.boxes[box].low, plan.parts[k].low < plan.parts[k].high) for box, mine in wanted.items() for k in mine}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in whole_groups(batches, ["label_key", "part"]):
            part, side, below, ids, copies = (table.column(c).to_numpy() for c in ("part", "side", "below", "class_id", "copies"))
            out: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if j - i < 2:
                    continue
                vectors = table.column("vector").slice(i, j - i).combine_chunks()
                vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
                group = Group(_matrix(vectors, width), ids[i:j], copies[i:j], cosine)
                if part[i] >= 0:
                    number, low, pairwise = boxes[part[i]]
                    group.below, group.side = below[i:j], side[i:j] if pairwise else None
                    group.pairs_of(start_of(cosine, group.size, number), low, most)
                elif j - i <= 2 * most:
                    group.all_pairs()
                else:
                    for number in range(len(group.parts)):
                        start = start_of(cosine, group.size, number)
                        group.pairs_of(start, start.open, most)
                counts, root = group.found()
                some, moved = np.flatnonzero(counts), np.flatnonzero(root != np.arange(j - i))
                out.append(np.stack([ids[i:j][some], ids[i:j][some], counts[some]], 1))
                out.append(np.stack([ids[i:j][moved], ids[i:j][root[moved]], np.zeros(len(moved), np.int64)], 1))
            made = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(made[:, k]) for k in range(3)], names=["a", "b", "n"])

    return found


def planned(classes: DataFrame, cosine: float, width: int) -> tuple[Plan, list[dict[int, list[int]]]]:
    """Boxes and passes for the labels that are too large for one task."""
    most, weight = f"greatest(2, {CHUNK * 64 * width} div octet_length(vector))", f"greatest(1, {CHUNK * 64 * width} div octet_length(vector) div {SEEN})"
    sizes = classes.groupBy("label_key").agg(
        F.count("*").alias("n"), F.first(F.expr(most)).alias("most"), F.first(F.expr(f"octet_length(vector) div {width}")).alias("size")
    )
    sizes = _stored(sizes, "vector-labels")[0]
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large, plan = {r["label_key"]: r for r in sizes.where("n > most").collect()}, Plan(cosine, width)
    if large:
        some = classes.where(F.col("label_key").isin([*large]) & F.expr(f"pmod(xxhash64(vector), {weight}) = 0"))
        seen: dict[int, list[bytes]] = {key: [] for key in large}
        for r in some.select("label_key", "vector").collect():
            seen[r["label_key"]].append(bytes(r["vector"]))
        for key, vectors in sorted(seen.items()):
            rows = np.frombuffer(b"".join(vectors), f"<f{width}").reshape(-1, large[key]["size"])
            plan.add(key, rows, large[key]["n"] / max(1, len(rows)), large[key]["most"])
    small = total - sum(r["n"] for r in large.values())
    return plan, plan.passes(small, max(PASS_LEAST, PASS_SHARE * total))


def near_vectors(rows: DataFrame, cosine: float = 0.98) -> DataFrame:
    """Every vector: vec_id, n_links, component_id, kept."""
    since = folders_made()
    width = 4 if rows.select("embedding").schema[0].dataType.elementType == FloatType() else 8
    classes = _stored(usable(rows).groupBy("label_key", "vector").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies")), "vector-classes")[0]
    copied = classes.where("copies > 1")
    copies, copies_path = _stored(usable(rows).join(copied, ["label_key", "vector"]).select("vec_id", "class_id", "copies"), "vector-copies")
    plan, passes = planned(classes, cosine, width)
    found = []
    for number, wanted in enumerate(passes):
        among = F.col("label_key").isin([*{plan.boxes[box].label_key for box in wanted}])
        among = among | ~F.col("label_key").isin([*plan.trees]) if number == 0 else among
        dealt = classes.where(among).mapInArrow(_dealt(plan, wanted, number == 0), _DEALT)
        met = dealt.repartition("label_key", "part").sortWithinPartitions("label_key", "part").mapInArrow(_linked(plan, wanted, CELL_TARGET), _FOUND)
        found.append(_stored(met, "vector-links")[0])
    links = reduce(DataFrame.unionByName, found)
    counts = links.where("n > 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    joined = components(links.where("n = 0").select("a", "b")).withColumnRenamed("node", "class_id")
    linked = counts.join(joined, "class_id", "left").select("class_id", "others", F.coalesce("component", "class_id").alias("component"))
    of_class, class_path = _stored(linked, "class-links")
    remove_folders(rows.sparkSession, since, keep=(copies_path, class_path))
    alone = of_class.select(F.col("class_id").alias("vec_id"), F.col("others").alias("n_links"), F.col("component").alias("component_id"))
    together = copies.join(of_class, "class_id", "left").select(
        "vec_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id")
    )
    of_vector = alone.unionByName(together).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id")).join(of_vector, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
