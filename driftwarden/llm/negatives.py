"""Hard-negative mining: for anchors and their best positives, the other-label rows that score close below.

Vectors are whole numbers, a row's score is its inner product with the anchor, and rows are ranked by score, then smaller vec_id.

1. *Tiles.* Candidates are dealt to tiles of about ``CANDIDATES`` rows by a hash of the id, anchors to tiles of about ``ANCHORS``. Each pair of
   tiles meets in one group: the candidates as rows, the anchors as one row. The pairs are the query set against all rows; no task
   holds more than one of each, however large a label is.
2. *Scores.* The product of the two matrices is Strassen's: operands are padded with zeros to even sides, cut into quarters and
   multiplied by seven products of sums, down to ``LEAF``. Sums and products are 64-bit whole numbers. Intermediate ones may wrap around, the
   result does not: components are bounded so that a hundred times a score still fits.
3. *Positives.* Tiles of one label give every anchor a heap of its best rows; heaps merge, ``FAN`` at a time, until one is left.
4. *Windows.* Tiles of all labels give every (anchor, positive) a heap of the best rows of another label within the window
   ``low * positive <= high * score <= high * positive``; these merge in the same way. No score matrix leaves its task.

Defined results: rows without vec_id, label or vector, or with a component that is null or not finite, take no part. A component beyond the
bound (131,072 at 64 dimensions, before scaling) counts as the bound. Vectors of different lengths have no score with each
other; empty ones score 0. Rows equal in id, label and vector count once; a row is no positive of an anchor of its own id. A window of a positive
below zero is empty. An anchor with fewer rows has shorter lists; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.tables import stored

ANCHORS, CANDIDATES, FAN, LEAF = 1024, 4096, 64, 32
#: The number that components are multiplied by before they are brought to whole numbers.
SCALE = 256
_HEAPS = "anchor long, positive long, part int, heap array<struct<cost:bigint,id:bigint>>"
_NONE = np.iinfo(np.int64).max


def usable(rows: DataFrame, label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector (whole numbers) and size of the rows that take part."""
    typed = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    finite = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    whole = (
        f"transform(embedding, x -> cast(floor(greatest(least({scale} * x, floor(sqrt(72057594037927936d / size(embedding)))),"
        " -floor(sqrt(72057594037927936d / size(embedding))))) as bigint))"
    )
    good = typed.where(f"vec_id is not null and label is not null and embedding is not null and {finite}")
    return good.selectExpr("vec_id", "label", f"{whole} as vector", "size(embedding) as size").distinct()


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of 64-bit whole numbers."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * h), np.int64)
    out[:i, :h] = p1 + p4 - p5 + p7
    out[:i, h:] = p3 + p5
    out[i:, :h] = p2 + p4
    out[i:, h:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def best(scores: np.ndarray, among: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every row the ``most`` highest scores among those marked, ties by place: rows and places in the order of the ranks."""
    costs = np.where(among, -scores, _NONE)
    if costs.shape[1] > most:
        among = among & (costs <= np.partition(costs, most - 1, axis=1)[:, most - 1 : most])
    row, place = np.nonzero(among)
    order = np.lexsort((place, costs[row, place], row))
    row, place = row[order], place[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < most
    return row[keep], place[keep]


def _matrix(column: pa.ChunkedArray | pa.ListArray, rows: int, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(rows, size)


class _Tile:
    """A pair of tiles: candidates in the order of their ids, anchors, and all scores."""

    def __init__(self, rows: pa.Table, tile: pa.Table, leaf: int) -> None:
        self.size, self.part = rows.column("size")[0].as_py(), rows.column("part")[0].as_py()
        ids = rows.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], rows.column("label").to_numpy()[order]
        held = tile.column("anchors").combine_chunks().flatten()
        self.anchors = held.field("anchor").to_numpy(zero_copy_only=False)
        self.own_ids, self.own_labels = (held.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        self.held = held
        left = _matrix(held.field("vector"), len(held), self.size)
        right = _matrix(rows.column("vector"), len(ids), self.size)[order]
        self.scores = strassen(left, np.ascontiguousarray(right.T), leaf)

    def heaps(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
        """Heaps of (anchor row, positive, place), each list in the order of anchors and ranks."""
        row, positive, place = (np.concatenate(x) for x in zip(*found, strict=True))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (positive[1:] != positive[:-1])
        first = np.flatnonzero(new)
        entries = pa.StructArray.from_arrays([pa.array(-self.scores[row, place]), pa.array(self.ids[place])], names=["cost", "id"])
        return pa.table({
            "anchor": pa.array(self.anchors[row[first]], pa.int64()), "positive": pa.array(positive[first], pa.int64()),
            "part": pa.array(np.full(len(first), self.part), pa.int32()),
            "heap": pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), entries),
        })


_EMPTY = pa.table({
    "anchor": pa.array([], pa.int64()), "positive": pa.array([], pa.int64()), "part": pa.array([], pa.int32()),
    "heap": pa.array([], pa.list_(pa.struct([("cost", pa.int64()), ("id", pa.int64())]))),
})


def _positives(most: int, leaf: int):
    """Of each anchor the best rows of a tile of its label."""

    def found(rows: pa.Table, tile: pa.Table) -> pa.Table:
        if not rows.num_rows or not tile.num_rows:
            return _EMPTY
        pair = _Tile(rows, tile, leaf)
        row, place = best(pair.scores, pair.own_ids[:, None] != pair.ids[None, :], most)
        return pair.heaps([(row, np.zeros(len(row), np.int64), place)])

    return found


def _negatives(most: int, low: int, high: int, leaf: int):
    """Of each anchor and positive the best rows of other labels within the window in a tile."""

    def found(rows: pa.Table, tile: pa.Table) -> pa.Table:
        if not rows.num_rows or not tile.num_rows:
            return _EMPTY
        pair = _Tile(rows, tile, leaf)
        other = pair.own_labels[:, None] != pair.labels[None, :]
        lists = pair.held.field("positives")
        many, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
        score = -flat.field("cost").to_numpy(zero_copy_only=False)
        first, made = np.cumsum(many) - many, []
        for k in range(int(many.max())):
            mine = np.flatnonzero(many > k)
            bound = score[first[mine] + k][:, None]
            close = pair.scores[mine]
            inside = other[mine] & (low * bound <= high * close) & (close <= bound)
            row, place = best(close, inside, most)
            made.append((mine[row], np.full(len(row), k, np.int64), place))
        return pair.heaps(made)

    return found


def _met(
    rows: DataFrame, anchors: DataFrame, keys: list[str], work: Callable[[pa.Table, pa.Table], pa.Table], extra: list[str], per_anchor: int, per_tile: int
) -> tuple[DataFrame, int]:
    """The heaps of all pairs of tiles that agree in ``keys``, and the most tiles of candidates there are for one anchor."""
    counted = rows.groupBy(*keys).agg(F.expr(f"cast(ceil(count(*) / {per_tile}) as int)").alias("parts"))
    grouped = anchors.groupBy(*keys).agg(F.expr(f"cast(ceil(count(*) / {per_anchor}) as int)").alias("groups"))
    sizes = stored(counted.join(grouped, keys), "tile-sizes")
    most = sizes.agg(F.coalesce(F.max("parts"), F.lit(0))).first()[0]
    placed = rows.join(sizes, keys).withColumn("part", F.expr("cast(pmod(xxhash64(vec_id, label), parts) as int)"))
    dealt = placed.withColumn("group", F.expr("explode(sequence(0, groups - 1))")).select(
        *dict.fromkeys([*keys, "size", "group", "part", "vec_id", "label", "vector"])
    )
    own = anchors.join(sizes, keys).withColumn("group", F.expr("cast(pmod(xxhash64(anchor), groups) as int)"))
    packed = own.groupBy(*keys, "group").agg(
        F.collect_list(F.struct("anchor", "vec_id", "label", "vector", *extra)).alias("anchors"), F.first("parts").alias("parts")
    )
    tiles = packed.withColumn("part", F.expr("explode(sequence(0, parts - 1))")).drop("parts")
    pair = [*keys, "group", "part"]
    return dealt.groupBy(*pair).cogroup(tiles.groupBy(*pair)).applyInArrow(work, _HEAPS), most


def merged(heaps: DataFrame, parts: int, most: int) -> DataFrame:
    """anchor, positive and the one heap that is left of each."""
    keys = ["anchor", "positive"]
    while True:
        together = F.slice(F.array_sort(F.flatten(F.collect_list("heap"))), 1, most).alias("heap")
        heaps = heaps.groupBy(*keys, F.expr(f"part div {FAN}").cast("int").alias("part")).agg(together)
        parts = -(-parts // FAN)
        if parts <= 1:
            return heaps.select(*keys, "heap")


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    per_anchor: int = ANCHORS, per_tile: int = CANDIDATES, leaf: int = LEAF,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows`` as ``usable`` gives them."""
    rows = stored(rows, "mining-rows")
    anchors = stored(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "mining-anchors")
    near, parts = _met(rows, anchors, ["label", "size"], _positives(positives, leaf), [], per_anchor, per_tile)
    heaps = merged(near, parts, positives).select("anchor", F.col("heap").alias("positives"))
    found = stored(anchors.join(heaps, "anchor"), "mining-positives")
    close, parts = _met(rows, found, ["size"], _negatives(negatives, low, high, leaf), ["positives"], per_anchor, per_tile)
    windows = merged(close, parts, negatives)
    whole = windows.join(found.select("anchor", "vec_id", "positives"), "anchor")
    return whole.select("vec_id", F.expr("positives[cast(positive as int)] as positive"), F.posexplode("heap").alias("at", "negative")).select(
        F.col("vec_id").alias("anchor_id"), F.col("positive.id").alias("positive_id"), (F.col("at") + 1).alias("rank"),
        F.col("negative.id").alias("negative_id"), (-F.col("positive.cost")).alias("positive_score"), (-F.col("negative.cost")).alias("negative_score"),
    )
