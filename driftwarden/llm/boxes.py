"""Near pairs of unit vectors by boxes, for ``vectors``: the geometry, without Spark.

*Starts.* Vectors are rotated by a fixed random rotation and cut into m blocks. The squared distances of the blocks of a linked pair sum to at
most m shares of an m-th of the limit. So there is a block from which on, around the circle, every run of j blocks has at most j shares: the one
after which the sum runs furthest ahead of its shares. That is the pair's start, and every pair has one. With a given start,
the coordinates of the first block are close, those of the next ones nearly as close.

*Boxes.* For one start, space is cut into boxes by one coordinate after the other. A pair belongs to the box that holds the greater of its two
values in every coordinate. A vector below the lower side of a box visits it if it stands within the limit of it, and one above never does. Two visitors
below the same side belong to another box. So every pair is met in one box of its start, and none is met twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

from driftwarden.llm.components import least_labels

#: Dimensions of a block, blocks of a start whose coordinates make boxes, and vectors that are compared at once.
BLOCK_DIMENSIONS, CHAIN, TILE = 16, 2, 512
#: What is left of the pairs after a cut that is worth it; vectors a cut is chosen from; pairs for each row of a tile that are looked at one by one.
WORTH, SEEN, FEW = 0.95, 256, 4
_SLACK, _SINGLE = 1e-9, 4e-6
_PAIRS, _EDGES = 1 << 15, 1 << 20


@cache
def rotation(size: int) -> np.ndarray:
    """A fixed random rotation of ``size`` dimensions."""
    return np.linalg.qr(np.random.Generator(np.random.PCG64(size)).normal(size=(size, size)))[0]


def blocks_of(size: int) -> list[slice]:
    n = max(1, size // BLOCK_DIMENSIONS)
    cuts = [round(i * size / n) for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def share(cosine: float, size: int) -> float:
    """A block's share of the squared distance of a linked pair."""
    return (2 - 2 * cosine) / len(blocks_of(size)) * (1 + _SLACK) + _SLACK


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def turned(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in the rotated coordinates, in single precision."""
    made = np.empty(rows.shape, np.float32)
    for i in range(0, len(rows), _PAIRS):
        made[i : i + _PAIRS] = unit_rows(rows[i : i + _PAIRS]) @ rotation(rows.shape[1])
    return made


class Start:
    """The coordinates of one start, in its order, and how far apart they may be."""

    def __init__(self, cosine: float, size: int, number: int) -> None:
        parts = blocks_of(size)
        mine = [parts[(number + j) % len(parts)] for j in range(min(CHAIN, len(parts)))]
        self.number, self.blocks, self.first = number, len(parts), mine[0].stop - mine[0].start
        self.columns = np.concatenate([np.arange(p.start, p.stop) for p in mine])
        self.block = np.repeat(np.arange(len(mine)), [p.stop - p.start for p in mine])
        self.limits = ((np.arange(len(mine)) + 1) * (share(cosine, size) + _SINGLE)).astype(np.float32)
        self.reach = np.sqrt(self.limits)[self.block]
        self.open = np.full(len(self.columns), -np.inf, np.float32)
        self.bits = np.int64(1) << np.arange(len(self.columns), dtype=np.int64)

    def of(self, turned: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(turned[:, self.columns])

    def spent(self, at: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How far below a box the vectors stand: squared, by block."""
        below = np.maximum(low - at, 0)
        below *= below
        return np.stack([below[:, self.block == j].sum(1) for j in range(len(self.limits))], 1).astype(np.float32)

    def below(self, at: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The lower sides that the vectors stand below, as bits."""
        return np.where(at < low, self.bits, 0).sum(1)

    def cut(self, at: np.ndarray, low: np.ndarray) -> tuple[int, np.float32, float]:
        """The cut that leaves the fewest pairs, as seen from some of a box's vectors: coordinate, value, share of the pairs left."""
        held = np.maximum(at, low)
        value = np.partition(held, len(held) // 2, axis=0)[len(held) // 2]
        below = held < value
        under = np.count_nonzero(below, axis=0) / len(held)
        visit = np.count_nonzero(below & (held >= value - self.reach), axis=0) / len(held)
        left = under**2 + (1 - under + visit) ** 2
        k = int(left.argmin())
        return k, value[k], float(left[k])

    def sides(self, at: np.ndarray, rows: np.ndarray, spent: np.ndarray, low: np.ndarray, k: int, value: np.float32):
        """Rows of a box and what they have spent, below and above a cut."""
        own = at[rows, k]
        under = own < value
        own, cost = own[under], spent[under]
        up, before = value - own, np.maximum(low[k] - own, 0)
        more = cost.copy()
        more[:, self.block[k]] += up * up - before * before
        total, good = np.zeros(len(own), np.float32), np.ones(len(own), bool)
        for j, limit in enumerate(self.limits):
            total += more[:, j]
            good &= total <= limit
        high = np.concatenate([rows[~under], rows[under][good]]), np.concatenate([spent[~under], more[good]])
        return (rows[under], cost), high

    def boxes(self, at: np.ndarray, low: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ever smaller boxes, of ``most`` rows or where no cut is worth it, and their lower sides."""
        todo = [(np.arange(len(at)), self.spent(at, low), low)]
        while todo:
            rows, spent, low = todo.pop()
            if len(rows) < 2:
                continue
            if len(rows) > most:
                k, value, left = self.cut(at[rows[:: -(-len(rows) // SEEN)]], low)
                if left < WORTH:
                    lower, upper = self.sides(at, rows, spent, low, k, value)
                    raised = low.copy()
                    raised[k] = value
                    todo += [(*lower, low), (*upper, raised)]
                    continue
            yield rows, low


@cache
def start_of(cosine: float, size: int, number: int) -> Start:
    return Start(cosine, size, number)


def _sides(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product has the squared distances of all rows of ``a`` and ``b``."""
    one = np.ones((max(len(a), len(b)), 1), np.float32)
    left = np.concatenate([-2 * a, (a * a).sum(1)[:, None], one[: len(a)]], 1)
    return left, np.concatenate([b, one[: len(b)], (b * b).sum(1)[:, None]], 1)


class Group:
    """Vectors of one label that meet in one task: the links found so far are kept as counts and as a forest."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, copies: np.ndarray, cosine: float) -> None:
        self.rows, self.ids, self.copies, self.cosine, self.size = rows, ids, copies, cosine, rows.shape[1]
        self.turned = turned(rows)
        self.single = bool((copies == 1).all())
        self.parts, self.share = blocks_of(self.size), share(cosine, self.size)
        self.counts, self.root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.open_edges = 0
        #: If set, vectors of one side are not compared.
        self.side: np.ndarray | None = None
        #: The lower sides of the group's own box that they stand below, as it was dealt.
        self.below = np.zeros(len(ids), np.int64)

    def all_pairs(self) -> None:
        """Compare all with all at once."""
        self._meet(np.arange(len(self.ids)), self.turned, None, self.below)

    def pairs_of(self, start: Start, low: np.ndarray, most: int) -> None:
        """Compare all that can be linked with this start, in the box whose lower sides are ``low``."""
        at = start.of(self.turned)
        for rows, raised in start.boxes(at, low, most):
            held = at[rows]
            below = self.below[rows] | start.below(held, np.where(raised > low, raised, -np.inf))
            self._meet(rows, held[:, : start.first], start, below)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of every vector, and the vector it hangs on in the forest."""
        self._contract()
        return self.counts, self.root

    def _meet(self, rows: np.ndarray, at: np.ndarray, start: Start | None, below: np.ndarray) -> None:
        limit = (2 - 2 * self.cosine if start is None else self.share) + _SINGLE
        left, right = _sides(at, at)
        for i in range(0, len(rows), TILE):
            for j in range(i, len(rows), TILE):
                near = left[i : i + TILE] @ right[j : j + TILE].T <= limit
                if i == j:
                    np.fill_diagonal(near, False)
                n = np.count_nonzero(near)
                if not n:
                    continue
                a, b = slice(i, i + TILE), slice(j, j + TILE)
                if n > FEW * sum(near.shape):
                    near = self._dense(rows[a], rows[b], near, i == j, below[a], below[b], start)
                x, y = np.divmod(np.flatnonzero(near), near.shape[1])
                if i == j:
                    x, y = x[x < y], y[x < y]
                x, y = x + i, y + j
                for k in range(0, len(x), _PAIRS):
                    p, q = x[k : k + _PAIRS], y[k : k + _PAIRS]
                    good = below[p] & below[q] == 0
                    self._check(rows[p[good]], rows[q[good]], start)

    def _allowed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = self.ids[a] != self.ids[b]
        return good if self.side is None else good & (self.side[a] != self.side[b])

    def _check(self, a: np.ndarray, b: np.ndarray, start: Start | None) -> None:
        """Keep what is linked, by the cosine in double precision, and has this start."""
        good = self._allowed(a, b)
        a, b = a[good], b[good]
        x, y = unit_rows(self.rows[a]), unit_rows(self.rows[b])
        good = np.einsum("ij,ij->i", x, y) >= self.cosine
        a, b = a[good], b[good]
        if start is not None and len(a):
            apart = (x[good] - y[good]) @ rotation(self.size)
            ahead = np.add.reduceat(apart * apart, [p.start for p in self.parts], axis=1) - self.share
            # before the first block nothing is ahead; the sum over all blocks never is
            ahead = np.cumsum(ahead, axis=1)[:, :-1]
            good = np.concatenate([np.zeros((len(a), 1)), ahead], 1).argmax(1) == start.number
            a, b = a[good], b[good]
        if len(a):
            self.counts += np.bincount(a, self.copies[b], len(self.ids)).astype(np.int64)
            self.counts += np.bincount(b, self.copies[a], len(self.ids)).astype(np.int64)
            self._join(a, b)

    def _apart(self, a: np.ndarray, b: np.ndarray, first: int, last: int) -> np.ndarray:
        """Squared distances over the blocks from ``first`` to before ``last``."""
        columns = slice(self.parts[first].start, self.parts[last - 1].stop)
        left, right = _sides(self.turned[a, columns], self.turned[b, columns])
        return left @ right.T

    def _dense(self, a: np.ndarray, b: np.ndarray, near: np.ndarray, same: bool, below_a: np.ndarray, below_b: np.ndarray, start: Start | None) -> np.ndarray:
        """Settle a tile's pairs at once, as far as single precision is sure of them; the others are left."""
        limit = 2 - 2 * self.cosine
        for first in range(start.number - 1, -1, -1) if start else ():
            # what is not ahead of its shares just before the start begins earlier
            near &= self._apart(a, b, first, start.number) > (start.number - first) * self.share - _SINGLE
            if np.count_nonzero(near) <= FEW * sum(near.shape):
                return near
        far = self._apart(a, b, 0, len(self.parts))
        near &= far <= limit + _SINGLE
        if below_a.any() and below_b.any():
            near &= below_a[:, None] & below_b[None, :] == 0
        near &= self._allowed(a[:, None], b[None, :])
        if same:
            near = np.triu(near, 1)
        if start is not None and start.number:
            return near
        sure = near & (far <= limit - _SINGLE)
        for n in range(1, len(self.parts)) if start else ():
            if not (near & (far > n * self.share - _SINGLE)).any():
                break
            ahead = self._apart(a, b, 0, n) - n * self.share
            near &= ahead <= _SINGLE
            sure &= ahead <= -_SINGLE
        self._take(a, b, sure)
        return near & ~sure

    def _take(self, a: np.ndarray, b: np.ndarray, sure: np.ndarray) -> None:
        rows, columns = np.flatnonzero(sure.any(1)), np.flatnonzero(sure.any(0))
        if not len(rows):
            return
        if self.single:
            self.counts[a] += np.count_nonzero(sure, axis=1)
            self.counts[b] += np.count_nonzero(sure, axis=0)
        else:
            as_number = sure.astype(np.float64)
            self.counts[a] += (as_number @ self.copies[b]).astype(np.int64)
            self.counts[b] += (self.copies[a] @ as_number).astype(np.int64)
        self._join(np.concatenate([a[rows], a[sure.argmax(0)[columns]]]), np.concatenate([b[sure.argmax(1)[rows]], b[columns]]))
        self._contract()
        x, y = self.root[a], self.root[b]
        if x[rows].min() != x[rows].max() or (y[columns] != x[rows[0]]).any():
            p, q = np.nonzero(sure & (x[:, None] != y[None, :]))
            self._join(a[p], b[q])

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.edges.append((a, b))
        self.open_edges += len(a)
        if self.open_edges >= _EDGES:
            self._contract()

    def _contract(self) -> None:
        if self.edges:
            a, b = (self.root[np.concatenate(x)] for x in zip(*self.edges, strict=True))
            nodes, roots = least_labels(a, b)
            to = np.arange(len(self.root))
            to[nodes] = roots
            self.root, self.edges, self.open_edges = to[self.root], [], 0
