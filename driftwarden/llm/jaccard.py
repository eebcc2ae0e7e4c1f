"""N-gram Jaccard join: which documents share at least so much of their word shingles, and the groups they form.

1. *Filter.* A link needs an overlap of at least the threshold times the larger set. The partitioned sketch of ``substring`` tells
   how many shingles of a document stand in another document at all (an overestimate, so no link is lost);
   documents with too few can have no link and are done. Only the others go on, with their shingle hashes.
2. *Classes.* Documents with equal sets become one class, by a 128-bit digest of the set.
3. *Blocks.* Linked sets share one of the ``size - overlap + 1`` least hashes of each (prefix filter), so classes that share
   such a hash form a block.
4. *Signature trees.* A node holds the OR of its members' token bitmaps and their size range. Node pairs are traversed together
   and dropped when the sizes, or the bits they share plus the most tokens that can hide behind one bit, cannot reach
   the overlap. First every class meets the block of its least hash only, with its whole set, and what survives the
   traversal is checked exactly. Components follow. Then the other blocks are taken that still hold several components,
   with bitmaps only; what survives there between different components makes families, and a family's sets are
   traversed and checked in one place. Neither pass writes pairs: each writes a forest of what it connects.
   A block or family beyond ``CHUNK`` members is cut into chunks that meet pairwise in different tasks.

A link inside a component that is known already changes nothing in the result, so it need not be found.

Defined results: a null text or one without words has the empty set and no links; a text of fewer words than a shingle has
its whole sequence as its only shingle. Rows that share a doc_id but not the text are documents of their own, told apart by a hash beside
the id, and a group goes by the least id in it; rows that share both get one answer; rows without an id are left out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.components import components, least_labels
from driftwarden.llm.hashing import grouped, mix, slices, take_ranges, windows
from driftwarden.llm.substring import _ANSWERED, _ASKED, _ROW, Sketch, _marked, _rows_of, _slice_bits, ask_cells, bits_set, count_cells, slice_numbers
from driftwarden.llm.tables import stored

CHUNK, LEAF, FAN, _COLUMNS = 4000, 32, 8, 2048
_COUNTS = "doc_id long, mark long, n long, shared long"
_SETS = "doc_id long, mark long, n long, digest1 long, digest2 long, tokens array<long>"


@dataclass(frozen=True)
class Shingles:
    """Words in a shingle and the least similarity, in hundredths."""

    words: int = 5
    percent: int = 80

    def overlap(self, a, b):
        """The least overlap of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least(self, n):
        """The least overlap of a set of this size with any other."""
        return -(-self.percent * n // 100)


def _distinct(words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, their text, and where the texts begin."""
    hashed, first = windows(words.hashes(), words.first, size, short=True)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashed, doc))
    hashed, doc = hashed[order], doc[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
    hashed, doc = hashed[new], doc[new]
    return hashed, doc, np.searchsorted(doc, np.arange(len(first)))


def shared_counts(docs: DataFrame, rule: Shingles) -> DataFrame:
    """Every document: n, the size of its set, and shared, at least the number of its shingles that another document has."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sketch = Sketch.of(total)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = slice_numbers()
        for batch in batches:
            for words in slices(batch.column("text"), lower=True, limit=sketch.slice_bytes):
                hashed, doc, _ = _distinct(words, rule.words)
                yield ask_cells(next(numbers), _marked(batch, words), hashed, doc, sketch)

    def count(group: pa.Table) -> pa.Table:
        own, n, found = _slice_bits(group, _ROW)
        shared = bits_set(found, np.concatenate(([0], np.cumsum(n))))
        columns = (own["id"], own["mark"], n.astype(np.int64), shared.astype(np.int64))
        return pa.table({name.split()[0]: pa.array(np.ascontiguousarray(c)) for name, c in zip(_COUNTS.split(", "), columns, strict=True)})

    asked = docs.select("doc_id", "text", "mark").mapInArrow(ask, _ASKED).groupBy("part").applyInArrow(count_cells(sketch), _ANSWERED)
    return asked.groupBy("slice").applyInArrow(count, _COUNTS)


def shingle_sets(docs: DataFrame, rule: Shingles) -> DataFrame:
    """doc_id, mark, n, a digest of the set in two halves, and the set as ascending (unsigned) hashes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text"), lower=True):
                hashed, doc, first = _distinct(words, rule.words)
                halves = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashed ^ np.uint64(salt)))))
                    halves.append(pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64)))
                size = words.rows.stop - words.rows.start
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(words.rows.start, size) for c in ("doc_id", "mark")), pa.array(np.diff(first)), *halves,
                        grouped(hashed.view(np.int64), first, pa.int64()),
                    ],
                    names=["doc_id", "mark", "n", "digest1", "digest2", "tokens"],
                )

    return docs.select("doc_id", "text", "mark").mapInArrow(made, _SETS)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where their groups begin, from batches that come sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = held[-1].slice(held[-1].num_rows - 1) if held else batch.slice(0, 0)
        starts = _cuts(pa.Table.from_batches([last, batch]), keys)[1 if held else 0 : -1] - last.num_rows
        if not len(starts) or (not held and starts[-1] == 0):
            held.append(batch)
            continue
        held.append(batch.slice(0, starts[-1]))
        table = pa.Table.from_batches(held)
        yield table, _cuts(table, keys)
        held = [batch.slice(starts[-1])]
    if held:
        table = pa.Table.from_batches(held)
        yield table, _cuts(table, keys)


def _cuts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


@dataclass
class Node:
    """A stretch of members: OR of their bitmaps, the range of their sizes, most tokens behind a bit that another has too."""

    first: int
    last: int
    bitmap: np.ndarray
    small: int
    large: int
    hidden: int
    children: list[Node]


def bitmaps(tokens: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of ``width`` bits for each set: one row of 64-bit words each."""
    n = np.diff(first)
    bit = (tokens & np.uint64(width - 1)).astype(np.int64) + np.repeat(np.arange(len(n)) * width, n)
    made = np.zeros(len(n) * width, np.uint8)
    made[bit] = 1
    return np.packbits(made, bitorder="little").view("<u8").reshape(len(n), width // 64)


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n: two to four a token."""
    return 1 << max(6, int(2 * n - 1).bit_length())


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps brought to fewer words, as if made at that width."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] | bitmap[..., half:]
    return bitmap


def grow(maps: np.ndarray, n: np.ndarray) -> Node:
    """A signature tree over members in the order given."""
    hidden = n - np.bitwise_count(maps).sum(1)
    level = [
        Node(i, j, np.bitwise_or.reduce(maps[i:j]), int(n[i:j].min()), int(n[i:j].max()), int(hidden[i:j].max()), [])
        for i in range(0, len(n), LEAF)
        for j in [min(i + LEAF, len(n))]
    ]
    while len(level) > 1:
        level = [_above(level[i : i + FAN]) for i in range(0, len(level), FAN)]
    return level[0]


def _above(nodes: list[Node]) -> Node:
    return Node(
        nodes[0].first, nodes[-1].last, np.bitwise_or.reduce([x.bitmap for x in nodes]), min(x.small for x in nodes),
        max(x.large for x in nodes), max(x.hidden for x in nodes), nodes,
    )


def may_link(a: Node, b: Node, rule: Shingles) -> bool:
    """Whether two nodes can hold a link: sizes within the ratio, and the most their members can share is enough."""
    if 100 * a.large < rule.percent * b.small or 100 * b.large < rule.percent * a.small:
        return False
    shared = int(np.bitwise_count(a.bitmap & b.bitmap).sum())
    return shared + min(a.hidden, b.hidden) >= rule.overlap(a.small, b.small)


def leaf_pairs(maps: np.ndarray, n: np.ndarray, rule: Shingles) -> Iterator[tuple[slice, slice]]:
    """Pairs of leaves that may hold a link, by traversing the tree against itself."""
    root = grow(maps, n)
    todo = [(root, root)]
    while todo:
        a, b = todo.pop()
        if not may_link(a, b, rule):
            continue
        if not a.children and not b.children:
            yield slice(a.first, a.last), slice(b.first, b.last)
        elif a is b:
            todo += [(x, y) for i, x in enumerate(a.children) for y in a.children[i:]]
        elif b.children and (not a.children or b.last - b.first >= a.last - a.first):
            todo += [(a, y) for y in b.children]
        else:
            todo += [(x, b) for x in a.children]


def candidates(maps: np.ndarray, n: np.ndarray, rule: Shingles) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members that may be linked, a pair of leaves at a time."""
    hidden = n - np.bitwise_count(maps).sum(1).astype(np.int64)
    for left, right in leaf_pairs(maps, n, rule):
        shared = np.bitwise_count(maps[left, None, :] & maps[None, right, :]).sum(2).astype(np.int64)
        most = shared + np.minimum(hidden[left, None], hidden[None, right])
        good = most >= rule.overlap(n[left, None], n[None, right])
        good &= 100 * np.minimum(n[left, None], n[None, right]) >= rule.percent * np.maximum(n[left, None], n[None, right])
        a, b = np.nonzero(good)
        a, b = a + left.start, b + right.start
        keep = a < b
        yield a[keep], b[keep]


def overlaps(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Exact overlaps of all sets of a group, from a product of the incidence matrix with itself, some columns at a time."""
    values, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = np.repeat(np.arange(len(n)), n)[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    found = np.zeros((len(n), len(n)), np.float32)
    for low in range(0, int(shared.sum()), _COLUMNS):
        i, j = np.searchsorted(column, (low, low + _COLUMNS))
        part = np.zeros((len(n), _COLUMNS), np.float32)
        part[row[i:j], column[i:j] - low] = 1
        found += part @ part.T
    return found


def _connected(table: pa.Table, group: slice, rule: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between different components in one group of sets: node and least node."""
    ids, n, comp = (table.column(c).to_numpy()[group] for c in ("doc_id", "n", "component"))
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(ids) < 2 or (comp == comp[0]).all():
        return nothing
    lists = table.column("tokens").slice(group.start, group.stop - group.start)
    lists = pa.concat_arrays(lists.chunks)
    order = np.argsort(n, kind="stable")
    tokens = lists.flatten().to_numpy().view(np.uint64)
    first = np.cumsum(n) - n
    ids, n, comp = ids[order], n[order], comp[order]
    tokens = tokens[take_ranges(first[order], n)]
    maps = bitmaps(tokens, np.concatenate(([0], np.cumsum(n))), width_of(int(n[-1])))
    near = np.zeros(len(ids), bool)  # members of leaf pairs that the tree cannot rule out
    pairs = []
    for a, b in candidates(maps, n, rule):
        apart = comp[a] != comp[b]
        pairs.append(np.stack([a[apart], b[apart]], 1))
        near[a[apart]] = near[b[apart]] = True
    if not near.any():
        return nothing
    mine = np.flatnonzero(near)
    place = np.cumsum(near) - 1
    first = np.cumsum(n) - n
    both = overlaps(tokens[take_ranges(first[mine], n[mine])], n[mine])
    a, b = np.concatenate(pairs).T
    shared = both[place[a], place[b]].astype(np.int64)
    good = 100 * shared >= rule.percent * (n[a] + n[b] - shared)
    return least_labels(ids[a[good]], ids[b[good]])


def _links_by_sets(keys: list[str], rule: Shingles):
    """Links within groups whose members bring their sets; enough to connect what is connected in the group."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in whole_groups(batches, keys):
            made = [_connected(table, slice(i, j), rule) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield _forest(made)

    return joined


def _forest(made: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    nodes, roots = (np.concatenate([m[k] for m in made] or [np.zeros(0, np.int64)]) for k in (0, 1))
    moved = nodes != roots
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], names=["a", "b"])


def _related_by_bitmaps(rule: Shingles):
    """A forest of the pairs of different components that may be linked, from blocks (or pairs of chunks) of bitmaps."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cut in whole_groups(batches, ["token", "left", "right"]):
            ids, n, comp = (table.column(c).to_numpy() for c in ("doc_id", "n", "component"))
            raw = table.column("bitmap").to_pylist()
            made = []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if j - i < 2:
                    continue
                order = i + np.argsort(n[i:j], kind="stable")
                words = min(len(raw[k]) for k in order) // 8
                maps = np.stack([folded(np.frombuffer(raw[k], "<u8"), words) for k in order])
                pairs = [np.zeros((2, 0), np.int64)]
                for a, b in candidates(maps, n[order], rule):
                    p, q = order[a], order[b]
                    apart = comp[p] != comp[q]
                    pairs.append(np.stack([ids[p][apart], ids[q][apart]]))
                made.append(least_labels(*np.concatenate(pairs, 1)))
            yield _forest(made)

    return joined


def _prefixes(rule: Shingles):
    """The least hashes of each set with their place, and the set's bitmap."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            lists = batch.column("tokens")
            first, tokens = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            size = n - rule.least(n) + 1
            at = np.concatenate(([0], np.cumsum(size)))
            prefix = tokens[take_ranges(first[:-1], size)]
            maps = [
                bitmaps(tokens[a:b].view(np.uint64), np.array([0, b - a]), width_of(b - a)).tobytes()
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n"), grouped(prefix, at, pa.int64()), pa.array(maps, pa.binary())],
                names=["doc_id", "n", "prefix", "bitmap"],
            )

    return made


def links(sets: DataFrame, rule: Shingles) -> DataFrame:
    """Links between different sets (doc_id, n, tokens; stored), enough to connect all that is connected."""
    heads = stored(
        sets.mapInArrow(_prefixes(rule), "doc_id long, n long, prefix array<long>, bitmap binary"), "prefixes"
    )
    found, known = None, heads.select("doc_id", F.col("doc_id").alias("component"))
    least = heads.select("doc_id", F.col("prefix")[0].alias("token"))
    salt = 0
    while True:
        sizes = (
            least.join(known, "doc_id").groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
            .where("size > 1 and low < high").where(f"{salt} = 0 or size > {CHUNK}").select("token", "size")
        )
        sizes = stored(sizes, "blocks")
        if not sizes.take(1):
            break
        dealt = least.join(sizes, "token").selectExpr(
            "doc_id", "token", f"cast(pmod(xxhash64(doc_id, {salt}), ceil(size / {CHUNK})) as int) as chunk"
        )
        keys = ["token", "chunk"]
        brought = sets.select("doc_id", "n", "tokens").join(dealt.join(known, "doc_id").hint("merge"), "doc_id")
        new = _sorted_by(brought, keys).mapInArrow(_links_by_sets(keys, rule), "a long, b long")
        new = stored(new, "links-least")
        found = new if found is None else found.unionByName(new)
        known = stored(_with_components(heads, found), "components")
        salt += 1
        if salt > 1 and not new.take(1):
            break
    related = stored(_related(heads, known, rule), "related")
    checked = stored(_within_families(related, known, sets, rule), "links-rest")
    return checked if found is None else found.unionByName(checked)


def _with_components(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.select("doc_id").join(components(found).withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component")
    )


def _sorted_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _related(heads: DataFrame, known: DataFrame, rule: Shingles) -> DataFrame:
    """What connects classes of different components that share a prefix hash and that the bitmaps cannot rule out."""
    placed = stored(
        heads.join(known, "doc_id").selectExpr("doc_id", "n", "component", "explode(prefix) as token"), "prefix-rows"
    )
    sizes = placed.groupBy("token").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
    sizes = stored(sizes.where("size > 1 and low < high").select("token", "size"), "open-blocks")
    dealt = stored(
        placed.join(sizes, "token").withColumn("chunk", F.expr(f"cast(pmod(xxhash64(doc_id), ceil(size / {CHUNK})) as int)")), "open-rows"
    )
    nodes = dealt.groupBy("token", "chunk").agg(
        F.min("n").alias("small"), F.max("n").alias("large"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    nodes = stored(nodes, "nodes")
    left = nodes.selectExpr("token", "chunk as left", "small as s1", "large as l1", "low as c1", "high as d1")
    right = nodes.selectExpr("token", "chunk as right", "small as s2", "large as l2", "low as c2", "high as d2")
    ratio = f"100 * l1 >= {rule.percent} * s2 and 100 * l2 >= {rule.percent} * s1"
    pairs = left.join(right, "token").where(f"left <= right and {ratio} and not (c1 = d1 and c2 = d2 and c1 = c2)")
    sides = pairs.selectExpr("token", "left", "right", "explode(array_distinct(array(left, right))) as chunk")
    members = dealt.select("doc_id", "n", "component", "token", "chunk").join(sides, ["token", "chunk"])
    signed = members.join(heads.select("doc_id", "bitmap"), "doc_id")
    return _sorted_by(signed, ["token", "left", "right"]).mapInArrow(_related_by_bitmaps(rule), "a long, b long").distinct()


def _within_families(related: DataFrame, known: DataFrame, sets: DataFrame, rule: Shingles) -> DataFrame:
    """Links inside the families that ``related`` connects, enough to connect what is connected.

    Linked sizes lie in one band or in two that follow each other (a band ends where the ratio allows no link with its start),
    so a family is worked through band by band. A set travels to two bands of its family, and there, in a large family, to each pair
    of chunks that its own chunk is part of. Bands that hold one component only are left out.
    """
    families = components(related).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "family")
    ends = related.select(F.col("a").alias("doc_id")).union(related.select("b")).distinct()
    placed = ends.join(families, "doc_id", "left").select("doc_id", F.coalesce("family", "doc_id").alias("family"))
    # a little wide, for rounding
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.001 / rule.percent))).cast("int")
    banded = placed.join(known, "doc_id").join(sets.select("doc_id", "n"), "doc_id").select(
        "doc_id", "family", "component", F.explode(F.array(band - 1, band)).alias("band")
    )
    banded = stored(banded, "families")
    sizes = banded.groupBy("family", "band").agg(
        F.expr(f"cast(ceil(count(*) / {CHUNK}) as int)").alias("chunks"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    sizes = stored(sizes.where("low < high").select("family", "band", "chunks"), "family-sizes")
    members = banded.join(sizes, ["family", "band"]).withColumn("chunk", F.expr("cast(pmod(xxhash64(doc_id), chunks) as int)"))
    met = members.withColumn("other", F.expr("explode(sequence(0, chunks - 1))")).selectExpr(
        "doc_id", "component", "family", "band", "least(chunk, other) as left", "greatest(chunk, other) as right"
    )
    keys = ["family", "band", "left", "right"]
    brought = met.hint("merge").join(sets.select("doc_id", "n", "tokens"), "doc_id")
    return _sorted_by(brought, keys).mapInArrow(_links_by_sets(keys, rule), "a long, b long")


def near_groups(docs: DataFrame, rule: Shingles | None = None) -> DataFrame:
    """Every document: doc_id, n_shingles, component_id (the least doc_id that links reach)."""
    return marked_groups(docs, rule).drop("mark")


def marked_groups(docs: DataFrame, rule: Shingles | None = None) -> DataFrame:
    """``near_groups`` with the mark that tells the texts of one id apart."""
    rule = rule or Shingles()
    docs = _rows_of(docs)
    counts = stored(shared_counts(docs, rule), "shared-counts")
    open_docs = counts.where(f"n > 0 and shared >= {rule.percent} * n / 100").select("doc_id", "mark")
    sets = stored(shingle_sets(docs.join(open_docs.hint("merge"), ["doc_id", "mark"], "left_semi"), rule), "sets")
    key = ["n", "digest1", "digest2"]
    least = sets.groupBy(*key).agg(F.min("doc_id").alias("first"))
    # a class has a number of its own: rows of one id can be the first of several classes
    classes = stored(least.withColumn("class", F.monotonically_increasing_id()), "classes")
    firsts = sets.select("doc_id", *key, "tokens").join(classes.withColumnRenamed("first", "doc_id").hint("merge"), ["doc_id", *key])
    firsts = stored(firsts.dropDuplicates(["doc_id", *key]).select(F.col("class").alias("doc_id"), "n", "tokens"), "class-sets")
    joined = stored(_with_components(firsts, links(firsts, rule)).withColumnRenamed("doc_id", "class"), "class-groups")
    lowest = classes.join(joined, "class").groupBy("component").agg(F.min("first").alias("component_id"))
    of_class = stored(classes.join(joined, "class").join(lowest, "component").select(*key, "component_id"), "class-components")
    of_doc = sets.select("doc_id", "mark", *key).join(of_class, key).groupBy("doc_id", "mark").agg(F.min("component_id").alias("component_id"))
    return counts.join(of_doc, ["doc_id", "mark"], "left").select(
        "doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, rule: Shingles | None = None) -> DataFrame:
    """One document of each group, the one of least id, with all its columns; texts under one id that link with each other stay."""
    gone = marked_groups(docs, rule).where("component_id <> doc_id").selectExpr("doc_id as _gone", "mark as _gone_mark")
    own = docs.select(*docs.columns, F.col("doc_id").cast("long").alias("_key"), F.xxhash64("text").alias("_key_mark"))
    same = (F.col("_key") == F.col("_gone")) & (F.col("_key_mark") == F.col("_gone_mark"))
    return own.join(stored(gone, "near-copies"), same, "left_anti").select(*docs.columns)
