"""Merkle manifest of a table of documents, with octopus multiproofs.

Every row is a leaf: the digest of its fields. The leaves of a source, ascending by doc_id, are folded sixteen by sixteen into the source's
subroot, and the subroots, in the order of the sources, likewise into the root.

1. *Places.* Leaves are range partitioned by (source, doc_id) and numbered within partition and source; the counts of the partitions give every
   partition its start, so no task holds a source.
2. *Tree.* A level groups runs of sixteen consecutive nodes; each level is a sixteenth of the one below. The tree of subroots is
   made the same way over the sources. All nodes are one stored table: (tree, level, at, digest).
3. *Octopus multiproof.* A leaf partition, at most ``LEAVES`` consecutive leaves of one stored partition, works out level by level which
   nodes of its leaves' runs it can neither see nor derive: the minimal union of missing coordinates. They are fetched
   once, by one join for all partitions. Interiors shared by its leaves are derived once, and single proofs are expanded from them.
4. *Verification.* A leaf given to be checked is folded with the siblings of its own place; a leaf that is as it was folds
   to what the partition has derived, a changed one is folded by itself.

Defined results: a field that is null is ``-``, so a null text and an empty one differ; null sources are the first tree and null ids the first leaves
of theirs. Rows that share source and doc_id are leaves of their own, in the order of their digests; rows that share all fields have
equal leaves, each at its place. An empty table has no leaves and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.llm.tables import stored

#: Children of a node, and leaves that are proved together.
FAN, LEAVES = 16, 4096
#: The tree whose leaves are the subroots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PLACED = "source string, doc_id long, leaf string, given string, part long, block long, at long"
_WANTED = "block long, tree long, level int, at long"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row: each field as its byte count and value. ``text`` stands in for the column."""
    told = []
    for name in FIELDS:
        value = (F.col(name) if text is None or name != "text" else text).cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*told).cast("binary"), 256)


def digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def _numbered(together: int):
    """Rows of a sorted partition with its number, their block and their number within the source."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, held = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            n = batch.num_rows
            code = batch.column("source").dictionary_encode()
            index = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            names = code.dictionary.to_pylist()
            at = np.empty(n, np.int64)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(index)) + 1, [n])) if n else [0]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                source = (names[index[a]],) if index[a] >= 0 else (None,)
                held = held if source == last else 0
                at[a:b] = held + np.arange(b - a)
                last, held = source, held + b - a
            block = (part << 32) + (row + np.arange(n)) // together
            row += n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(block, pa.int64()), pa.array(at)],
                names=["source", "doc_id", "leaf", "given", "part", "block", "at"],
            )

    return numbered


def _starts(counts: DataFrame, key: str, part: str = "part") -> DataFrame:
    """Of (key, part, n): how many of the key stand in the parts before."""
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def leaves(docs: DataFrame, given: Column, together: int = LEAVES) -> tuple[DataFrame, DataFrame]:
    """Leaves at their places (block, tree, at, doc_id, leaf, given) and the trees (tree, n).

    ``given`` is the leaf to be checked at the place of each row.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    typed = docs.select(*(F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS))
    told = stored(typed.select("source", "doc_id", leaf_digest().alias("leaf"), given.alias("given")), "merkle-leaves")
    # the row's number spreads equal rows over the ranges
    order = ["source", "doc_id", "leaf", F.monotonically_increasing_id()]
    ranged = told.repartitionByRange(parts, *order).sortWithinPartitions("source", "doc_id", "leaf")
    placed = stored(ranged.mapInArrow(_numbered(together), _PLACED), "merkle-places")
    held = stored(_starts(placed.groupBy("source", "part").agg(F.count("*").alias("n")), "source"), "merkle-starts")
    # sources are few or many: they get their numbers like the leaves, by ranges
    names = held.groupBy("source").agg(F.sum("n").alias("n")).repartitionByRange(parts, "source").sortWithinPartitions("source")
    listed = stored(names.mapInArrow(_counted, "source string, n long, part long, own long, one int"), "merkle-sources")
    first = _starts(listed.groupBy("one", "part").agg(F.count("*").alias("n")), "one").select("part", "start")
    trees = stored(listed.join(first, "part").select("source", (F.col("start") + F.col("own")).alias("tree"), "n"), "merkle-trees")
    starts = held.join(trees.select("source", "tree"), held["source"].eqNullSafe(trees["source"])).select(held["source"], "part", "start", "tree")
    same = placed["source"].eqNullSafe(starts["source"]) & (placed["part"] == starts["part"])
    found = placed.join(starts, same).select("block", "tree", (F.col("at") + F.col("start")).alias("at"), "doc_id", "leaf", "given")
    return stored(found, "merkle-placed"), trees.select("tree", "n")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(row + np.arange(n), pa.int64()), pa.array(np.zeros(n, np.int32))],
            names=["source", "n", "part", "own", "one"],
        )
        row += n


def levels_of(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    made = 0
    while n > 1:
        n, made = -(-n // FAN), made + 1
    return made


def _above(nodes: DataFrame) -> DataFrame:
    """The next level of the trees that still have several nodes."""
    run = F.sort_array(F.collect_list(F.struct((F.col("at") % FAN).alias("k"), "digest")))
    more = nodes.where("n > 1").groupBy("tree", F.expr(f"at div {FAN}").alias("at")).agg(run.alias("run"), F.first("n").alias("n"))
    joined = F.array_join(F.transform("run", lambda x: x["digest"]), "")
    return more.select("tree", "at", F.sha2(joined.cast("binary"), 256).alias("digest"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))


def grown(nodes: DataFrame, most: int) -> DataFrame:
    """All nodes (tree, level, at, digest, n; n: nodes of the level) over level 0, in trees of at most ``most`` leaves."""
    whole, level = nodes.withColumn("level", F.lit(0)), nodes
    for k in range(levels_of(most)):
        level = stored(_above(level), "merkle-level")
        whole = whole.unionByName(level.withColumn("level", F.lit(k + 1)))
    return whole


def octopus(at: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Level by level, the nodes of a tree of ``n`` leaves that the leaves ``at`` (ascending) need and cannot derive."""
    level = 0
    while n > 1:
        runs = np.unique(at // FAN)
        whole = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, np.setdiff1d(whole[whole < n], at, assume_unique=True)
        at, n, level = runs, -(-n // FAN), level + 1


def _missing(trees: int):
    """The coordinates that a leaf partition has to fetch, and those of the published subroots and root."""

    def asked(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        tree, at, n = (table.column(c).to_numpy() for c in ("tree", "at", "n"))
        out: list[tuple[int, int, np.ndarray]] = []
        own = np.unique(tree)
        for t in own:
            mine = np.flatnonzero(tree == t)
            size = int(n[mine[0]])
            out += [(t, level, some) for level, some in octopus(np.unique(at[mine]), size)]
            out.append((t, levels_of(size), np.zeros(1, np.int64)))
        out += [(TOP, level, some) for level, some in octopus(own, trees)]
        out.append((TOP, levels_of(trees), np.zeros(1, np.int64)))
        size = [len(some) for _, _, some in out]
        return pa.table({
            "block": np.full(sum(size), block, np.int64), "tree": np.repeat([t for t, _, _ in out], size).astype(np.int64),
            "level": np.repeat([level for _, level, _ in out], size).astype(np.int32), "at": np.concatenate([some for _, _, some in out]),
        })

    return asked


class _Side:
    """One tree as a leaf partition knows it: its digests by level, and the siblings of every node on the way up."""

    def __init__(self, own: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> None:
        self.levels, self.sizes = [own], []
        while n > 1:
            level, made = len(self.sizes), {}
            here = self.levels[-1]
            for run in sorted({at // FAN for at in here}):
                whole = range(run * FAN, min(n, run * FAN + FAN))
                held = {at: here[at] if at in here else fetched[level, at] for at in whole}
                here |= held
                made[run] = digest("".join(held.values()))
            self.sizes.append(n)
            self.levels.append(made)
            n = -(-n // FAN)
        self.root = self.levels[-1][0]
        self._ways: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def siblings(self, level: int, at: int) -> tuple[str, str]:
        """The digests before and after a node in its run."""
        low, high = at // FAN * FAN, min(self.sizes[level], at // FAN * FAN + FAN)
        here = self.levels[level]
        return "".join(here[k] for k in range(low, at)), "".join(here[k] for k in range(at + 1, high))

    def way(self, at: int, level: int = 0) -> list[tuple[str, str]]:
        """Siblings from a node to the top of its tree; the way above a run is shared by its nodes."""
        if level == len(self.sizes):
            return []
        key = level + 1, at // FAN
        if key not in self._ways:
            self._ways[key] = self.way(at // FAN, level + 1)
        return [self.siblings(level, at), *self._ways[key]]


def folded(leaf: str, way: list[tuple[str, str]]) -> str:
    for before, after in way:
        leaf = digest(before + leaf + after)
    return leaf


def _expanded(trees: int):
    """The single proofs of a leaf partition from its leaves and what it has fetched."""

    def made(own: pa.Table, fetched: pa.Table) -> pa.Table:
        rows = own.select(["tree", "at", "n", "doc_id", "leaf", "given"]).to_pylist()
        got: dict[int, dict[tuple[int, int], str]] = {}
        for r in fetched.select(["tree", "level", "at", "digest"]).to_pylist():
            got.setdefault(r["tree"], {})[r["level"], r["at"]] = r["digest"]
        sides: dict[int, _Side] = {}
        by_tree: dict[int, dict[int, str]] = {}
        sizes = {r["tree"]: r["n"] for r in rows}
        for r in rows:
            by_tree.setdefault(r["tree"], {})[r["at"]] = r["leaf"]
        for tree, own_leaves in by_tree.items():
            sides[tree] = _Side(own_leaves, got.get(tree, {}), sizes[tree])
        top = _Side({t: side.root for t, side in sides.items()}, got.get(TOP, {}), trees)
        root = got[TOP][levels_of(trees), 0]
        names = [f.split()[0] for f in PROOFS.split(", ")]
        out: dict[str, list] = {name: [] for name in names}
        for r in rows:
            tree = r["tree"]
            way = sides[tree].way(r["at"]) + top.way(tree)
            end = top.root if r["given"] == r["leaf"] else folded(r["given"], way)
            proof = digest("".join(before + after for before, after in way))
            subroot = got[tree][levels_of(sizes[tree]), 0]
            for name, value in zip(names, (r["doc_id"], r["leaf"], subroot, root, proof, end, end == root), strict=True):
                out[name].append(value)
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        return pa.table({f.split()[0]: pa.array(out[f.split()[0]], kinds[f.split()[1]]) for f in PROOFS.split(", ")})

    return made


def manifest(docs: DataFrame, given: Column | None = None, together: int = LEAVES) -> DataFrame:
    """Every row: doc_id, leaf, subroot, root, the digest of its proof, the root that its given leaf folds to, and whether it is the root."""
    placed, trees = leaves(docs, leaf_digest() if given is None else given, together)
    told = trees.agg(F.count("*").alias("trees"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    sized = stored(placed.join(trees, "tree"), "merkle-sized")
    bottom = grown(sized.select("tree", "at", F.col("leaf").alias("digest"), "n"), told["most"])
    nodes = stored(bottom, "merkle-nodes")
    subroots = nodes.where("n = 1").select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(told["trees"]).cast("long").alias("n")
    )
    above = stored(grown(subroots, told["trees"]), "merkle-top")
    every = nodes.unionByName(above).select("tree", "level", "at", "digest")
    wanted = sized.select("block", "tree", "at", "n").groupBy("block").applyInArrow(_missing(told["trees"]), _WANTED)
    fetched = wanted.join(every, ["tree", "level", "at"])
    own = sized.select("block", "tree", "at", "n", "doc_id", "leaf", "given")
    return own.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(_expanded(told["trees"]), PROOFS)
