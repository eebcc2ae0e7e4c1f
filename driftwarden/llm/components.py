"""Connected components of a link table, by contraction.

Each partition joins what its own links connect (labels in arrays, no object per node) and gives every node the least
node of its part. Nodes then take the least of the answers they got, and what the partitions disagree on becomes the
links of the next, much smaller level. No level gathers a node's links in one place, so a node of very many links
is no heavier than others, and nothing is collected on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.tables import stored


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b), sorted, and the least node that each is connected with."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        open_links = label[left] != label[right]
        left, right = left[open_links], right[open_links]
    return nodes, nodes[label]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes, roots = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        nodes, roots = least_labels(np.concatenate([nodes, a]), np.concatenate([roots, b]))
    moved = nodes != roots
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(roots[moved])], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns) whose component has a smaller node."""
    live, levels = links.toDF("a", "b").where("a <> b"), []
    while True:
        stars = stored(live.mapInArrow(_local, "node long, root long"), "stars")
        least = stored(stars.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")), "least")
        levels.append(least)
        # a node with different answers links them; a node that is an answer itself links on to its own
        split = least.where("low < high").select("node", "low")
        apart = stars.join(split, "node").where("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b"))
        answers = stars.select(F.col("root").alias("node")).distinct()
        onward = least.join(answers, "node", "left_semi").select(F.col("node").alias("a"), F.col("low").alias("b"))
        live = stored(apart.unionByName(onward).distinct(), "links")
        if not live.take(1):
            break
    found = None
    for least in reversed(levels):
        if found is None:
            found = least.select("node", F.col("low").alias("component"))
            continue
        on = found.select(F.col("node").alias("low"), "component")
        mine = least.join(on, "low", "left").select("node", F.coalesce("component", "low").alias("component"))
        found = mine.unionByName(found.join(least, "node", "left_anti"))
    return found
