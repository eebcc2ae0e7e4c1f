"""Quality classifier: a sparse rule ensemble over statistics of the text.

Shallow boosted trees are grown on the statistics of a bounded sample of labelled documents; every path from a
root to a node is a conjunctive rule. A lasso logistic fit keeps few of them, and the kept rules are compiled into one
Spark column expression over the statistics, which scores every document.

Defined results: a null or empty text has the statistics 0 and gets the score that the rules give them. Repeated rows
each get their score. Without labelled rows every score is 0.5; with one class only, its smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.hashing import is_alphanumeric, slices
from driftwarden.llm.sparse_fit import lasso_logistic

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "signs", "stops", "blanks", "lines", "high",
    "distinct", "top_word", "repeats", "bare_words", "odd_ends",
]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its whole text."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text")):
                ids = batch.column("doc_id").slice(words.rows.start, words.rows.stop - words.rows.start)
                columns = _measures(words)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(columns[s]) for s in STATISTICS)], names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measured, STATS_SCHEMA)


def _measures(words) -> dict[str, np.ndarray]:
    data, n, offsets = words.data, words.counts(), words.offsets
    size = np.diff(offsets)

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        at = np.concatenate(([0], np.cumsum(mask)))
        return (at[offsets[1:]] - at[offsets[:-1]]) / np.maximum(of, 1)

    def word_share(mask: np.ndarray) -> np.ndarray:
        at = np.concatenate(([0], np.cumsum(mask)))
        return (at[words.first[1:]] - at[words.first[:-1]]) / np.maximum(n, 1)

    letters = is_alphanumeric(data)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    stops = (data == 46) | (data == 44)
    hashed = words.hashes()
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashed, doc))
    run = np.ones(len(hashed), bool)
    run[1:] = (hashed[order][1:] != hashed[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    heads = np.flatnonzero(run)
    held = np.diff(np.append(heads, len(run)))
    distinct = np.bincount(doc[order][heads], minlength=len(n))
    top = np.zeros(len(n))
    np.maximum.at(top, doc[order][heads], held)
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (doc[1:] == doc[:-1])
    lettered = np.concatenate(([0], np.cumsum(letters)))
    return {
        "log_bytes": np.log1p(size), "log_words": np.log1p(n), "word_bytes": share(~blank, n),
        "upper": share((data >= 65) & (data <= 90), size), "digits": share((data >= 48) & (data <= 57), size),
        "signs": share(~letters & ~blank & ~stops, size), "stops": share(stops, size), "blanks": share(blank, size),
        "lines": share(data == 10, size), "high": share(data >= 128, size),
        "distinct": distinct / np.maximum(n, 1), "top_word": top / np.maximum(n, 1), "repeats": word_share(again),
        "bare_words": word_share(lettered[words.ends] == lettered[words.starts]),
        "odd_ends": word_share(~letters[words.ends - 1] & ~stops[words.ends - 1]),
    }


#: (statistic, above the threshold?, threshold)
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class Rules:
    """An intercept and weighted conjunctions."""

    intercept: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        margin = F.lit(float(self.intercept))
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for name, above, at in conditions:
                holds = holds & ((F.col(name) > at) if above else (F.col(name) <= at))
            margin = margin + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def _tree(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], depth: int, least: int, path=()):
    """Paths to all nodes of one regression tree on gradients, and the tree's value for each row."""
    value = np.full(len(x), -slope.sum() / (curve.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return [], value
    best = (1e-6, None, None)
    for j, at in enumerate(cuts):
        if not len(at):
            continue
        bin_of = np.searchsorted(at, x[:, j], "left")  # bin b holds values up to at[b]
        g, h = (np.cumsum(np.bincount(bin_of, v, len(at) + 1))[:-1] for v in (slope, curve))
        k = np.cumsum(np.bincount(bin_of, minlength=len(at) + 1))[:-1]
        gain = g**2 / (h + 1) + (slope.sum() - g) ** 2 / (curve.sum() - h + 1) - slope.sum() ** 2 / (curve.sum() + 1)
        gain[(k < least) | (len(x) - k < least)] = -1
        b = int(np.argmax(gain))
        if gain[b] > best[0]:
            best = (gain[b], j, float(at[b]))
    if best[1] is None:
        return [], value
    paths = []
    for above in (False, True):
        mine = (x[:, best[1]] > best[2]) == above
        here = (*path, (STATISTICS[best[1]], above, best[2]))
        more, value[mine] = _tree(x[mine], slope[mine], curve[mine], cuts, depth - 1, least, here)
        paths += [here, *more]
    return paths, value


def extract_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, least: int = 5) -> list[tuple[Condition, ...]]:
    """Paths of boosted trees, each on a random half of the rows."""
    rng, margin, found = np.random.default_rng(0), np.zeros(len(x)), {}
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1], method="lower")) for j in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        mine = rng.random(len(x)) < 0.5
        if mine.sum() < 2 * least:
            break
        paths, _ = _tree(x[mine], (p - y)[mine], (p * (1 - p))[mine], cuts, depth, least)
        for path in paths:
            found.setdefault(frozenset(path), path)
        # the margin moves by the leaf means of this tree, found again on all rows
        leaves = [path for path in paths if len(path) == depth] or paths
        for path in leaves:
            holds = _holds(x, path)
            if holds.any():
                g, h = (p - y)[holds].sum(), (p * (1 - p))[holds].sum()
                margin[holds] -= 0.3 * g / (h + 1)
    return list(found.values())


def _holds(x: np.ndarray, path: tuple[Condition, ...]) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for name, above, at in path:
        mask &= (x[:, STATISTICS.index(name)] > at) == above
    return mask


def fit(sample: DataFrame, trees: int = 40, depth: int = 3, penalty: float = 0.001) -> Rules:
    """Learn from ``sample`` (doc_id, text, y), which must be bounded: its statistics come to the driver."""
    known = statistics(sample).join(sample.select("doc_id", "y"), "doc_id").toPandas().sort_values("doc_id")
    x, y = known[STATISTICS].to_numpy(float), known["y"].to_numpy(float)
    if not len(x):
        return Rules(0.0, ())
    paths = extract_rules(x, y, trees, depth) if 0 < y.mean() < 1 else []
    design = np.stack([_holds(x, p) for p in paths], 1).astype(np.float32) if paths else np.zeros((len(x), 0), np.float32)
    intercept, weights = lasso_logistic(design, y, penalty)
    return Rules(intercept, tuple((float(w), p) for w, p in zip(weights, paths, strict=True) if w))


def score(docs: DataFrame, model: Rules) -> DataFrame:
    """doc_id and the score of every document, 0 to 1."""
    return statistics(docs).select("doc_id", model.column().alias("score"))
