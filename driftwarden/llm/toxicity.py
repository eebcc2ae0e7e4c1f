"""Toxicity: a sparse word classifier with counterfactual regularisation.

Features are whole words and their first four to six signs, each as the logarithm of its count. The words that tell toxic from other
labelled documents are counted in Spark; the lasso logistic fit then runs on a bounded sample. Where a labelled sentence
has an identity term, the term is swapped for the others of its group, and the fit is penalised by the squared change of the
sentence's margin over all features, beginnings of the terms too: a group's name alone must not move the score.

Defined results: a null or empty text has no features and gets the intercept's score. Repeated rows each get their score. Without
labelled rows every score is 0.5; with one class only, its smoothed share.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.hashing import Words, byte_runs, is_alphanumeric, slices
from driftwarden.llm.labelled import labelled_sample
from driftwarden.llm.sparse_fit import lasso_logistic
from driftwarden.llm.tables import stored

#: Identity terms that may stand for each other in a sentence, in groups by language; callers may give groups of their own.
TERMS_BY_LANGUAGE = {
    "en": [
        ["women", "men", "girls", "boys"],
        ["woman", "man", "girl", "boy"],
        ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"],
        ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"],
        ["gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"],
        ["black", "white", "asian", "african", "european", "latino", "arab", "indigenous"],
        ["immigrants", "refugees", "foreigners", "locals", "migrants"],
        ["disabled", "deaf", "blind", "autistic"],
        ["elderly", "young", "old", "teenage"],
    ],
    "de": [
        ["frauen", "männer", "mädchen", "jungen"],
        ["muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"],
        ["schwule", "lesben", "heterosexuelle", "bisexuelle"],
        ["einwanderer", "flüchtlinge", "ausländer", "einheimische"],
        ["behinderte", "gehörlose", "blinde", "autisten"],
    ],
    "fr": [
        ["femmes", "hommes", "filles", "garçons"],
        ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"],
        ["gays", "lesbiennes", "hétérosexuels", "bisexuels"],
        ["immigrés", "réfugiés", "étrangers", "habitants"],
        ["handicapés", "sourds", "aveugles", "autistes"],
    ],
    "es": [
        ["mujeres", "hombres", "niñas", "niños"],
        ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"],
        ["gais", "lesbianas", "heterosexuales", "bisexuales"],
        ["inmigrantes", "refugiados", "extranjeros", "vecinos"],
        ["discapacitados", "sordos", "ciegos", "autistas"],
    ],
}
Groups = list[list[str]]
IDENTITY_TERMS: Groups = [group for groups in TERMS_BY_LANGUAGE.values() for group in groups]
PREFIXES = (4, 5, 6)
#: Bounds of what is learned: features kept, documents a feature must be found in, and how far (in standard
#: deviations) its toxic documents must be from what chance gives.
MOST_FEATURES, LEAST_DOCUMENTS, LEAST_STRENGTH = 600, 3, 3.5
_FEATURES = "feature long, n long, bad long"
_SENTENCE_ENDS = (ord("."), ord("!"), ord("?"), ord("\n"))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and their beginnings, and the text each belongs to."""
    text_of = np.repeat(np.arange(len(words.first) - 1), words.counts())
    heads = np.flatnonzero((words.data & 0xC0) != 0x80)
    at = np.searchsorted(heads, words.starts)
    found, owner = [byte_runs(words.data, words.starts, words.ends)], [text_of]
    bounds = np.append(heads, np.full(max(PREFIXES) + 1, len(words.data)))
    for k in PREFIXES:
        end = bounds[at + k]
        longer = end < words.ends
        made = byte_runs(words.data, words.starts[longer], end[longer])
        found.append(made ^ np.uint64(0xA5A5A5A5A5A5A5A5 + k))
        owner.append(text_of[longer])
    return np.concatenate(found), np.concatenate(owner)


def parsed(texts: pa.Array) -> Iterator[Words]:
    return slices(pc.utf8_lower(pc.fill_null(texts, "")), belongs=is_alphanumeric)


def term_features(groups: Groups | None = None) -> dict[str, int]:
    """The feature of each identity term."""
    terms = _terms(groups)
    made: dict[str, int] = {}
    for words in parsed(pa.array(terms)):
        hashed = byte_runs(words.data, words.starts, words.ends)
        made |= dict(zip(terms[words.rows], hashed.view(np.int64).tolist(), strict=True))
    return made


def _terms(groups: Groups | None) -> list[str]:
    return [t for group in (IDENTITY_TERMS if groups is None else groups) for t in group]


def term_parts(groups: Groups | None = None) -> dict[str, list[int]]:
    """Each identity term's features: the word and its beginnings."""
    terms = _terms(groups)
    made: dict[str, list[int]] = {t: [] for t in terms}
    for words in parsed(pa.array(terms)):
        for feature, i in zip(*features(words), strict=True):
            if feature not in made[term := terms[words.rows][i]]:
                made[term].append(feature)
    return made


@dataclass(frozen=True)
class Weights:
    """Margins of features, sorted by feature; ``swaps``: sentences and terms that the fit has swapped."""

    intercept: float
    features: np.ndarray
    margins: np.ndarray
    swaps: int = 0

    def of(self, words: Words) -> np.ndarray:
        """Scores of the texts of a slice."""
        hashed, text_of = features(words)
        near = np.zeros(1 << 16, bool)
        near[self.features & np.uint64(0xFFFF)] = True
        hit = np.flatnonzero(near[hashed & np.uint64(0xFFFF)])
        place = np.minimum(np.searchsorted(self.features, hashed[hit]), max(0, len(self.features) - 1))
        good = self.features[place] == hashed[hit] if len(self.features) else np.zeros(len(hit), bool)
        size = max(1, len(self.features))
        pairs, times = np.unique(text_of[hit][good] * size + place[good], return_counts=True)
        margin = np.full(len(words.first) - 1, self.intercept)
        if len(pairs):
            np.add.at(margin, pairs // size, self.margins[pairs % size] * np.log2(1 + times))
        return 1 / (1 + np.exp(-np.clip(margin, -60, 60)))


def counted(sample: DataFrame) -> DataFrame:
    """feature, n (documents that have it), bad (of these, the toxic ones)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for words in parsed(batch.column("text")):
                hashed, text_of = features(words)
                order = np.lexsort((text_of, hashed))
                hashed, text_of = hashed[order], text_of[order]
                new = np.ones(len(hashed), bool)
                new[1:] = (hashed[1:] != hashed[:-1]) | (text_of[1:] != text_of[:-1])
                keys, index = np.unique(hashed[new], return_inverse=True)
                bad = np.bincount(index, y[words.rows][text_of[new]], minlength=len(keys))
                n = np.bincount(index, minlength=len(keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(bad.astype(np.int64))],
                    names=["feature", "n", "bad"],
                )

    return sample.select("text", "y").mapInArrow(count, _FEATURES).groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def fit(sample: DataFrame, penalty: float = 0.0001, fairness: float = 1.0, groups: Groups | None = None) -> Weights:
    """Learn from ``sample`` (doc_id, text, y), which must be bounded and stored.

    ``groups`` are words that may stand for each other (default ``IDENTITY_TERMS``; ``proposed_terms`` tells what the sample has
    beside them). Without a sentence that holds one the fit is the plain lasso, and ``swaps`` of the result is 0. ``fairness`` weighs the squared change of the margin, mean over swaps. The driver gets the chosen features and which documents have them.
    """
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("bad")).first()
    n, bad = total["n"], total["bad"]
    empty = np.zeros(0, np.uint64)
    if not n:
        return Weights(0.0, empty, np.zeros(0))
    if bad in (0, n):
        share = (bad + 0.5) / (n + 1)
        return Weights(float(np.log(share / (1 - share))), empty, np.zeros(0))
    expected = F.col("n") * F.lit(bad / n)
    strength = F.abs(F.col("bad") - expected) / F.sqrt(expected + 1)
    chosen = (
        counted(sample)
        .where((F.col("n") >= LEAST_DOCUMENTS) & (strength >= LEAST_STRENGTH))
        .orderBy(strength.desc(), "feature")
        .limit(MOST_FEATURES)
    )
    keys = np.sort(np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64).view(np.uint64))
    groups = IDENTITY_TERMS if groups is None else groups
    terms = {t: np.uint64(h & (1 << 64) - 1) for t, h in term_features(groups).items()}
    keys = np.unique(np.concatenate([keys, np.array(list(terms.values()), np.uint64)]))
    probe = Weights(0.0, keys, np.zeros(len(keys)))
    of_term = {t: int(np.searchsorted(keys, h)) for t, h in terms.items()}

    own: dict[str, list[int]] = {}
    for term, parts in term_parts(groups).items():
        at = np.searchsorted(keys, parts)
        own[term] = [int(i) for i, f in zip(at, parts, strict=True) if i < len(keys) and keys[i] == f]
    # a sentence with a term tells how often it has each feature that a swap of the term can change
    touched = {of_term[t]: sorted({f for group in groups if t in group for o in group for f in own[o]}) for t in own}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_at = np.array(sorted(touched))
        for batch in batches:
            for words in parsed(batch.column("text")):
                hashed, text_of = features(words)
                place = np.minimum(np.searchsorted(probe.features, hashed), len(keys) - 1)
                good = np.flatnonzero(probe.features[place] == hashed)
                pairs, times = np.unique(text_of[good] * len(keys) + place[good], return_counts=True)
                many = np.bincount(pairs // len(keys), minlength=len(words.first) - 1)
                swaps = sentence_swaps(words, probe.features, term_at, touched)
                first = np.concatenate(([0], np.cumsum(many)))
                columns = [
                    pa.array(batch.column("y").to_numpy(zero_copy_only=False)[words.rows]),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(pairs % len(keys), pa.int32())),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(times, pa.int32())),
                    pa.array([swaps, *[[]] * (len(many) - 1)], pa.list_(pa.list_(pa.int64()))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["y", "has", "times", "swaps"])

    rows = sample.select("text", "y").mapInArrow(present, "y double, has array<int>, times array<int>, swaps array<array<long>>").collect()
    x, y, swaps = np.zeros((len(rows), len(keys)), np.float32), np.zeros(len(rows)), Counter()
    for i, row in enumerate(rows):
        x[i, row["has"]] = np.log2(1 + np.array(row["times"], np.float32))
        y[i] = row["y"]
        for count, *sentence in row["swaps"]:
            swaps[tuple(sentence)] += count
    ties = swap_ties(len(keys), of_term, own, swaps, groups)
    intercept, weights = lasso_logistic(x, y, penalty, fairness * ties)
    kept = np.flatnonzero(weights)
    return Weights(intercept, keys[kept], weights[kept], int(sum(swaps.values())))


def sentence_swaps(words: Words, keys: np.ndarray, term_at: np.ndarray, touched: dict[int, list[int]]) -> list[list[int]]:
    """How many sentences, a term they have, and how often they have each feature of ``touched`` for it; one row per kind."""
    if not len(words.starts):
        return []
    text_of = np.repeat(np.arange(len(words.first) - 1), words.counts())
    ends = np.concatenate(([0], np.cumsum(np.isin(words.data, _SENTENCE_ENDS))))[words.starts]
    new = np.flatnonzero((np.diff(text_of) > 0) | (np.diff(ends) > 0)) + 1
    hashed, sentence_of = features(replace(words, first=np.concatenate(([0], new, [len(words.starts)]))))
    wanted = np.array(sorted({f for own in touched.values() for f in own}))
    place = np.minimum(np.searchsorted(keys[wanted], hashed), len(wanted) - 1)
    good = np.flatnonzero(keys[wanted][place] == hashed)
    pairs, times = np.unique(sentence_of[good] * len(wanted) + place[good], return_counts=True)
    kinds: Counter[tuple[int, ...]] = Counter()
    sentence, feature = pairs // len(wanted), wanted[pairs % len(wanted)]
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1]))) if len(pairs) else []
    for a, b in zip(first, [*first[1:], len(pairs)], strict=False):
        has = dict(zip(feature[a:b].tolist(), times[a:b].tolist(), strict=True))
        for term in term_at[np.isin(term_at, feature[a:b])].tolist():
            kinds[term, *(has.get(f, 0) for f in touched[term])] += 1
    return [[n, *kind] for kind, n in kinds.items()]


def swap_ties(
    size: int, of_term: dict[str, int], own: dict[str, list[int]], swaps: dict[tuple[int, ...], float], terms: Groups | None = None
) -> np.ndarray:
    """The form w' T w: the mean over labelled sentences and swaps of the squared change of the margin.

    ``own`` are a term's features; ``swaps`` counts sentences by a term and by how often they have each feature of its groups.
    """
    ties = np.zeros((size, size))
    for (at, *times), count in swaps.items():
        groups = [g for g in (IDENTITY_TERMS if terms is None else terms) if any(of_term[t] == at for t in g)]
        touched = sorted({f for g in groups for t in g for f in own[t]})
        before = np.array(times, float)
        many = before[touched.index(at)]
        for group in groups:
            term = next(t for t in group if of_term[t] == at)
            for other in group:
                if other != term:
                    after = before - many * np.isin(touched, own[term]) + many * np.isin(touched, own[other])
                    change = np.log2(1 + after) - np.log2(1 + before)
                    ties[np.ix_(touched, touched)] += count / (len(group) - 1) * np.outer(change, change)
    return (ties / max(1.0, float(sum(swaps.values())))).astype(np.float32)


def proposed_terms(sample: DataFrame, groups: Groups | None = None, most: int = 50) -> DataFrame:
    """Words of the labelled texts that stand where terms of a group do, for review: term, word, places they share.

    A place is the pair of the words beside. Words of any meaning can share places, slurs too, so nothing is taken into the groups
    by itself. The report is limited to ``most`` words.
    """
    terms = _terms(groups)
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    around = F.expr(
        "transform(sequence(1, greatest(1, size(words) - 2)), i -> struct(get(words, i - 1) as left, get(words, i) as word, get(words, i + 1) as right))"
    )
    placed = sample.select(words.alias("words")).select(F.explode(around).alias("at")).select("at.*").where("right is not null and word <> ''")
    placed = placed.distinct()
    known = placed.where(F.col("word").isin(terms)).withColumnRenamed("word", "term")
    others = placed.where(~F.col("word").isin(terms)).join(known, ["left", "right"])
    counted = others.groupBy("term", "word").agg(F.count("*").alias("places"))
    return counted.orderBy(F.desc("places"), "term", "word").limit(most)


def score(docs: DataFrame, model: Weights) -> DataFrame:
    """doc_id and the score of every document, 0 to 1."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in parsed(batch.column("text")):
                size = words.rows.stop - words.rows.start
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(words.rows.start, size), pa.array(model.of(words))], names=["doc_id", "score"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Weights, threshold: float) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns as they are."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [model.of(words) < threshold for words in parsed(batch.column(at))]
            if low:
                yield batch.filter(pa.array(np.concatenate(low)))

    at = docs.columns.index("text")
    return docs.mapInArrow(kept, docs.schema)


def learn(docs: DataFrame, labels: DataFrame, held_out, most: int, groups: Groups | None = None) -> Weights:
    """Fit on at most ``most`` labelled documents outside ``held_out``; copies of a text count once."""
    sample = labelled_sample(docs, labels, "toxic", held_out, most)
    return fit(stored(sample.dropDuplicates(["text", "y"]), "toxicity-sample"), groups=groups)
