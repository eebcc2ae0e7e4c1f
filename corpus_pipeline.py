"""A training corpus in five stages: from documents to packed sequences.

Each stage reads what the one before has written. All but the last return documents with the columns they came with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.llm import exact, jaccard, mixing, packing, toxicity
from driftwarden.llm.packing_query import vocabulary
from driftwarden.llm.tables import table
from driftwarden.llm.toxicity_query import MOST_LABELS, THRESHOLD
from driftwarden.scratch import folders_made, fresh_folder, remove_folders

#: Exponent of the sources' own sizes in the target weights: 1 keeps them, 0 makes all sources equal.
MIX_EXPONENT = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, learned from the labels of ``documents``."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(False), MOST_LABELS)
    return toxicity.keep_clean(docs, model, THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one that exact dedup keeps."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8."""
    return jaccard.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix: sources stand at their target weights for as long as they last."""
    return mixing.in_order(docs, exponent=MIX_EXPONENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in the sequences, which follow each other in the order of the mix."""
    return packing.pack(docs, vocabulary(), in_order=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage has kept on its way, and the result of the stage before it, goes once its own result is written.
    """
    docs, since = table(spark, sf_dir, "documents"), folders_made()
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = fresh_folder(spark, f"pipeline-{name}")
        made.write.parquet(path)
        remove_folders(spark, since, keep=(path,))
        docs = spark.read.parquet(path)
    return docs


#: The first stage is a learned classifier, which SQL does not express.
ORACLE_SQL = None
