"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(parts: int, number: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(number).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """doc_id, text and the label y of at most ``most`` labelled rows that are not held out, chosen by a hash of the id.

    The labels are cut to the bound before they meet the documents, so the side that is broadcast has ``most`` rows.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
        .select("doc_id", F.col(label).cast("double").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
