"""op2: groups of ``documents`` by their 4-word shingles, 85 in a hundred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwarden.llm import jaccard
from driftwarden.llm.tables import table


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"), jaccard.Shingles(words=4, percent=85))


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
SQL: dict[str, str] = {}
