"""op5: ``documents`` scored for toxicity as ``labels`` marks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.llm import toxicity
from driftwarden.llm.labelled import remainder
from driftwarden.llm.tables import table

#: Labelled rows that the weights are learned from, at most.
MOST_LABELS, THRESHOLD = 12_000, 0.3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), remainder(4) == 2, MOST_LABELS)
    return toxicity.score(docs, model).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score",
        F.expr(f"cast(score >= {THRESHOLD} as int)").alias("predicted"),
    )


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
