"""op4: ``documents`` scored for quality as ``labels`` marks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.llm import quality
from driftwarden.llm.labelled import labelled_sample, remainder
from driftwarden.llm.tables import stored, table

#: Labelled rows that the rules are learned from, at most.
MOST_LABELS = 12_000


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    sample = labelled_sample(docs, labels, "quality", remainder(3) == 1, MOST_LABELS)
    model = quality.fit(stored(sample, "quality-sample"))
    return quality.score(docs, model).select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted")
    )


QUERIES = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
