"""op7: the language of every document of ``documents``, learned from two thirds of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwarden.llm import langid
from driftwarden.llm.labelled import remainder
from driftwarden.llm.tables import table


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.build(langid.sample(docs, remainder(3) != 1))
    return langid.predict(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
SQL: dict[str, str] = {}
