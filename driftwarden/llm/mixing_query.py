"""op3: ``documents`` mixed to the tempered weights of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwarden.llm import mixing
from driftwarden.llm.tables import table


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op3_mix_sources": op3_mix_sources}
SQL: dict[str, str] = {}
