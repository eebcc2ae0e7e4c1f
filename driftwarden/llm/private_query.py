"""op13: personal data in ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.llm import private
from driftwarden.llm.tables import table


def _told(spans: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*map(F.lit, private.KINDS))
    one = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(private.KINDS, 1)]
    return found.select("doc_id", *counts, F.sha2(_told("base").cast("binary"), 256).alias("base_sha256"), _told("spans").alias("spans"))


QUERIES = {"op13_private_data": op13_private_data}
#: The added spans are learned, which SQL does not express; tests hold the base spans against the plain patterns.
SQL: dict[str, str] = {}
