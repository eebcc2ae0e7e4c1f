"""op8: near copies among ``embeddings`` of one label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwarden.llm import vectors
from driftwarden.llm.tables import table


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


QUERIES = {"op8_near_vectors": op8_near_vectors}

SQL = {
    "op8_near_vectors": """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    ), u AS (
      SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
      WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), g AS (
      SELECT * FROM u WHERE norm > 0 AND isfinite(norm)
    ), links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
    ), reach AS (
      SELECT a AS v, a AS r FROM links UNION SELECT b, r FROM reach JOIN links ON v = a WHERE r < b
    ), least AS (
      SELECT v, min(r) AS component_id FROM reach GROUP BY v
    ), counts AS (
      SELECT a AS v, count(*) AS n FROM links GROUP BY a
    )
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
      coalesce(component_id, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN counts c ON c.v = vec_id LEFT JOIN least l ON l.v = vec_id
    """
}
