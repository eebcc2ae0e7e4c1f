"""op11: hard negatives among all ``embeddings`` for the anchors whose id a hundred divides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.llm import negatives
from driftwarden.llm.tables import table


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("if(vec_id % 7 = 0, (cast(label as bigint) + 1) % 10, label)")
    rows = negatives.usable(table(spark, sf_dir, "embeddings"), label)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}

SQL = {
    "op11_hard_negatives": """
    WITH v AS MATERIALIZED (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), met AS MATERIALIZED (
      SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
        CASE WHEN len(a.e) = 0 THEN 0 ELSE CAST(list_dot_product(a.e, b.e) AS BIGINT) END AS score
      FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ), positives AS (
      SELECT anchor_id, other AS positive_id, score AS positive_score FROM met WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
    )
    SELECT anchor_id, positive_id,
      CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
      other AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN met m USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5
    """
}
