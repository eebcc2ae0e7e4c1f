"""op1: groups of equal texts in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.llm import exact
from driftwarden.llm.tables import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", exact.row_of(), F.sha2(exact.normalised().cast("binary"), 256).alias("text_sha256"))
    return exact.marked(rows, exact.equal_groups(docs))


QUERIES = {"op1_exact_dedup": op1_exact_dedup}

SQL = {
    "op1_exact_dedup": r"""
    WITH t AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
    ), ranked AS (
      SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY body) AS group_size FROM t
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM ranked
    """
}
