"""op9: repeated windows cut out of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwarden.llm import substring
from driftwarden.llm.tables import table


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup_substrings(table(spark, sf_dir, "documents"), digest=True)
    return kept.withColumnRenamed("kept", "kept_sha256")


QUERIES = {"op9_substring_dedup": op9_substring_dedup}

SQL = {
    "op9_substring_dedup": r"""
    WITH t AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), p AS (
      SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM t WHERE len(w) >= 13
    ), g AS (
      SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS body FROM p
    ), r AS (
      SELECT doc_id, i, min(doc_id) OVER (PARTITION BY body) < doc_id AS gone FROM g
    ), c AS (
      SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM r WHERE gone
    ), k AS (
      SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t
    ), l AS (
      SELECT k.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY k.i) FILTER (c.i IS NULL) AS kept
      FROM k LEFT JOIN c ON k.doc_id = c.doc_id AND k.i = c.i GROUP BY k.doc_id
    )
    SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
      sha256(coalesce(kept, '')) AS kept_sha256
    FROM t LEFT JOIN l USING (doc_id)
    """
}
