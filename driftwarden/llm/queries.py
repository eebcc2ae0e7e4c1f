"""All queries of this folder and their SQL, by name."""

from __future__ import annotations

from driftwarden.llm import (
    chat_query,
    exact_query,
    jaccard_query,
    langid_query,
    merkle_query,
    mixing_query,
    negatives_query,
    packing_query,
    private_query,
    quality_query,
    substring_query,
    toxicity_query,
    vectors_query,
)

_MODULES = [exact_query, jaccard_query, mixing_query, quality_query, toxicity_query, packing_query, langid_query, vectors_query, substring_query, chat_query, negatives_query, merkle_query, private_query]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
