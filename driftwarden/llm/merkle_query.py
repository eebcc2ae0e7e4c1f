"""op12: the manifest of ``documents``, checked against leaves of which a fifth has been tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.llm import merkle
from driftwarden.llm.tables import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The SQL unrolls so many levels of a source's tree, and of the tree of subroots.
_LEVELS, _TOP_LEVELS = 6, 3


def tampered():
    """The leaf to be checked: where 5 divides the crc32 of the id, that of a text brought to small letters."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, merkle.leaf_digest(F.translate("text", _UPPER, _LOWER))).otherwise(merkle.leaf_digest())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered()).withColumnRenamed("proof", "proof_sha256")


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}


def _tree(name: str, levels: int) -> str:
    """Levels of the trees in table ``name``_0 (tree, pos, digest, n), and the runs of each level as one text."""
    made = []
    for k in range(levels):
        made.append(f"""{name}_runs_{k} AS MATERIALIZED (
          SELECT tree, pos // 16 AS pos, n, string_agg(digest, '' ORDER BY pos) AS run FROM {name}_{k} GROUP BY tree, pos // 16, n
        ), {name}_{k + 1} AS MATERIALIZED (
          SELECT tree, pos, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS digest, (n + 15) // 16 AS n FROM {name}_runs_{k}
        )""")
    return ", ".join(made)


def _ways(name: str, levels: int, first: str, tree: str, at: str) -> tuple[str, str]:
    """Steps that fold ``cur`` and gather ``proof`` along a tree's runs; the name of the last."""
    made, before = [], first
    for k in range(levels):
        place, run = f"({at} // {16**k})", f"{name}_way_{k}"
        left, right = f"substr(r.run, 1, 64 * ({place} % 16))", f"substr(r.run, 64 * ({place} % 16) + 65)"
        made.append(f"""{run} AS MATERIALIZED (
          SELECT d.* EXCLUDE (proof, cur), CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof,
            CASE WHEN r.n > 1 THEN sha256({left} || cur || {right}) ELSE cur END AS cur
          FROM {before} d JOIN {name}_runs_{k} r ON r.tree = {tree} AND r.pos = {place} // 16
        )""")
        before = run
    return ", ".join(made), before


def _sql() -> str:
    def field(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(text if c == "text" else c) for c in merkle.FIELDS) + ")"

    crc = (
        "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),"
        " lambda s, b: list_reduce(list_prepend(xor(s, b), [CAST(i AS BIGINT) FOR i IN range(8)]), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"
    )
    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    low, end = _ways("s", _LEVELS, "d0", "d.tree", "d.pos")
    top, last = _ways("t", _TOP_LEVELS, end, "0", "d.tree")
    return f"""
    WITH hashed AS MATERIALIZED (
      SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS given FROM documents
    ), placed AS MATERIALIZED (
      SELECT doc_id, leaf, given, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM hashed
    ), s_0 AS (SELECT tree, pos, leaf AS digest, n FROM placed), {_tree("s", _LEVELS)},
    t_0 AS (SELECT 0 AS tree, tree AS pos, digest, count(*) OVER () AS n FROM s_{_LEVELS}), {_tree("t", _TOP_LEVELS)},
    d0 AS (SELECT *, '' AS proof, given AS cur FROM placed), {low}, {top}
    SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.digest AS verified
    FROM {last} d JOIN s_{_LEVELS} s ON s.tree = d.tree CROSS JOIN t_{_TOP_LEVELS} t
    """


SQL = {"op12_merkle_manifest": _sql()}
