"""Exact dedup by distributed MSD radix partitioning.

Documents are split by the successive bytes of their normalised text. A digit of a level is a run of bytes,
longer at every level, so that texts of any length take few levels. A level counts (group, digit) pairs,
with a partial count before the shuffle; documents alone with their digit are done, those whose text ended
within it are equal, and the rest go on with their remaining bytes. Bytes are compared as they are; no digest
decides equality.

A group of copies may hold a third of all rows: counting sees it as one row per map task, and the join that
hands the group number back has nothing but shuffles below it, so Spark splits its large partitions.

Defined results: a null text is empty, empty texts are equal to each other. Of equal texts the row with the most code points,
then the smallest doc_id, stays. Rows that share a doc_id but not the text are documents of their own, told apart by a hash beside the id; rows
that share both are counted, and stay or go together. A row without a doc_id is compared with none and stays. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.tables import stored

#: Deleted before texts are compared: the space and the control signs from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
FIRST_DIGIT, GROWTH, WIDEST = 32, 16, 1 << 20


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")


def row_of():
    """What an answer is given back to: the id and two hashes of the text, which tell the texts of one id apart."""
    body = normalised().cast("binary")
    return F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), F.xxhash64(body, F.lit(1)).alias("other")
    ).alias("row")


def equal_groups(
    docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH, widest: int = WIDEST
) -> DataFrame:
    """Documents that share their text with another: row (``row_of``), keep_id, group_size."""
    rows = docs.where("doc_id is not null").select(row_of(), normalised().cast("binary").alias("rest"), F.length("text").alias("points"))
    start = F.expr("named_struct('doc_id', 0L, 'mark', 0L, 'other', 0L)").alias("part")
    live = rows.select("row", start, "rest", F.coalesce("points", F.lit(0)).alias("points"))
    width, found = first_digit, []
    while True:
        dealt = live.select(
            "row", "part", "points",
            F.expr(f"substring(rest, 1, {width})").alias("digit"),
            F.expr(f"octet_length(rest) < {width}").alias("ended"),
            F.expr(f"substring(rest, {width + 1})").alias("rest"),
        )
        # a group is named by its least row: texts that share an id lie in different groups
        shared = stored(
            dealt.groupBy("part", "digit", "ended")
            .agg(
                F.count("*").alias("group_size"),
                F.min("row").alias("next_part"),
                F.max(F.struct("points", (-F.col("row.doc_id")).alias("id"))).alias("best"),
            )
            .where("group_size > 1")
            .selectExpr("part", "digit", "ended", "group_size", "next_part", "-best.id as keep_id"),
            "radix-groups",
        )
        met = dealt.join(shared.hint("merge"), ["part", "digit", "ended"])
        met = stored(
            met.selectExpr(
                "row", "next_part as part", "if(ended, null, rest) as rest", "points", "ended", "keep_id", "group_size"
            ),
            "radix-rows",
        )
        found.append(met.where("ended").select("row", "keep_id", "group_size"))
        live = met.where("not ended").select("row", "part", "rest", "points")
        if not live.take(1):
            break
        width = min(width * growth, widest)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("row").agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, **digits: int) -> DataFrame:
    """Every document: doc_id, keep_id, group_size, kept."""
    return marked(docs.select("doc_id", row_of()), equal_groups(docs, **digits))


def marked(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` (doc_id, row and whatever the caller adds) with keep_id, group_size and kept."""
    own = [c for c in rows.columns if c not in ("doc_id", "row")]
    return rows.join(copies, "row", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.expr("coalesce(keep_id, doc_id) <=> doc_id").alias("kept"),
        *own,
    )


def drop_copies(docs: DataFrame, **digits: int) -> DataFrame:
    """The documents that stay, with all their columns. Only the rows to drop move with the documents."""
    gone = equal_groups(docs, **digits).where("row.doc_id <> keep_id").select(F.col("row").alias("_gone"))
    own = docs.select(*docs.columns, row_of().alias("_row"))
    return own.join(gone, own["_row"] == gone["_gone"], "left_anti").select(*docs.columns)
