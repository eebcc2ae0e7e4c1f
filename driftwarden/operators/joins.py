"""Joining rows to facts about them: broadcast while small, shuffled beyond that, with a salt where keys are hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.options import Options

_SALT = "_salt"
SALTS = 32  # parts that the rows of one key are spread over


def size_of(frame: DataFrame) -> int:
    """Bytes of a frame written as JSON text, an upper bound for what a broadcast of it holds."""
    return frame.select(byte_bound()).first()[0]


def byte_bound() -> Column:
    return F.expr("coalesce(sum(cast(octet_length(to_json(struct(*))) as bigint) + 16), 0)")


def bounded_join(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    options: Options,
    how: str = "inner",
    at_most: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Join many ``rows`` to ``facts`` (unique on ``keys``, already materialised).

    ``at_most`` is a byte bound of the facts where one is known; otherwise they are measured.

    Below the byte limit the facts are broadcast and the rows do not move. Above it both sides are
    shuffled with a salt, the facts being repeated once per salt, so that one key holding a third
    of the rows still spreads over many tasks. Facts with a key of their own for almost every row are not repeated (``salts=1``).

    Beyond the limit the merge join is asked for by name: Spark estimates the size of facts from the files they come from, does not
    see how often they are repeated, and would broadcast them after all.
    """
    size = size_of(facts) if at_most is None else at_most
    if size <= options.broadcast_limit_bytes:
        return rows.join(F.broadcast(facts), keys, how)
    if salts == 1:
        return rows.join(facts.hint("merge"), keys, how)
    salted_rows = rows.withColumn(_SALT, (F.monotonically_increasing_id() % salts).cast("int"))
    salted_facts = facts.withColumn(_SALT, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return salted_rows.join(salted_facts.hint("merge"), [*keys, _SALT], how).drop(_SALT)
