"""JSON lines: one text column per key ever seen, with the token types kept for inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.options import Options
from driftwarden.sources.batching import numbered, placed_in_files
from driftwarden.sources.delimited import checked_choice, file_batch, unread_lines
from driftwarden.sources.pieces import BAD, BATCH, TOKENS, Piece, safe_name, tag

_LINE = "_line"
MALFORMED_MODES = {"fail": "FAILFAST", "quarantine": "PERMISSIVE"}


def json_text(spark: SparkSession, path: str | list[str], place: bool = False) -> DataFrame:
    """Non-blank lines and the file they are from, with ``place`` also where they were read."""
    lines = spark.read.text(path).where(F.length(F.trim("value", F.lit(" \t\r\n"))) > 0)
    lines = lines.select(F.col("value").alias(_LINE), file_batch().alias(BATCH), "_metadata")
    return (numbered(lines) if place else lines).drop("_metadata")


def tokens(mode: str = "FAILFAST"):
    """The record as key -> variant; a line that is not a JSON object fails the load, or is null."""
    return F.from_json(_LINE, "map<string,variant>", {"mode": mode})


#: Keys that become columns, at most.
MOST_KEYS = 2000
#: The column of all other keys and their values, as JSON text.
REST = "_other_keys"


def keys_of(lines: DataFrame, mode: str = "FAILFAST", most: int = MOST_KEYS) -> tuple[list[str], bool]:
    """The ``most`` commonest keys over all lines in the order of their names, and whether there are others; with map-side combine."""
    counted = lines.select(F.explode(F.map_keys(tokens(mode))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = [row["key"] for row in counted.orderBy(F.desc("n"), "key").limit(most + 1).collect()]
    return sorted(found[:most]), len(found) > most


def key_values(keys: list[str], others: bool) -> list[Column]:
    """A text column for each key, and one for what the others hold."""
    values = [F.try_element_at(TOKENS, F.lit(k)).cast("string").alias(safe_name(k)) for k in keys]
    if others:
        rest = F.map_filter(TOKENS, lambda k, v: ~k.isin(*keys))
        values.append(F.when(F.size(rest) > 0, F.to_json(rest)).alias(REST))
    return values


def json_lines(
    spark: SparkSession, path: str | list[str], source_name: str, batch_rows: int | None = None, on_malformed: str = "fail",
    most_keys: int = MOST_KEYS,
) -> list[Piece]:
    """One piece; a batch has the columns that at least one of its records has.

    Keys beyond the ``most_keys`` commonest are no columns: what a record has of them is JSON text in the column ``REST``.

    A batch is a file, or ``batch_rows`` consecutive lines when given. A line that is no JSON object fails the load, or goes
    to quarantine with its file and its place among the records there (``on_malformed="quarantine"``).
    """
    mode = MALFORMED_MODES[checked_choice(on_malformed)]
    keys, others = keys_of(json_text(spark, path), mode, most_keys)
    lines = placed = None
    if batch_rows is not None or on_malformed == "quarantine":
        lines = json_text(spark, path, place=True)
        (placed,) = placed_in_files([lines.drop(BATCH) if batch_rows is not None else lines], Options(), batch_rows)
    if batch_rows is not None:
        lines = placed
    elif lines is None:
        lines = json_text(spark, path)
    parsed = lines.withColumn(TOKENS, tokens(mode))
    values = key_values(keys, others)
    bad, malformed = [], None
    if on_malformed == "quarantine":
        bad = [F.col(TOKENS).isNull().alias(BAD)]
        malformed = tag(unread_lines(placed, tokens(mode).isNull()), source_name, F.col(BATCH))
    frame = tag(parsed.select(BATCH, TOKENS, *bad, *values), source_name, F.col(BATCH))
    inferred = dict.fromkeys(map(safe_name, keys), "json") | ({REST: "rest"} if others else {})
    return [Piece(frame, inferred, malformed=malformed)]
