"""Delimited files as text columns, grouped by header so that values follow their names."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.functions.sql import literal, named, words
from driftwarden.operators.joins import bounded_join
from driftwarden.options import Options
from driftwarden.scratch import cut
from driftwarden.sources.batching import AT, numbered, placed_in_files
from driftwarden.sources.pieces import BAD, BATCH, Piece, safe_name, tag

# The words that mean a missing value in a delimited file.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: The value after the last, one more, and the line as it stands.
_EXTRA, _SPARE, _CORRUPT = "_beyond_header", "_beyond_header_2", "_corrupt_line"


def file_batch():
    """Batch key "one file": by modification time, then by path."""
    return F.concat_ws(
        " ",
        F.date_format("_metadata.file_modification_time", "yyyyMMdd'T'HHmmss.SSS"),
        "_metadata.file_path",
    )


def _header_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line): the first line of every file, told by its place in the file.

    The places are found first: the line itself in that aggregate would make Spark sort all lines of a task.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    # only the first split of a file can hold its header
    lines = lines.where("block = 0")
    first = cut(lines.groupBy("file").agg(F.min("place").alias("place")))
    return bounded_join(lines, first, ["file", "place"], Options(), salts=1).select("file", F.col("value").alias("line"))


def _split(line: str) -> list[str]:
    return next(csv.reader([line]), [""])


def column_names(header: list[str]) -> list[str]:
    """Names of the columns: an empty one is named by its place, a repeated one gets a number."""
    names: list[str] = []
    for place, name in enumerate(header):
        wanted = name or f"Unnamed: {place}"
        made, count = wanted, 0
        while made in names:
            count += 1
            made = f"{wanted}.{count}"
        names.append(made)
    return names


def _tidy(value: str) -> Column:
    """A value, or null for a missing-value word."""
    return F.expr(f"CASE WHEN {value} NOT IN ({words(MISSING)}) THEN {value} END")


def _checked(value: str, problem: str) -> str:
    """A value, or an error where the line is too long."""
    message = "concat('more values than columns in ', _metadata.file_path)"
    return f"coalesce(CASE WHEN {problem} THEN CAST(raise_error({message}) AS string) END, {value})"


#: Rows, the columns as read with the names they get, and the condition "line too long".
Layout = tuple[DataFrame, list[tuple[str, str]], str]


def _mixed(spark: SparkSession, path: str | list[str], options: dict[str, str]) -> list[Layout]:
    """One layout per distinct header; the headers cost two plain scans of the text."""
    lines = cut(_header_lines(spark, path))  # a row per file: the text is scanned twice, however many layouts there are
    layouts = sorted(row["line"] for row in lines.select("line").distinct().collect())
    found = []
    for line in layouts:
        names = column_names(_split(line))
        columns = [(f"c{i}", name) for i, name in enumerate(names)]  # read by place: names may repeat in the header
        files: str | list[str] = path
        if len(layouts) > 1:
            files = [row["file"] for row in lines.where(F.col("line") == line).select("file").collect()]
        # a value under the extra name is one more than the header has; the spare column is never read, so the reader always
        # picks columns, which spares it an exception for every line that has no extra value
        shape = _text_columns([*(c for c, _ in columns), _EXTRA, _SPARE, _CORRUPT])
        rows = spark.read.schema(shape).options(**options, columnNameOfCorruptRecord=_CORRUPT).csv(files)
        found.append((rows, columns, f"{_EXTRA} IS NOT NULL"))
    return found


def _same(spark: SparkSession, path: str | list[str], options: dict[str, str]) -> list[Layout]:
    """The one layout of files that all have the first one's header; another header is an error."""
    first = spark.read.text(path).first()
    if first is None:
        return []
    columns = _split(first["value"])
    rows = (
        spark.read.schema(_text_columns([*columns, _CORRUPT]))
        .options(**options, enforceSchema="false", columnNameOfCorruptRecord=_CORRUPT)
        .csv(path)
    )
    # both shorter and longer lines are reported: only those are parsed again to tell them apart
    shape = literal(_text_columns([*columns, _EXTRA]).toDDL())
    again = f"""from_csv({_CORRUPT}, {shape}, map('quote', '"', 'escape', '"'))"""
    return [(rows, [(c, c) for c in columns], f"{_CORRUPT} IS NOT NULL AND {again}.{_EXTRA} IS NOT NULL")]


def _text_columns(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def checked_choice(on_malformed: str) -> str:
    if on_malformed not in ("fail", "quarantine"):
        raise ValueError("on_malformed must be fail or quarantine")
    return on_malformed


def delimited(
    spark: SparkSession,
    path: str | list[str],
    source_name: str,
    batch_rows: int | None = None,
    multi_line: bool = False,
    headers: str = "mixed",
    on_malformed: str = "fail",
) -> list[Piece]:
    """One piece per distinct header; every column is text whose bucket is inferred per batch.

    A batch is a file, or ``batch_rows`` consecutive rows when given. A line with more values than
    its header fails the load, or goes to quarantine with its file and its place among the records there (``on_malformed="quarantine"``);
    a shorter one is filled with nulls. ``headers="same"`` saves the
    scan for headers where all files are known to share one, and fails on a file that does not.
    """
    if headers not in ("mixed", "same"):
        raise ValueError("headers must be mixed or same")
    options = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
               "multiLine": str(multi_line).lower()}
    layouts = (_mixed if headers == "mixed" else _same)(spark, path, options)
    unread = checked_choice(on_malformed) == "quarantine"
    scans = [_values(rows, columns, problem, unread) for rows, columns, problem in layouts]
    placed: list[DataFrame | None] = [None] * len(scans)
    if (unread or batch_rows is not None) and scans:
        placed = list(placed_in_files([numbered(scan) for scan in scans], Options(), batch_rows))
    pieces = []
    for (_, columns, _), scan, at in zip(layouts, scans, placed, strict=True):
        names = [safe_name(name) for _, name in columns]
        lines = scan if batch_rows is None else at
        batch = file_batch().alias(BATCH) if batch_rows is None else F.col(BATCH)
        frame = lines.select(batch, *([BAD] if unread else []), *map(named, names))
        malformed = None
        if unread:
            with_batch = at if batch_rows is not None else at.withColumn(BATCH, file_batch())
            malformed = tag(unread_lines(with_batch, F.col(BAD)), source_name, F.col(BATCH))
        pieces.append(Piece(tag(frame, source_name, F.col(BATCH)), dict.fromkeys(names, "text"), malformed=malformed))
    return pieces


def _values(rows: DataFrame, columns: list[tuple[str, str]], problem: str, unread: bool) -> DataFrame:
    """The values of a layout under their names; a line that is too long is an error, or has none and is marked."""
    (head, _), *_ = columns
    made = []
    for column, name in columns:
        value = named(column)
        if unread:
            value = f"CASE WHEN NOT ({problem}) THEN {value} END"
        elif column == head:
            value = _checked(value, problem)  # the check rides on the first column, which pass 1 always reads
        made.append(_tidy(value).alias(safe_name(name)))
    marks = [F.expr(problem).alias(BAD), F.expr(_line(columns, rows)).alias("_line")] if unread else []
    return rows.select(*made, *marks, "_metadata")


def unread_lines(placed: DataFrame, bad: Column) -> DataFrame:
    """Batch, line, file and place of the lines that could not be read."""
    return placed.where(bad).select(BATCH, F.col("_line").alias("line"), F.col("_file").alias("file"), F.col(AT).alias("place"))


def _line(columns: list[tuple[str, str]], rows: DataFrame) -> str:
    """The text of a line that is too long: as it stands, or where it has as many values as there are columns to read, joined again."""
    values = ", ".join(named(c) for c, _ in columns)
    extra = f", {_EXTRA}, {_SPARE}" if _EXTRA in rows.columns else ""
    again = f"""to_csv(struct({values}{extra}), map('quote', '"', 'escape', '"'))"""
    return f"coalesce({_CORRUPT}, {again})" if _CORRUPT in rows.columns else again
