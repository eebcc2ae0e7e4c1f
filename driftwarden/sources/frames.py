"""Frames as sources, and the choice of a source by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.sources.batching import in_rows
from driftwarden.sources.delimited import delimited
from driftwarden.sources.json_lines import json_lines
from driftwarden.sources.pieces import BATCH, Piece, safe_name, tag, with_safe_names

_KEY = "data:batch key"
SOURCES = ("csv", "jsonl", "dataframe")


def frame_pieces(
    frame: DataFrame,
    source_name: str,
    batch_by: Column | None = None,
    batch_rows: int | None = None,
    order_by: list[str] | None = None,
) -> list[Piece]:
    """A frame as one batch, batches by expression, or consecutive rows in the given order.

    Columns with a name that the load uses itself are set apart (``safe_name``) and get it back in the sink.
    """
    if batch_rows is not None:
        order = [safe_name(k) if isinstance(k, str) else k for k in order_by or []]
        return [Piece(tag(in_rows(with_safe_names(frame), batch_rows, order), source_name, F.col(BATCH)))]
    if batch_by is None:
        return [Piece(tag(with_safe_names(frame), source_name))]
    keyed = with_safe_names(frame.withColumn(_KEY, batch_by))
    return [Piece(tag(keyed, source_name, F.col(_KEY)).drop(_KEY))]


def pieces_of(
    spark: SparkSession,
    source_type: str,
    source_name: str,
    path: str | list[str] | None = None,
    frame: DataFrame | None = None,
    batch_rows: int | None = None,
    **how,
) -> list[Piece]:
    if source_type == "csv":
        return delimited(spark, path, source_name, batch_rows, **how)
    if source_type == "jsonl":
        return json_lines(spark, path, source_name, batch_rows, **how)
    if source_type == "dataframe":
        return frame_pieces(frame, source_name, batch_rows=batch_rows, **how)
    raise ValueError(f"unknown source type: {source_type!r}")
