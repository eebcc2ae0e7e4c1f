"""Batches of n consecutive rows, without ever putting the rows in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from driftwarden.operators.joins import bounded_join
from driftwarden.options import Options
from driftwarden.scratch import cut

_PLACE = "_place"
_PLACE_BITS = 33  # monotonically_increasing_id keeps the row's place in the low 33 bits


def positions(frame: DataFrame, name: str, order_by: list[str | Column]) -> DataFrame:
    """Add ``name`` = 0-based position of the row in the total order, equal keys in input order.

    Rows are range partitioned and sorted, the input place being the last key so that a hot key
    still spreads over partitions, and then frozen in the shared folder: range cuts come from a
    sample, so counting and numbering must read the same materialised partitions. What is joined
    back is one row per partition.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order_by] + [F.col(_PLACE)]
    placed = frame.withColumn(_PLACE, F.monotonically_increasing_id())
    frozen = cut(placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(_PLACE))

    numbered = frozen.withColumn(_PLACE, F.monotonically_increasing_id())
    part = F.shiftright(_PLACE, _PLACE_BITS)
    # one row per task of the frozen frame, so this single-partition window stays small
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.col(_PLACE).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        numbered.withColumns({"_part": part, _PLACE: place})
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col(_PLACE))
        .drop(_PLACE, "_part", "_offset")
    )


def in_rows(frame: DataFrame, size: int, order_by: list[str | Column]) -> DataFrame:
    """Add ``_batch``: consecutive runs of ``size`` rows, the last one shorter."""
    if size < 1:
        raise ValueError("size must be positive")
    numbered = positions(frame, "_position", order_by)
    return numbered.withColumn("_batch", F.expr(f"_position div {size}")).drop("_position")


FILE, BLOCK, NUMBER, AT = "_file", "_block", "_n", "_at"


def numbered(lines: DataFrame) -> DataFrame:
    """Add where a record was read: its file, the split of the file, and its number in the scan."""
    place = {FILE: F.col("_metadata.file_path"), BLOCK: F.col("_metadata.file_block_start")}
    return lines.withColumns({**place, NUMBER: F.monotonically_increasing_id()})


def placed_in_files(layouts: list[DataFrame], options: Options, size: int | None = None) -> list[DataFrame]:
    """Add ``_at``, the 1-based place of a record in its file, and with ``size`` the batch of so many consecutive records.

    ``layouts`` are ``numbered`` scans of different files. A split of a file is read by one task, so a record's place in the split is the
    distance from its first number, and an index of one row per split tells how many records come before it: no record moves and
    none is frozen. Files follow each other by path. A batch holds records of one layout: where the next file has another, a
    new batch begins.
    """
    def counted(layout: int, lines: DataFrame) -> DataFrame:
        of_split = lines.groupBy(FILE, BLOCK).agg(F.min(NUMBER).alias("_first"), F.count(F.lit(1)).alias("_size"))
        return of_split.withColumn("_layout", F.lit(layout))

    index = reduce(DataFrame.unionByName, [counted(k, lines) for k, lines in enumerate(layouts)])
    if size is None:
        before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        starts = cut(index.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))))
        return [_joined(lines, starts.where(F.col("_layout") == k), options).drop("_row") for k, lines in enumerate(layouts)]
    # one row per split: these windows over all of them stay small
    order = Window.orderBy(FILE, BLOCK)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    changed = F.coalesce((F.col("_layout") != F.lag("_layout").over(order)).cast("int"), F.lit(0))
    runs = index.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("_run").orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    held = runs.groupBy("_run").agg(F.expr(f"cast(ceil(sum(_size) / {size}) as bigint)").alias("_batches"))
    bases = held.select("_run", F.coalesce(F.sum("_batches").over(before.orderBy("_run")), F.lit(0)).alias("_base"))
    starts = runs.withColumns({
        "_row": F.coalesce(F.sum("_size").over(in_run), F.lit(0)), "_offset": F.coalesce(F.sum("_size").over(in_file), F.lit(0)),
    }).join(bases, "_run")
    starts = cut(starts.select(FILE, BLOCK, "_first", "_layout", "_row", "_offset", "_base"))
    batch = F.expr(f"_base + (_row + {NUMBER} - _first) div {size}")
    return [
        _joined(lines, starts.where(F.col("_layout") == k), options, {"_batch": batch}).drop("_row", "_base") for k, lines in enumerate(layouts)
    ]


def _joined(lines: DataFrame, starts: DataFrame, options: Options, more: dict[str, Column] | None = None) -> DataFrame:
    placed = bounded_join(lines, starts.drop("_layout", "_size"), [FILE, BLOCK], options)
    return placed.withColumns({AT: F.expr(f"_offset + {NUMBER} - _first + 1"), **(more or {})}).drop("_first", "_offset", NUMBER)
