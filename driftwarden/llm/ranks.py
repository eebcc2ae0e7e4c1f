"""Running totals per key over any number of rows, without a group or a task that grows with a key.

Rows are range partitioned by (key, hash of id, id), so a key with a third of the rows spreads over many
partitions. Each partition adds up what it holds of a key; the totals of the partitions, at most one row
per partition and key change, give every partition its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.llm.tables import stored

_KEY, _ID, _WEIGHT, _PART, _AT = "rank_key", "rank_id", "rank_weight", "rank_part", "rank_at"


def running(
    rows: DataFrame, key: str, number: str, weight: str | None = None, name: str = "rank", in_order: bool = False
) -> DataFrame:
    """(key, number, name): the sum of ``weight`` (default: 1 a row) over the rows of the same key that come before.

    ``key`` must not be null; ``number`` tells rows apart and orders them by its hash, or with ``in_order`` by itself. Rows equal in both
    follow each other. The result is stored, so positions are the same for every reader.
    """
    light = rows.select(
        F.col(key).alias(_KEY), F.col(number).alias(_ID), (F.col(weight) if weight else F.lit(1)).cast("long").alias(_WEIGHT)
    )
    order = [_KEY, _ID] if in_order else [_KEY, F.xxhash64(_ID), _ID]
    kind = light.schema[_KEY].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = light.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = stored(
        sorted_rows.mapInArrow(
            _within, f"{_KEY} {kind}, {_ID} {light.schema[_ID].dataType.simpleString()}, {_WEIGHT} long, {_PART} int, {_AT} long"
        ),
        "running",
    )
    totals = local.groupBy(_KEY, _PART).agg(F.sum(_WEIGHT).alias("held"))
    before = Window.partitionBy(_KEY).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        totals.select(_KEY, _PART, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start")), "running-starts"
    )
    return local.join(starts, [_KEY, _PART]).select(
        F.col(_KEY).alias(key), F.col(_ID).alias(number), (F.col(_AT) + F.col("start")).alias(name)
    )


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, carried = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(_KEY)
        weights = batch.column(_WEIGHT).to_numpy(zero_copy_only=False)
        change = np.ones(n, bool)
        if n > 1:
            change[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        change[0] = keys[0].as_py() != last
        total = np.cumsum(weights) - weights
        heads = np.flatnonzero(change)
        base = np.zeros(n, np.int64)
        if len(heads):
            base[heads[0] :] = np.repeat(total[heads], np.diff(np.append(heads, n)))
        at = total - base
        open_run = heads[0] if len(heads) else n
        at[:open_run] += carried
        carried, last = int(at[-1] + weights[-1]), keys[n - 1].as_py()
        yield pa.RecordBatch.from_arrays(
            [keys, batch.column(_ID), batch.column(_WEIGHT), pa.array(np.full(n, part), pa.int32()), pa.array(at)],
            names=[_KEY, _ID, _WEIGHT, _PART, _AT],
        )
