"""The fold: batch summaries in order -> what is expected of, and decided about, each batch.

A healed batch can change the schema the next batch is compared with, so the decision is
sequential within a source. It runs over one summary per batch, never over rows, and it is not
tied to one task per source either: summaries are range partitioned by (source, batch), every
partition is folded at once from an assumed starting schema, and partitions whose true start (the
end of the one before) turns out different are folded again. Schemas settle quickly, so this mostly takes
a round or two. Where every partition changes the schema it would take one for each: after ``ROUNDS``, one task walks
the summaries that are left in plain order and tells where each partition begins, so the number of jobs is
bounded whatever the data. What the driver sees is one end state per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftwarden.functions.buckets import COERCIBLE, STRING, UNKNOWN
from driftwarden.operators.joins import bounded_join
from driftwarden.options import Options
from driftwarden.plans.step import Position, Rules, plan_row, rules_of, walk
from driftwarden.scratch import cut
from driftwarden.sources.pieces import BATCH, SOURCE

_PLAN_TAIL = """
    piece int, n_rows bigint, n_malformed bigint, disposition string, error string, expected_version int,
    expected map<string,string>, observed map<string,string>, lost map<string,bigint>,
    loss bigint, loss_pct double, evolved_to int,
    registrations array<struct<version:int, kind:string, schema:map<string,string>>>
"""
_EMIT = 1024  # plan rows per Arrow batch
ROUNDS = 3  # folds from assumed starts before the rest is walked in order


def fold(profile: DataFrame, active: DataFrame | None, options: Options) -> DataFrame:
    """The batch plan: one row per profile row, with its verdict.

    ``active`` holds the ledger's (source_name, version, schema) per source.
    """
    rules = rules_of(options)
    ordered, partitions = _in_order(_with_active(profile, active, options), options)
    starts = _settled_starts(ordered, rules) if partitions > 1 else {}

    key_type = profile.schema[BATCH].dataType.simpleString()
    shape = T.DataType.fromDDL(f"{SOURCE} string, {BATCH} {key_type}, {_PLAN_TAIL}")
    arrow = to_arrow_schema(shape)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for row, verdict, _ in walk(batches, starts, rules):
            rows.append(plan_row(row, verdict))
            if len(rows) == _EMIT:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return ordered.mapInArrow(plan, shape)


def _with_active(profile: DataFrame, active: DataFrame | None, options: Options) -> DataFrame:
    if active is None:
        return profile.withColumns({
            "active_version": F.lit(None).cast("int"),
            "active_schema": F.lit(None).cast("map<string,string>"),
        })
    ledger = active.select(
        F.col("source_name").alias(SOURCE),
        F.col("version").cast("int").alias("active_version"),
        F.col("schema").alias("active_schema"),
    )
    return bounded_join(profile, ledger, [SOURCE], options, "left")


def _in_order(profile: DataFrame, options: Options) -> tuple[DataFrame, int]:
    """Summaries sorted by (source, batch), cut into partitions that no longer move."""
    frozen = cut(profile)
    partitions = max(1, -(-frozen.count() // options.batches_per_task))
    if partitions == 1:
        return frozen.coalesce(1).sortWithinPartitions(SOURCE, BATCH).withColumn("_part", F.lit(0)), 1
    ranged = frozen.repartitionByRange(partitions, SOURCE, BATCH).sortWithinPartitions(SOURCE, BATCH)
    return cut(ranged.withColumn("_part", F.spark_partition_id())), partitions


def _settled_starts(ordered: DataFrame, rules: Rules) -> dict[int, Position]:
    """The start of every partition that continues the source of the one before it."""
    starts: dict[int, Position] = {}
    ends: dict[int, dict] = {}
    stale: list[int] | None = None
    for _ in range(ROUNDS):
        todo = ordered if stale is None else ordered.where(F.col("_part").isin(stale))
        ends.update({row["part"]: row.asDict() for row in _ends(todo, starts, rules).collect()})
        chained = _chain(ends)
        stale = [
            part for part, start in chained.items()
            if part not in starts or starts[part].schema != start.schema
        ]
        starts = chained
        if not stale:
            return starts
    # all before the first stale partition is settled; the rest in one task, summaries only
    rest = ordered.where(F.col("_part") >= min(stale)).repartition(1).sortWithinPartitions("_part", SOURCE, BATCH)
    ends.update({row["part"]: row.asDict() for row in _ends(rest, starts, rules).collect()})
    return _chain(ends)


def _chain(ends: dict[int, dict]) -> dict[int, Position]:
    """Starts implied by the ends; versions are re-counted so only schemas need a new fold."""
    starts: dict[int, Position] = {}
    before, version = None, None
    for part in sorted(ends):
        end = ends[part]
        single = end["first_source"] == end["last_source"]
        if before is not None and before["last_source"] == end["first_source"]:
            schema = before["schema"]
            starts[part] = Position(version, dict(schema) if schema is not None else None)
            version = (version or 0) + end["registered"] if single else end["version"]
        else:
            version = end["version"]
        before = end
    return starts


def _ends(ordered: DataFrame, starts: dict[int, Position], rules: Rules) -> DataFrame:
    shape = T.DataType.fromDDL(
        "part int, first_source string, last_source string, version int, "
        "schema map<string,string>, registered int"
    )
    arrow = to_arrow_schema(shape)

    def end_of(first: dict, last: dict, count: int, schema: list | None, version: int | None) -> pa.RecordBatch:
        out = {
            "part": last["_part"], "first_source": first[SOURCE], "last_source": last[SOURCE],
            "version": version, "registered": count, "schema": schema,
        }
        return pa.RecordBatch.from_pylist([out], schema=arrow)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, count, held = None, None, 0, (None, None)
        for row, verdict, at in walk(batches, starts, rules):
            if last is not None and row["_part"] != last["_part"]:
                yield end_of(first, last, count, *held)
                first, count = None, 0
            if first is None or row[SOURCE] != last[SOURCE]:
                count = 0
            first = first or row
            count += len(verdict["registrations"])
            # the position moves on, so what it is after this row is kept apart
            if verdict["registrations"] or last is None or row[SOURCE] != last[SOURCE]:
                held = (list(at.schema.items()) if at.schema is not None else None, at.version)
            last = row
        if last is not None:
            yield end_of(first, last, count, *held)

    return ordered.mapInArrow(summarise, shape)


def output_bucket(options: Options):
    """Expression of the bucket an observed column leaves a passing batch with, null if dropped."""

    def bucket(observed, expected):
        keep_new = observed if options.schema_evolution else F.lit(None).cast("string")
        mendable = expected.isin(*COERCIBLE) if options.type_coercion else F.lit(False)
        return (
            F.when(expected.isNull(), keep_new)
            .when(observed == UNKNOWN, expected)
            .when(mendable, expected)
            .otherwise(observed)
        )

    return bucket


def merged_bucket(buckets: set[str]) -> str:
    """One bucket for a column that leaves different batches with different ones."""
    known = buckets - {UNKNOWN}
    return STRING if len(known) != 1 else known.pop()
