"""Pass 2: the batch plan applied to the rows, as projections only.

Everything that can be settled per layout (which columns, which conversions) is settled before
the scan from a small digest of the plan. A layout whose batches all pass is then a plain
projection without any join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.functions import wording as W
from driftwarden.functions.buckets import FLOAT, INTEGER, STRING, UNKNOWN, bucket_of, canonical_type, sql_type
from driftwarden.functions.coercion import as_text, coerce, number_column, present, with_numbers
from driftwarden.functions.sql import literal, named
from driftwarden.operators import drift
from driftwarden.operators.joins import bounded_join, byte_bound
from driftwarden.options import Options
from driftwarden.plans.fold import merged_bucket, output_bucket
from driftwarden.plans.step import (
    COERCION_FAILURE, HEALED, HEALING_FAILED, MALFORMED, PASSING, SCHEMA_DRIFT, TRANSFORM_ERROR,
)
from driftwarden.sources.pieces import BATCH, SOURCE, TOKENS, Piece, own_name

_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}
_FEW = 10_000  # batch keys that are passed to a scan one by one
_RANGES = 64  # ranges of keys that are passed to it instead where there are more
QUARANTINED = """
    source_name string, batch_id string, column_name string, record_json string,
    error_type string, error_detail string, root_cause_hint string, schema_version int
"""


def described(plan: DataFrame, options: Options) -> DataFrame:
    """The plan with its drift report, healing actions and reason of refusal."""
    return drift.report(plan).withColumns({
        "actions": actions(options),
        "failure_reason": F.when(F.col("disposition") == HEALING_FAILED, loss_text(options)),
    })


def actions(options: Options) -> Column:
    """What healing did to a batch, in order: backfill, new columns, coercion with losses."""
    done = []
    if options.column_backfill:
        done.append(f"transform(removed, c -> format_string({literal(W.BACKFILLED)}, c, expected[c]))")
    wording = literal(W.KEPT_NEW if options.schema_evolution else W.DROPPED_NEW)
    done.append(
        f"CASE WHEN size(added) > 0 THEN array(format_string({wording}, {W.listed('added')})) ELSE array() END"
    )
    done.append(f"""transform(
        filter(type_changes, t -> coalesce(lost[t.column], 0) > 0),
        t -> format_string({literal(W.COERCED)}, t.column, t.observed, t.expected, lost[t.column]))""")
    healing = f"disposition IN ('{HEALED}', '{HEALING_FAILED}')"
    return F.expr(f"CASE WHEN {healing} THEN concat({', '.join(done)}) ELSE CAST(array() AS array<string>) END")


def loss_text(options: Options) -> Column:
    text = literal(W.LOSS_EXCEEDED.format(limit=options.max_coercion_loss_pct))
    return F.expr(f"format_string({text}, loss_pct)")


@dataclass(frozen=True)
class Move:
    """A column read as ``observed`` and put out as ``target`` in some batches of a layout."""

    observed: str
    target: str | None
    mended: bool

    @property
    def code(self) -> str:
        return f"{self.observed}>{self.target}"


class Healing:
    """Rows of a load split by the plan: ``clean``, ``failures`` and ``rejected``."""

    def __init__(self, pieces: list[Piece], raw: list[Piece], plan: DataFrame, options: Options):
        self.pieces, self.raw, self.plan, self.options = pieces, raw, plan, options
        self._digest()

    # -- what the plan says about each layout ---------------------------------------------

    def _moves_of_plan(self) -> DataFrame:
        """One row per (batch, observed column) of the passing batches."""
        bucket = output_bucket(self.options)
        known = F.col("expected").isNotNull()
        want = F.try_element_at(F.col("expected"), F.col("column"))
        return (
            self.plan.where(F.col("disposition").isin(*PASSING))
            .select(SOURCE, BATCH, "piece", "expected", F.explode("observed").alias("column", "seen_as"))
            .withColumn("want", want)
            .withColumn("target", F.when(known, bucket(F.col("seen_as"), F.col("want"))).otherwise(F.col("seen_as")))
            .withColumn(
                "mended",
                F.coalesce((F.col("target") == F.col("want")) & (F.col("seen_as") != F.col("target")), F.lit(False))
                & (F.col("seen_as") != UNKNOWN),
            )
        )

    def _digest(self) -> None:
        """Collect the distinct facts per layout: bounded by layouts x columns x buckets."""
        nothing = F.lit(None).cast("string")
        moves = self._moves_of_plan().groupBy("piece", "column", "seen_as", "target", "mended").count()
        gone = F.explode("removed")
        backfill = (
            self.plan.where(F.col("disposition") == HEALED)
            .select("expected", gone.alias("column"))
            .groupBy("column", F.col("expected")[F.col("column")].alias("bucket"))
            .count()
        )
        fates = self.plan.groupBy("piece", "disposition", (F.col("loss") > 0).alias("lossy")).count()
        seen = (
            self.plan.select("piece", F.explode("observed").alias("column", "seen_as"))
            .groupBy("piece", "column", "seen_as")
            .count()
        )
        rows = (
            moves.select(F.lit("move").alias("fact"), "piece", "column", F.col("seen_as").alias("a"),
                         F.col("target").alias("b"), F.col("mended").alias("flag"))
            .union(backfill.select(F.lit("gap"), F.lit(None).cast("int"), "column", "bucket", nothing, F.lit(False)))
            .union(fates.select(F.lit("fate"), "piece", nothing, "disposition", nothing, "lossy"))
            .union(self.plan.where("n_malformed > 0").select(F.lit("unread"), "piece", nothing, nothing, nothing, F.lit(False)).distinct())
            .union(seen.select(F.lit("seen"), "piece", "column", "seen_as", nothing, F.lit(False)))
            .union(self.plan.select(F.lit("size"), F.lit(None).cast("int"), nothing,
                                    byte_bound().cast("string"), nothing, F.lit(False)))
            .collect()
        )

        self.moves: dict[tuple[int, str], list[Move]] = defaultdict(list)
        self.fates: dict[int, set[tuple[str, bool]]] = defaultdict(set)
        self.seen_as: dict[tuple[int, str], set[str]] = defaultdict(set)
        self.unread: set[int] = set()
        gaps: dict[str, set[str]] = defaultdict(set)
        for row in rows:
            if row["fact"] == "move":
                self.moves[row["piece"], row["column"]].append(Move(row["a"], row["b"], row["flag"]))
            elif row["fact"] == "gap":
                gaps[row["column"]].add(row["a"])
            elif row["fact"] == "size":
                self.plan_bytes = int(row["a"])
            elif row["fact"] == "unread":
                self.unread.add(row["piece"])
            elif row["fact"] == "seen":
                self.seen_as[row["piece"], row["column"]].add(row["a"])
            else:
                self.fates[row["piece"]].add((row["a"], row["flag"]))
        for found in self.moves.values():
            found.sort(key=lambda m: m.code)
        told = self.plan.where("disposition IN ('SCHEMA_DRIFT', 'HEALING_FAILED', 'TRANSFORM_ERROR') OR loss > 0")
        told = told.select("piece", "disposition", BATCH)
        few = told.limit(_FEW + 1).collect()
        self.few = None if len(few) > _FEW or any(r[2] is None for r in few) else few
        self.ranges = [] if self.few is not None else self._key_ranges(told)
        self._lay_out(gaps if self.options.column_backfill else {})

    def _lay_out(self, gaps: dict[str, set[str]]) -> None:
        """Output columns in order of first appearance, each with its one Spark type."""
        buckets: dict[str, set[str]] = {}
        physical: dict[str, dict[str | None, T.DataType | None]] = defaultdict(dict)
        for index, piece in enumerate(self.pieces):
            for column in piece.columns:
                for move in self.moves.get((index, column), []):
                    if move.target is None:
                        continue
                    buckets.setdefault(column, set()).add(move.target)
                    as_is = column not in piece.inferred and move.observed == move.target
                    own = piece.type_of(column) if as_is else None
                    physical[column][own and own.simpleString()] = own
        for column, found in gaps.items():
            buckets.setdefault(column, set()).update(found)
        self.output: dict[str, tuple[str, T.DataType]] = {}
        for column, found in buckets.items():
            bucket = merged_bucket(found)
            kept = physical[column]
            one = len(kept) == 1 and None not in kept and len(found - {UNKNOWN}) == 1
            data_type = next(iter(kept.values())) if one else canonical_type(bucket)
            self.output[column] = (bucket, data_type)

    # -- expressions of one layout -----------------------------------------------------------

    def _read_as(self, piece: Piece, column: str, bucket: str) -> tuple[str, T.DataType]:
        """A value as its batch shows it: inferred text parsed as the observed bucket."""
        raw, data_type = named(column), piece.type_of(column)
        if column not in piece.inferred or bucket == STRING:
            return raw, data_type
        if bucket == UNKNOWN:
            return "CAST(NULL AS string)", T.StringType()
        options = self.options.but(allow_inf=True)
        return coerce(raw, data_type, bucket, options, self._number(piece, column)), canonical_type(bucket)

    def _number(self, piece: Piece, column: str) -> str | None:
        """The parsed number of a text column, added to the rows by ``_rows``."""
        return named(number_column(column)) if bucket_of(piece.type_of(column)) == STRING else None

    def _numeric(self, index: int) -> list[str]:
        """Text columns of a layout that some batch reads or coerces as numbers."""
        piece, found = self.pieces[index], []
        for column in piece.columns:
            buckets = {b for m in self.moves.get((index, column), []) for b in (m.observed, m.target)}
            buckets |= self.seen_as[index, column]
            if self._number(piece, column) is not None and {INTEGER, FLOAT} & buckets:
                found.append(column)
        return found

    def _by_move(self, index: int, column: str, moves: list[Move], made: Callable[[Move], str]) -> str:
        """``made`` for the only move of a column, or the one the row's batch calls for."""
        if len(self.moves[index, column]) == 1:
            return made(moves[0])
        code = self._code_name(index, column)
        cases = " ".join(f"WHEN {code} = {literal(m.code)} THEN {made(m)}" for m in moves)
        return f"CASE {cases} END"

    def _code_name(self, index: int, column: str) -> str:
        return f"_move_{self.pieces[index].columns.index(column)}"

    def _moved(self, index: int, column: str) -> str:
        piece = self.pieces[index]
        bucket, data_type = self.output[column]

        def made(move: Move) -> str:
            value, now = self._read_as(piece, column, move.observed)
            value = coerce(value, now, move.target, self.options, self._number(piece, column))
            now = now if bucket_of(now) == move.target else canonical_type(move.target)
            if bucket_of(now) != bucket:
                value, now = as_text(value, now), T.StringType()
            return value if now == data_type else f"CAST({value} AS {sql_type(data_type)})"

        moves = [m for m in self.moves.get((index, column), []) if m.target is not None]
        return self._by_move(index, column, moves, made) if moves else self._missing(column)

    def _missing(self, column: str) -> str:
        return f"CAST(NULL AS {sql_type(self.output[column][1])})"

    def _lost_cells(self, index: int) -> list[tuple[str, str]]:
        """(column, condition) for every column of a layout that some batch has coerced."""
        piece, found = self.pieces[index], []
        for column in piece.columns:
            mended = [m for m in self.moves.get((index, column), []) if m.mended]
            if not mended:
                continue

            def lost(move: Move, column: str = column) -> str:
                value, now = self._read_as(piece, column, move.observed)
                after = coerce(value, now, move.target, self.options, self._number(piece, column))
                return f"({present(named(column), piece.type_of(column))} AND {after} IS NULL)"

            found.append((column, f"coalesce({self._by_move(index, column, mended, lost)}, false)"))
        return found

    def _record(self, index: int, piece: Piece) -> Column:
        """The row as JSON text, before any healing."""
        if TOKENS in piece.frame.columns:
            return F.to_json(TOKENS, _JSON)
        fields = []
        for column in piece.columns:
            seen_as = self.seen_as[index, column]
            value = named(column)
            if column in piece.inferred and len(seen_as) == 1:
                value = self._read_as(piece, column, next(iter(seen_as)))[0]
            fields.append(f"{literal(own_name(column))}, {value}")
        return F.to_json(F.expr(f"named_struct({', '.join(fields)})"), _JSON)

    def _rows(self, index: int, wanted: Column, frame: DataFrame, every: bool, extra: list[Column]) -> DataFrame:
        """Rows of the batches that satisfy ``wanted``, with what their plan row has to offer."""
        piece = self.pieces[index]
        varying = [c for c in piece.columns if len(self.moves.get((index, c), [])) > 1]
        facts = self.plan.where((F.col("piece") == index) & wanted).select(SOURCE, BATCH, *extra)
        if varying:
            codes = self._moves_of_plan().where(F.col("piece") == index)
            code = F.concat_ws(">", "seen_as", F.coalesce("target", F.lit("None")))
            facts = facts.join(
                codes.groupBy(SOURCE, BATCH).agg(*[
                    F.max(F.when(F.col("column") == c, code)).alias(self._code_name(index, c)) for c in varying
                ]),
                [SOURCE, BATCH], "left",
            )
        if not varying and not extra:
            rows = frame if every else self._joined(frame, facts, "left_semi")
        else:
            rows = self._joined(frame, facts)
        return with_numbers(rows, self._numeric(index))

    @staticmethod
    def _key_ranges(told: DataFrame) -> list:
        """(first key, last key) of at most ``_RANGES`` stretches that hold all keys; none where a key is missing."""
        if told.where(F.col(BATCH).isNull()).take(1):
            return []
        cut = told.select(BATCH).repartitionByRange(_RANGES, BATCH).groupBy(F.spark_partition_id()).agg(
            F.min(BATCH).alias("low"), F.max(BATCH).alias("high")
        )
        return [(r["low"], r["high"]) for r in cut.select("low", "high").collect()]

    def _narrowed(self, frame: DataFrame, index: int, *dispositions: str) -> DataFrame:
        """Rows of some batches are asked for by key, so that a scan can skip the other files; by ranges of keys where there are many."""
        if self.few is None:
            inside = [F.col(BATCH).between(low, high) for low, high in self.ranges]
            return frame.where(reduce(Column.__or__, inside)) if inside else frame
        keys = [key for piece, kind, key in self.few if piece == index and kind in dispositions]
        return frame.where(F.col(BATCH).isin(*keys))

    def _joined(self, frame: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        # facts are a part of the plan plus short codes, so twice the plan bounds them; a large plan says little: measure
        bound = 2 * self.plan_bytes
        bound = bound if bound <= self.options.broadcast_limit_bytes else None
        return bounded_join(frame, facts, [SOURCE, BATCH], self.options, how, at_most=bound)

    def _has(self, index: int, *dispositions: str, lossy: bool | None = None) -> bool:
        return any(d in dispositions and lossy in (None, has) for d, has in self.fates.get(index, ()))

    # -- the three results -----------------------------------------------------------------------

    @cached_property
    def clean(self) -> DataFrame:
        """Rows of the passing batches in the output layout, with ``_source`` and ``_batch``."""
        passing, parts = F.col("disposition").isin(*PASSING), []
        for index, piece in enumerate(self.pieces):
            if not self._has(index, *PASSING):
                continue
            every = all(d in PASSING for d, _ in self.fates[index])
            rows = self._rows(index, passing, piece.rows, every, [])
            if self.options.on_coercion_failure == "exclude" and self._has(index, HEALED, lossy=True):
                for _, condition in self._lost_cells(index):
                    rows = rows.where(f"NOT {condition}")
            columns = [f"{self._value(index, piece, c)} AS {named(c)}" for c in self.output]
            parts.append(rows.selectExpr(SOURCE, BATCH, *map(named, piece.carried), *columns))
        if parts:
            return reduce(DataFrame.unionByName, parts)
        key = self.pieces[0].frame.schema[BATCH].dataType
        fields = [T.StructField(SOURCE, T.StringType()), T.StructField(BATCH, key)]
        fields += [self.pieces[0].frame.schema[c] for c in self.pieces[0].carried]
        fields += [T.StructField(c, t) for c, (_, t) in self.output.items()]
        return self._empty(T.StructType(fields))

    def _value(self, index: int, piece: Piece, column: str) -> str:
        return self._moved(index, column) if column in piece.columns else self._missing(column)

    @cached_property
    def failures(self) -> DataFrame:
        """One row per cell that could not be coerced; the row itself also stays unless excluded."""
        lossy = (F.col("disposition") == HEALED) & (F.col("loss") > 0)
        facts = [F.array_join("hints", "\n").alias("_hint"), F.col("expected_version").alias("_version")]
        parts = []
        for index, piece in enumerate(self.pieces):
            if not self._has(index, HEALED, lossy=True):
                continue
            rows = self._rows(index, lossy, self._narrowed(piece.rows, index, HEALED), False, facts)
            failed = ", ".join(f"CASE WHEN {cond} THEN {literal(column)} END" for column, cond in self._lost_cells(index))
            cells = rows.withColumn("_failed", F.expr(f"array_compact(array({failed}))")).where("size(_failed) > 0")
            cells = cells.withColumn("_record", self._record(index, piece))
            cells = cells.select(SOURCE, BATCH, "_hint", "_version", "_record", F.explode("_failed").alias("_column"))
            parts.append(cells.select(
                F.col(SOURCE).alias("source_name"), F.col(BATCH).cast("string").alias("batch_id"),
                F.col("_column").alias("column_name"), F.col("_record").alias("record_json"),
                F.lit(COERCION_FAILURE).alias("error_type"),
                F.lit(W.CELL_FAILURE_DETAIL).alias("error_detail"),
                F.col("_hint").alias("root_cause_hint"), F.col("_version").alias("schema_version"),
            ))
        return reduce(DataFrame.union, parts) if parts else self._empty(QUARANTINED)

    @cached_property
    def rejected(self) -> DataFrame:
        """Every row of the batches that were refused as a whole, untouched."""
        kind = F.col("disposition")
        detail = (
            F.when(kind == SCHEMA_DRIFT, F.col("summary"))
            .when(kind == HEALING_FAILED, F.col("failure_reason"))
            .otherwise(F.col("error"))
        )
        hint = F.when(kind == TRANSFORM_ERROR, F.lit(W.TRANSFORM_HINT)).otherwise(F.array_join("hints", "\n"))
        facts = self.plan.select(
            SOURCE, BATCH, "piece", kind.alias("_type"), detail.alias("_detail"), hint.alias("_hint"),
            F.when(kind != TRANSFORM_ERROR, F.col("expected_version")).alias("_version"),
        )
        parts = []
        for index, (piece, raw) in enumerate(zip(self.pieces, self.raw, strict=True)):
            for frame_of, kinds in ((raw, [TRANSFORM_ERROR]), (piece, [SCHEMA_DRIFT, HEALING_FAILED])):
                if not self._has(index, *kinds):
                    continue
                about = facts.where((F.col("piece") == index) & F.col("_type").isin(*kinds)).drop("piece")
                rows = self._joined(self._narrowed(frame_of.rows, index, *kinds), about)
                rows = with_numbers(rows, [c for c in frame_of.inferred if TOKENS not in frame_of.frame.columns])
                parts.append(rows.select(
                    F.col(SOURCE).alias("source_name"), F.col(BATCH).cast("string").alias("batch_id"),
                    F.lit(None).cast("string").alias("column_name"),
                    self._record(index, frame_of).alias("record_json"),
                    F.col("_type").alias("error_type"), F.col("_detail").alias("error_detail"),
                    F.col("_hint").alias("root_cause_hint"), F.col("_version").alias("schema_version"),
                ))
        return reduce(DataFrame.union, parts) if parts else self._empty(QUARANTINED)

    @cached_property
    def quarantined(self) -> DataFrame:
        return self.failures.union(self.rejected).union(self.malformed)

    @cached_property
    def malformed(self) -> DataFrame:
        """Lines that could not be read, with the file and the place of the record in it; all batches have theirs, refused or not."""
        parts = []
        for index, piece in enumerate(self.raw):
            if piece.malformed is not None and index in self.unread:
                parts.append(piece.malformed.select(
                    F.col(SOURCE).alias("source_name"), F.col(BATCH).cast("string").alias("batch_id"),
                    F.lit(None).cast("string").alias("column_name"),
                    F.to_json(F.struct("line", "file", "place"), _JSON).alias("record_json"),
                    F.lit(MALFORMED).alias("error_type"), F.lit(W.MALFORMED_DETAIL).alias("error_detail"),
                    F.lit(W.MALFORMED_HINT).alias("root_cause_hint"), F.lit(None).cast("int").alias("schema_version"),
                ))
        return reduce(DataFrame.union, parts) if parts else self._empty(QUARANTINED)

    def _empty(self, schema) -> DataFrame:
        return self.plan.sparkSession.createDataFrame([], schema)
