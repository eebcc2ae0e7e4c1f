"""Pass 1: what each batch looks like, as one partial aggregation over the rows.

The result has one row per batch. Besides the observed bucket of every column it counts, for each
bucket the column could be expected in, the cells that would be lost; a later decision about the
batch therefore never needs another look at the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.functions.buckets import (
    BOOLEAN, DATETIME, FLOAT, INTEGER, STRING, UNKNOWN,
)
from driftwarden.functions.coercion import losing, number_column, present, text_number, with_numbers
from driftwarden.functions.sql import literal, named
from driftwarden.options import Options
from driftwarden.sources.pieces import BAD, BATCH, ERROR, SOURCE, Piece, looks

LOSS_TARGETS = (INTEGER, FLOAT, BOOLEAN, DATETIME)
INFERABLE = (INTEGER, FLOAT, BOOLEAN)
_LOST = "map<string,bigint>"
_CELL = f"struct<column:string,ordinal:int,bucket:string,present:bigint,lost:{_LOST}>"


def loss_targets(
    pieces: Iterable[Piece], known: Mapping[str, set[str]] | None = None
) -> dict[str, set[str]]:
    """Per column, the buckets some batch might be expected in.

    Only a bucket seen for the column in another layout or in the ledger can become the expected
    one, so a column that never changes gets no loss counters and is not even read in pass 1.
    """
    targets: dict[str, set[str]] = {c: set(b) for c, b in (known or {}).items()}
    for piece in pieces:
        for column in piece.columns:
            bucket = piece.declared_bucket(column)
            targets.setdefault(column, set()).update(INFERABLE if bucket is None else {bucket})
    return targets


def profile(
    pieces: list[Piece], options: Options, known: Mapping[str, set[str]] | None = None
) -> DataFrame:
    """One row per (source, batch): rows, transform error, observed columns and possible losses."""
    targets = loss_targets(pieces, known)
    parts = [
        (_profile_text if p.inferred and len(p.inferred) == len(p.columns) else _profile_piece)(i, p, targets, options)
        for i, p in enumerate(pieces)
    ]
    return reduce(DataFrame.unionByName, parts)


def _profile_piece(index: int, piece: Piece, targets: dict[str, set[str]], options: Options) -> DataFrame:
    counters = _row_counters(piece)
    cells, parsed = [], []
    guessed: dict[str, Column] = {}
    for i, column in enumerate(piece.columns):
        wanted = sorted(t for t in targets[column] if t in LOSS_TARGETS)
        if column in piece.inferred:
            parsed.append(column)
            wanted = sorted({*wanted, DATETIME}) if column in piece.dated else wanted
            guessed[f"c{i}_bucket"] = F.expr(_guess(f"c{i}_", ["0"] if column in piece.dated else [], "0"))
            counters |= _inferred_counters(i, piece, column, wanted, options)
            cells.append(_inferred_cell(i, piece, column, wanted, options))
        else:
            if piece.declared_bucket(column) == STRING and {INTEGER, FLOAT} & set(wanted):
                parsed.append(column)
            made, cell = _declared_cell(i, piece, column, wanted, options)
            counters |= made
            cells.append(cell)

    observed = f"array({', '.join(cells)})" if cells else "array()"
    return (
        _counted(with_numbers(piece.frame, parsed), [SOURCE, BATCH], counters, piece, _error(piece))
        .withColumns(guessed)
        .selectExpr(
            SOURCE, BATCH, f"{index} AS piece", "n_rows", "n_malformed", "error",
            f"filter(CAST({observed} AS array<{_CELL}>), cell -> cell.bucket IS NOT NULL) AS observed",
        )
    )


def _row_counters(piece: Piece) -> dict[str, str]:
    """Rows of a batch, and lines of it that could not be read."""
    if piece.malformed is None:
        return {"n_rows": "count(1)", "n_malformed": "CAST(0 AS bigint)"}
    return {"n_rows": f"count_if(NOT {BAD})", "n_malformed": f"count_if({BAD})"}


def _counted(rows: DataFrame, keys: list[str], counters: dict[str, str], piece: Piece, error: str) -> DataFrame:
    """Counters by key, and the least message of its rows.

    A minimum of text among the counters would make Spark sort all rows of a task instead of counting them in a hash table, so
    rows are counted by message first, and the least one is taken from these counts.
    """
    made = [F.expr(sql).alias(name) for name, sql in counters.items()]
    if not piece.has_errors:
        return rows.groupBy(*keys).agg(*made).withColumn("error", F.lit(None).cast("string"))
    by_message = rows.groupBy(*keys, F.expr(error).alias("error")).agg(*made)
    return by_message.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in counters], F.min("error").alias("error"))


def _error(piece: Piece) -> str:
    if not piece.has_errors:
        return "CAST(NULL AS string)"
    return ERROR if piece.malformed is None else f"CASE WHEN NOT {BAD} THEN {ERROR} END"


def _profile_text(index: int, piece: Piece, targets: dict[str, set[str]], options: Options) -> DataFrame:
    """The profile of a layout of text columns only, one cell at a time.

    Each row is turned into its cells and these are counted by (batch, column), so the generated
    code is that of one column however wide the layout is, and small enough to be compiled. Cells
    are combined before the shuffle; what is shuffled is a row per batch, column and task.
    """
    names = piece.columns
    cells = ", ".join(
        f"named_struct('i', {i}, 'v', {named(c)}, 'token', {piece.token(c) or 'CAST(NULL AS string)'},"
        f" 'seen', {piece.seen(c) or 'true'})"
        for i, c in enumerate(names)
    )
    carried = [SOURCE, BATCH, f"{_error(piece)} AS error", *([BAD] if piece.malformed is not None else [])]
    values = piece.frame.selectExpr(*carried, f"inline(array({cells}))").withColumn("number", F.expr(text_number("v")))

    as_json = piece.token(names[0]) is not None
    counters = {**_row_counters(piece), "seen": "count_if(seen)", "present": "count(v)"}
    counters |= {
        f"like_{b}": f"count_if({cond})" for b, cond in looks("v", "token" if as_json else None, "number").items()
    }
    dated = [str(i) for i, c in enumerate(names) if DATETIME in targets[c] or c in piece.dated]
    wanted = [*INFERABLE, *([DATETIME] if dated else [])]
    for target in wanted:
        lost = losing("v", T.StringType(), target, options, "number")
        if target == DATETIME:
            lost = f"i IN ({', '.join(dated)}) AND {lost}"
        counters[f"lost_{target}"] = f"count_if({lost})"

    pairs = ", ".join(f"'{t}', {_lost_as('bucket', t, 'present', f'lost_{t}', options)}" for t in wanted)
    column = f"array({', '.join(literal(c) for c in names)})[i]"
    cell = (
        f"named_struct('ordinal', i, 'column', {column}, 'bucket', CASE WHEN seen > 0 THEN bucket END,"
        f" 'present', present, 'lost', map({pairs}))"
    )
    ordered = "array_sort(collect_list(cell), (a, b) -> a.ordinal - b.ordinal)"
    return (
        _counted(values, [SOURCE, BATCH, "i"], counters, piece, "error")
        .withColumn("bucket", F.expr(_guess("", [str(i) for i, c in enumerate(names) if c in piece.dated])))
        .selectExpr(SOURCE, BATCH, "n_rows", "n_malformed", "error", f"{cell} AS cell")
        .groupBy(SOURCE, BATCH)
        .agg(
            F.max("n_rows").alias("n_rows"), F.max("n_malformed").alias("n_malformed"), F.min("error").alias("error"),
            F.expr(ordered).alias("cells"),
        )
        .selectExpr(
            SOURCE, BATCH, f"{index} AS piece", "n_rows", "n_malformed", "error",
            "transform(filter(cells, c -> c.bucket IS NOT NULL), c -> named_struct('column', c.column,"
            " 'ordinal', c.ordinal, 'bucket', c.bucket, 'present', c.present, 'lost', c.lost)) AS observed",
        )
    )


def _cell(column: str, ordinal: int, bucket: str, count: str, lost: dict[str, str]) -> str:
    pairs = ", ".join(f"'{target}', {sql}" for target, sql in lost.items())
    return (
        f"named_struct('column', {literal(column)}, 'ordinal', {ordinal}, 'bucket', {bucket},"
        f" 'present', CAST({count} AS bigint), 'lost', CAST(map({pairs}) AS {_LOST}))"
    )


def _declared_cell(
    i: int, piece: Piece, column: str, wanted: list[str], options: Options
) -> tuple[dict[str, str], str]:
    data_type, bucket = piece.type_of(column), piece.declared_bucket(column)
    counters, lost = {}, {}
    number = named(number_column(column)) if bucket == STRING else None
    for target in wanted:
        condition = losing(named(column), data_type, target, options, number)
        if condition is not None:
            counters[f"c{i}_lost_{target}"] = f"count_if({condition})"
            lost[target] = f"c{i}_lost_{target}"
    # how many values are present is told only where the values are read anyway
    return counters, _cell(column, i, literal(bucket), "NULL", lost)


def _inferred_counters(
    i: int, piece: Piece, column: str, wanted: list[str], options: Options
) -> dict[str, str]:
    text, data_type, number = named(column), piece.type_of(column), named(number_column(column))
    counters = {f"c{i}_present": f"count_if({present(text, data_type)})"}
    counters |= {f"c{i}_like_{b}": f"count_if({cond})" for b, cond in looks(text, piece.token(column), number).items()}
    seen = piece.seen(column)
    if seen is not None:
        counters[f"c{i}_seen"] = f"count_if({seen})"
    for target in wanted:
        counters[f"c{i}_lost_{target}"] = f"count_if({losing(text, data_type, target, options, number)})"
    return counters


def _guess(prefix: str, dated: list[str] | None = None, place: str = "i") -> str:
    """The narrowest bucket that all present values of a batch look like; times only at the places in ``dated``."""
    count = f"{prefix}present"
    tests = "".join(
        f" WHEN {prefix}like_{guess} = {count} THEN '{guess}'" for guess in (INTEGER, FLOAT, BOOLEAN)
    )
    if dated:
        tests += f" WHEN {place} IN ({', '.join(dated)}) AND {prefix}lost_{DATETIME} = 0 THEN '{DATETIME}'"
    return f"CASE WHEN {count} = 0 THEN '{UNKNOWN}'{tests} ELSE '{STRING}' END"


def _inferred_cell(i: int, piece: Piece, column: str, wanted: list[str], options: Options) -> str:
    count, bucket = f"c{i}_present", f"c{i}_bucket"
    lost = {t: _lost_as(bucket, t, count, f"c{i}_lost_{t}", options) for t in wanted}
    if piece.seen(column) is not None:
        bucket = f"CASE WHEN c{i}_seen > 0 THEN {bucket} END"
    return _cell(column, i, bucket, count, lost)


def _lost_as(bucket: str, target: str, count: str, as_text: str, options: Options) -> str:
    """Cells lost when the batch is read as ``bucket`` first and then moved to ``target``."""
    number, flag = f"{bucket} IN ('{INTEGER}', '{FLOAT}')", f"{bucket} = '{BOOLEAN}'"
    if target == BOOLEAN:
        return f"CASE WHEN {number} THEN 0 ELSE {as_text} END"
    if target == DATETIME:
        from_number = count if options.epoch_unit is None else "0"
        return f"CASE WHEN {number} THEN {from_number} WHEN {flag} THEN {count} ELSE {as_text} END"
    return f"CASE WHEN {flag} THEN 0 ELSE {as_text} END"


def type_counts(piece: Piece, options: Options) -> DataFrame:
    """Per batch and text column: rows, present values and how many look like each bucket."""
    counters, cells = {"n_rows": "count(1)"}, []
    for i, column in enumerate(piece.inferred):
        counters |= _inferred_counters(i, piece, column, [DATETIME], options)
        cells.append(
            f"struct({literal(column)} AS column_name, c{i}_present AS n_present, n_rows - c{i}_present AS n_null,"
            f" c{i}_like_{INTEGER} AS n_integer, c{i}_like_{FLOAT} AS n_float, c{i}_like_{BOOLEAN} AS n_boolean,"
            f" c{i}_present - c{i}_lost_{DATETIME} AS n_datetime, c{i}_bucket AS bucket)"
        )
    return (
        with_numbers(piece.frame, list(piece.inferred))
        .groupBy(SOURCE, BATCH)
        .agg(*[F.expr(sql).alias(name) for name, sql in counters.items()])
        .withColumns({f"c{i}_bucket": F.expr(_guess(f"c{i}_")) for i in range(len(piece.inferred))})
        .selectExpr(SOURCE, BATCH, "n_rows", f"inline(array({', '.join(cells)}))")
    )
