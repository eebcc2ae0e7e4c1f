"""Schema differences as expressions over (expected, observed) maps, and as a catalog join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.functions import wording as W
from driftwarden.functions.buckets import UNKNOWN
from driftwarden.functions.sql import literal

ADDED, REMOVED, RETYPED = "added_columns", "removed_columns", "type_changed"


_CHANGES = "array<struct<column:string,expected:string,observed:string>>"


def added(expected: str, observed: str) -> str:
    return f"array_sort(array_except(map_keys({observed}), map_keys({expected})))"


def removed(expected: str, observed: str) -> str:
    return f"array_sort(array_except(map_keys({expected}), map_keys({observed})))"


def type_changes(expected: str, observed: str) -> str:
    """Shared columns with another bucket: array of (column, expected, observed), by column."""
    shared = f"array_sort(array_intersect(map_keys({expected}), map_keys({observed})))"
    known = f"{expected}[c] <> '{UNKNOWN}' AND {observed}[c] <> '{UNKNOWN}'"
    changed = f"filter({shared}, c -> {expected}[c] <> {observed}[c] AND {known})"
    entry = f"named_struct('column', c, 'expected', {expected}[c], 'observed', {observed}[c])"
    return f"transform({changed}, c -> {entry})"


def report(frame: DataFrame, expected: str = "expected", observed: str = "observed") -> DataFrame:
    """Add the drift report of every row: the three differences and everything told from them."""

    def or_none(made: str, ddl: str) -> Column:
        return F.expr(f"coalesce({made}, CAST(array() AS {ddl}))")

    with_lists = frame.withColumns({
        "added": or_none(added(expected, observed), "array<string>"),
        "removed": or_none(removed(expected, observed), "array<string>"),
        "type_changes": or_none(type_changes(expected, observed), _CHANGES),
    })
    return with_lists.withColumns({
        "has_drift": F.expr("size(added) + size(removed) + size(type_changes) > 0"),
        "drift_types": drift_types(),
        "hints": hints(),
        "summary": summary(),
    })


def drift_types() -> Column:
    return F.expr(f"""concat_ws(',',
        CASE WHEN size(added) > 0 THEN '{ADDED}' END,
        CASE WHEN size(removed) > 0 THEN '{REMOVED}' END,
        CASE WHEN size(type_changes) > 0 THEN '{RETYPED}' END)""")


def hints() -> Column:
    """One text per kind of difference; for changed types one per column."""
    return F.expr(f"""concat(
        array_compact(array(
            CASE WHEN size(added) > 0 THEN format_string({literal(W.ADDED_HINT)}, array_join(added, ', ')) END,
            CASE WHEN size(removed) > 0 THEN format_string({literal(W.REMOVED_HINT)}, array_join(removed, ', ')) END)),
        transform(type_changes, t -> format_string({literal(W.RETYPED_HINT)}, t.column, t.expected, t.observed)))""")


def summary() -> Column:
    change = f"concat({W.quoted('t.column')}, ': ', {W.quoted("concat(t.expected, '->', t.observed)")})"
    text = f"""concat_ws('; ',
        CASE WHEN size(added) > 0 THEN concat('added=', {W.listed('added')}) END,
        CASE WHEN size(removed) > 0 THEN concat('removed=', {W.listed('removed')}) END,
        CASE WHEN size(type_changes) > 0
            THEN concat('type_changes={{', array_join(transform(type_changes, t -> {change}), ', '), '}}') END)"""
    return F.expr(f"coalesce(nullif({text}, ''), {literal(W.NO_DRIFT)})")


def details_json() -> Column:
    """The report as JSON text."""
    return F.expr("""to_json(named_struct(
        'added_columns', added,
        'removed_columns', removed,
        'type_changes', map_from_entries(transform(type_changes, t -> struct(t.column, array(t.expected, t.observed)))),
        'root_cause_hints', hints))""")


def compare_catalogs(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Differences between two long catalogs (keys..., column_name, bucket), any number of sources.

    One full outer join on (keys, column): both sides share one hash partitioning, and the columns
    of one source spread over tasks because the column name is part of the key.
    """
    on = [*keys, "column_name"]
    left = expected.select(*on, F.col("bucket").alias("old_bucket"))
    right = observed.select(*on, F.col("bucket").alias("new_bucket"))
    old, new = F.col("old_bucket"), F.col("new_bucket")
    kind = (
        F.when(old.isNull(), F.lit("added"))
        .when(new.isNull(), F.lit("removed"))
        .when((old != new) & (old != UNKNOWN) & (new != UNKNOWN), F.lit("type_changed"))
    )
    return left.join(right, on, "full_outer").withColumn("kind", kind).where(F.col("kind").isNotNull())


def catalog_reports(differences: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of ``compare_catalogs`` gathered into one report per key."""
    column = F.col("column_name")
    gathered = differences.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "added", column))).alias("added"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "removed", column))).alias("removed"),
        F.array_sort(F.collect_list(F.when(
            F.col("kind") == "type_changed",
            F.struct(column.alias("column"), F.col("old_bucket").alias("expected"),
                     F.col("new_bucket").alias("observed")),
        ))).alias("type_changes"),
    )
    return gathered.withColumns({"drift_types": drift_types(), "hints": hints(), "summary": summary()})
