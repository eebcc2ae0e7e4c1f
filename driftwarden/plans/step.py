"""The step of the fold: one batch summary judged against the schema its source stands at.

Plain values in, plain values out. The functions travel with the job by value, so executors need
only Spark's own Python.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle

from driftwarden.functions.buckets import COERCIBLE, UNKNOWN
from driftwarden.options import Options
from driftwarden.sources.pieces import BATCH, SOURCE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLEAN, HEALED = "CLEAN", "HEALED"
SCHEMA_DRIFT, HEALING_FAILED, TRANSFORM_ERROR = "SCHEMA_DRIFT", "HEALING_FAILED", "TRANSFORM_ERROR"
COERCION_FAILURE, MALFORMED = "COERCION_FAILURE", "MALFORMED"
PASSING = (CLEAN, HEALED)


@dataclass
class Position:
    """Where a source stands: the active version and schema, or no schema at all."""

    version: int | None
    schema: dict[str, str] | None


@dataclass(frozen=True)
class Rules:
    strict: bool
    coercion: bool
    backfill: bool
    evolution: bool
    max_loss_pct: float
    register_unchanged: bool = True


def rules_of(o: Options) -> Rules:
    return Rules(
        o.strict, o.type_coercion, o.column_backfill, o.schema_evolution, o.max_coercion_loss_pct, o.register_unchanged
    )


def advance(at: Position, batch: dict, rules: Rules, opening: bool) -> dict:
    """Judge one batch summary and move ``at`` to the schema the next batch meets."""
    cells = {c["column"]: c for c in batch["observed"]}
    seen = {name: c["bucket"] for name, c in cells.items()}
    verdict = {
        "disposition": CLEAN, "expected_version": None, "expected": None, "observed": seen,
        "lost": {}, "loss": 0, "loss_pct": 0.0, "evolved_to": None, "registrations": [],
    }

    def register(kind: str, schema: dict[str, str]) -> int:
        at.version, at.schema = (at.version or 0) + 1, schema
        entry = {"version": at.version, "kind": kind, "schema": list(schema.items())}
        verdict["registrations"].append(entry)
        return at.version

    if opening and at.schema is None and batch["n_rows"] > 0:
        baseline = batch.get("baseline") or batch["observed"]
        register("baseline", {c["column"]: c["bucket"] for c in baseline})
    if batch["error"] is not None:
        verdict["disposition"] = TRANSFORM_ERROR
        return verdict
    if at.schema is None or not batch["n_rows"]:  # no schema known, or no line could be read
        return verdict

    want = at.schema
    verdict["expected_version"], verdict["expected"] = at.version, want
    retyped = [
        name for name, bucket in seen.items()
        if name in want and bucket != want[name] and UNKNOWN not in (bucket, want[name])
    ]
    fresh = sorted(seen.keys() - want.keys())
    # a column that had only nulls so far gets its type from the first batch that shows one and passes
    shown = {n: seen[n] for n, b in want.items() if b == UNKNOWN and seen.get(n, UNKNOWN) != UNKNOWN}
    if not (retyped or fresh or want.keys() - seen.keys()):
        if shown:
            register("resolution", want | shown)
        return verdict
    if rules.strict:
        verdict["disposition"] = SCHEMA_DRIFT
        return verdict

    mended = [n for n in retyped if rules.coercion and want[n] in COERCIBLE]
    for name in mended:
        count = dict(cells[name]["lost"]).get(want[name], 0)
        if count:
            verdict["lost"][name] = count
    verdict["loss"] = sum(verdict["lost"].values())
    if batch["n_rows"]:
        verdict["loss_pct"] = verdict["loss"] / batch["n_rows"] * 100
    if verdict["loss_pct"] > rules.max_loss_pct:
        verdict["disposition"] = HEALING_FAILED
        return verdict

    verdict["disposition"] = HEALED
    if rules.evolution and (fresh or retyped):
        grown = {n: b for n, b in want.items() if rules.backfill or n in seen}
        for name in retyped:
            if name not in mended:
                grown[name] = seen[name]
        grown.update(shown)
        grown.update({name: seen[name] for name in fresh})
        if rules.register_unchanged or grown != want:
            verdict["evolved_to"] = register("evolution", grown)
    elif shown:
        register("resolution", want | shown)
    return verdict


def walk(batches: Iterator[pa.RecordBatch], starts: dict[int, Position], rules: Rules):
    """Yield (row, verdict, position after, opening row of its source?) in order."""
    source, key, at = None, None, Position(None, None)
    for batch in batches:
        for row in batch.to_pylist():
            opening = row[SOURCE] != source
            if not opening and row[BATCH] == key:
                raise ValueError(f"batch {key!r} of source {source!r} has more than one layout")
            continued = False
            if opening:
                known = row["active_schema"]
                at = Position(row["active_version"], dict(known) if known is not None else None)
                if source is None and row["_part"] in starts:
                    start = starts[row["_part"]]
                    at = Position(start.version, dict(start.schema) if start.schema is not None else None)
                    continued = True
            source, key = row[SOURCE], row[BATCH]
            yield row, advance(at, row, rules, opening and not continued), at


def plan_row(row: dict, verdict: dict) -> dict:
    out = {name: row[name] for name in (SOURCE, BATCH, "piece", "n_rows", "error")}
    out["n_malformed"] = row.get("n_malformed") or 0
    out.update(verdict)
    for name in ("expected", "observed", "lost"):
        out[name] = list(out[name].items()) if out[name] is not None else None
    return out
