"""Load options: one frozen object, built in code, from a mapping or from the session."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

ON_FAILURE = ("keep_nulled", "exclude")
BASELINES = ("transformed", "raw")


@dataclass(frozen=True)
class Options:
    pipeline_name: str = "etl_pipeline"
    # "source": a batch is a file (or what the frame's batch expression says);
    # "rows": batch_size consecutive rows
    batch_by: str = "source"
    batch_size: int = 1_000

    # healing switches
    type_coercion: bool = True
    column_backfill: bool = True
    schema_evolution: bool = True
    max_coercion_loss_pct: float = 5.0
    strict: bool = False
    # a healed batch registers its schema also where that is the active one already
    register_unchanged: bool = True

    # alerts
    min_severity: str = "WARNING"
    chat_footer: str = "driftwarden"

    # what happens to a row whose cell could not be coerced
    on_coercion_failure: str = "keep_nulled"
    # which schema a source without a ledger entry starts from
    baseline_from: str = "transformed"

    # coercion details
    datetime_formats: tuple[str, ...] = (
        "yyyy-MM-dd HH:mm:ss",
        "yyyy-MM-dd'T'HH:mm:ss",
        "yyyy-MM-dd'T'HH:mm:ssXXX",
        "yyyy-MM-dd",
    )
    epoch_unit: str | None = None  # "s", "ms" or "us": lets numbers become timestamps
    allow_inf: bool = False

    # scale limits: a plan above the byte limit is joined by shuffle, not broadcast
    broadcast_limit_bytes: int = 64 * 1024 * 1024
    # batches folded by one task before the fold is cut into range partitions
    batches_per_task: int = 20_000

    def __post_init__(self) -> None:
        if self.on_coercion_failure not in ON_FAILURE:
            raise ValueError(f"on_coercion_failure must be one of {ON_FAILURE}")
        if self.baseline_from not in BASELINES:
            raise ValueError(f"baseline_from must be one of {BASELINES}")
        if self.batch_by not in ("source", "rows"):
            raise ValueError("batch_by must be source or rows")
        if self.epoch_unit not in (None, "s", "ms", "us"):
            raise ValueError("epoch_unit must be s, ms, us or None")
        if self.batch_size < 1 or self.batches_per_task < 1:
            raise ValueError("batch_size and batches_per_task must be positive")

    def but(self, **changes) -> Options:
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, values: Mapping[str, str]) -> Options:
        """Options from text values; unknown names are an error, missing ones keep the default."""
        known = {f.name: f for f in fields(cls)}
        unknown = sorted(set(values) - set(known))
        if unknown:
            raise ValueError(f"unknown options: {', '.join(unknown)}")
        return cls(**{name: _parse(value, known[name].default) for name, value in values.items()})

    @classmethod
    def from_session(cls, spark: SparkSession, prefix: str = "spark.driftwarden.") -> Options:
        """Options from session settings, e.g. ``--conf spark.driftwarden.strict=true``."""
        found = {}
        for f in fields(cls):
            value = spark.conf.get(prefix + f.name, None)
            if value is not None:
                found[f.name] = value
        return cls.from_mapping(found)


def _parse(value, default):
    if not isinstance(value, str):
        return value
    if isinstance(default, bool):
        return value.strip().lower() == "true"
    if isinstance(default, int):
        return int(value)
    if isinstance(default, float):
        return float(value)
    if isinstance(default, tuple):
        return tuple(part for part in value.split("|") if part)
    return value or None if default is None else value
