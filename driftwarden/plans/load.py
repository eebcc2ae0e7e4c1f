"""A load, from pieces to plan and healed rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.operators.heal import Healing, described
from driftwarden.operators.profile import profile
from driftwarden.options import Options
from driftwarden.plans.fold import fold
from driftwarden.plans.step import HEALED, HEALING_FAILED, PASSING, SCHEMA_DRIFT, TRANSFORM_ERROR
from driftwarden.scratch import cut
from driftwarden.sources.pieces import BATCH, ERROR, SOURCE, Piece

Transform = Callable[[DataFrame], DataFrame]
WHOLE_BATCH = (SCHEMA_DRIFT, HEALING_FAILED, TRANSFORM_ERROR)


@dataclass
class Load:
    """Drift-aware reading of ``pieces`` against the active schemas of a ledger.

    ``active`` is a frame (source_name, version, schema map) or None for an empty ledger.
    """

    pieces: list[Piece]
    options: Options = Options()
    active: DataFrame | None = None
    custom_transform: Transform | None = None

    @cached_property
    def transformed(self) -> list[Piece]:
        if self.custom_transform is None:
            return self.pieces
        return [self._transform(p) for p in self.pieces]

    def _transform(self, piece: Piece) -> Piece:
        try:
            return piece.transformed(self.custom_transform)
        except Exception as exc:  # whatever the user's function raises
            # the function cannot be applied to this layout: all its batches fail
            return Piece(piece.frame.withColumn(ERROR, F.lit(str(exc) or type(exc).__name__)), piece.inferred, judged=True)

    @cached_property
    def known(self) -> dict[str, set[str]]:
        """Buckets the ledger holds per column: bounded by the number of distinct columns."""
        if self.active is None:
            return {}
        pairs = self.active.select(F.explode("schema").alias("column", "bucket")).distinct()
        found: dict[str, set[str]] = {}
        for row in pairs.collect():
            found.setdefault(row["column"], set()).add(row["bucket"])
        return found

    @cached_property
    def profiled(self) -> DataFrame:
        known = self.known
        raw_baseline = self.options.baseline_from == "raw" and self.custom_transform is not None
        if raw_baseline:
            # a raw baseline can be expected of transformed columns, and the other way round
            known = {c: set(b) for c, b in known.items()}
            for piece in self.pieces:
                for column in piece.columns:
                    bucket = piece.declared_bucket(column)
                    if bucket is not None:
                        known.setdefault(column, set()).add(bucket)
        made = profile(self.transformed, self.options, known)
        if not raw_baseline:
            return made
        raw = profile(self.pieces, self.options).select(SOURCE, BATCH, F.col("observed").alias("baseline"))
        return made.join(raw, [SOURCE, BATCH], "left")

    @cached_property
    def plan(self) -> DataFrame:
        """One row per batch: verdict, drift report, actions, registrations."""
        return cut(described(fold(self.profiled, self.active, self.options), self.options))

    @cached_property
    def healing(self) -> Healing:
        return Healing(self.transformed, self.pieces, self.plan, self.options)

    @property
    def clean(self) -> DataFrame:
        return self.healing.clean

    @property
    def quarantined(self) -> DataFrame:
        return self.healing.quarantined

    @cached_property
    def totals(self) -> DataFrame:
        """Row accounting per source, from the plan alone.

        A failed cell counts as one quarantined record, and so does a line that could not be read; under ``exclude`` the number of loaded
        rows depends on how many failures share a row, so that count is left to the rows.
        """
        kind, rows = F.col("disposition"), F.col("n_rows")
        passing, lines = kind.isin(*PASSING), F.sum("n_malformed")
        return self.plan.groupBy(F.col(SOURCE).alias("source_name")).agg(
            (F.sum("n_rows") + lines).alias("rows_extracted"),
            F.sum(F.when(passing, rows).otherwise(0)).alias("rows_clean"),
            (F.sum(F.when(kind.isin(*WHOLE_BATCH), rows).when(kind == HEALED, F.col("loss")).otherwise(0)) + lines).alias(
                "rows_quarantined"
            ),
            F.coalesce(F.bool_or("has_drift"), F.lit(False)).alias("drift_detected"),
            F.bool_or(F.col("evolved_to").isNotNull()).alias("schema_evolved"),
        )
