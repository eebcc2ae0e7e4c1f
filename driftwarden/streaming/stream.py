"""The fold as a stream: batch summaries arrive, verdicts leave, schemas stay as keyed state.

Pass 1 of a load is appended to a folder as it happens (``publish``); a streaming query reads that
folder and keeps the active schema of every source in its state store, so a restarted query goes on
where its checkpoint stands and a replayed micro-batch emits nothing twice. Rows never enter the
query: what is grouped is one summary per batch.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.operators.profile import profile
from driftwarden.options import Options
from driftwarden.plans.step import Position, Rules, advance, rules_of
from driftwarden.sources.pieces import BATCH, SOURCE, Piece

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUMMARY = "source_name string, batch_id string, sort_key string, n_rows bigint, error string, observed string"
VERDICT = """
    source_name string, batch_id string, n_rows bigint, disposition string, expected_version int,
    evolved_to int, loss bigint, expected string, observed string
"""
STATE = "version int, schema string"


def publish(pieces: list[Piece], folder: str, options: Options, known: dict[str, set[str]] | None = None) -> None:
    """Append the summaries of some batches; numeric batch keys are ordered as numbers, others as text.

    Losses are counted toward the buckets of ``known`` and of the pieces at hand, so pass what the
    ledger holds.
    """
    made = profile(pieces, options, known)
    number = isinstance(made.schema[BATCH].dataType, T.IntegralType)
    made.select(
        F.col(SOURCE).alias("source_name"), F.col(BATCH).cast("string").alias("batch_id"),
        (_numeric_key() if number else F.col(BATCH).cast("string")).alias("sort_key"), "n_rows", "error",
        F.to_json("observed").alias("observed"),
    ).write.mode("append").parquet(folder)


def _numeric_key() -> Column:
    """Text that sorts as the number does: sign first, then digits of one width (complements below zero)."""
    key = F.col(BATCH).cast("bigint")
    shifted = F.when(key < 0, key + F.lit(2**62) + F.lit(2**62 - 1) + F.lit(1)).otherwise(key)
    return F.format_string("%s%019d", F.when(key < 0, "0").otherwise("1"), shifted)


def read_summaries(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The published summaries as a stream; the trigger bounds what one micro-batch holds."""
    return spark.readStream.schema(SUMMARY).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def judge(summaries: DataFrame, options: Options) -> DataFrame:
    """Verdicts of a stream of summaries, in the order the batches of a source arrive."""
    step = _step(rules_of(options))
    return summaries.groupBy("source_name").applyInPandasWithState(step, VERDICT, STATE, "append", "NoTimeout")


def _step(rules: Rules):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opening = not state.exists
        version, text = (None, None) if opening else state.get
        at = Position(version, json.loads(text) if text is not None else None)
        arrived = pd.concat(frames).sort_values(["sort_key", "batch_id"])
        out = []
        for row in arrived.itertuples(index=False):
            cells = [{"lost": {}, **cell} for cell in json.loads(row.observed)]
            error = row.error if isinstance(row.error, str) else None
            batch = {"n_rows": int(row.n_rows), "error": error, "observed": cells}
            verdict = advance(at, batch, rules, opening)
            opening = False
            expected = verdict["expected"]
            out.append((
                key[0], row.batch_id, int(row.n_rows), verdict["disposition"], verdict["expected_version"],
                verdict["evolved_to"], verdict["loss"], None if expected is None else json.dumps(expected),
                json.dumps(verdict["observed"]),
            ))
        state.update((at.version, None if at.schema is None else json.dumps(at.schema)))
        frame = pd.DataFrame(out, columns=[
            "source_name", "batch_id", "n_rows", "disposition", "expected_version", "evolved_to", "loss",
            "expected", "observed",
        ])
        yield frame.astype({"expected_version": "Int32", "evolved_to": "Int32"})

    return step
