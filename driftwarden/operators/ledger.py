"""Schema versions: append-only rows, with everything else derived from the highest version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.operators.joins import bounded_join
from driftwarden.options import Options
from driftwarden.sources.pieces import BATCH, SOURCE

VERSIONS = """
    source_name string, run_id string, version int, schema map<string,string>,
    kind string, batch_id string, registered_at timestamp
"""


def registrations(plan: DataFrame, run_id: str, at: Column) -> DataFrame:
    """The versions a load registered, in ledger form."""
    return plan.select(SOURCE, BATCH, F.explode("registrations").alias("r")).select(
        F.col(SOURCE).alias("source_name"), F.lit(run_id).alias("run_id"), F.col("r.version"),
        F.col("r.schema"), F.col("r.kind"), F.col(BATCH).cast("string").alias("batch_id"),
        at.alias("registered_at"),
    )


def active(versions: DataFrame, payload: str = "schema") -> DataFrame:
    """(source_name, version, payload) of the highest version per source."""
    return versions.groupBy("source_name").agg(
        F.max("version").alias("version"), F.max_by(payload, "version").alias(payload)
    )


def flagged(versions: DataFrame, options: Options) -> DataFrame:
    """The ledger with ``is_active``; the per-source maximum is one small row per source."""
    latest = versions.groupBy("source_name").agg(F.max("version").alias("_latest"))
    joined = bounded_join(versions, latest, ["source_name"], options)
    return joined.withColumn("is_active", F.col("version") == F.col("_latest")).drop("_latest")


def history(versions: DataFrame, source_name: str) -> DataFrame:
    return versions.where(F.col("source_name") == source_name).orderBy("version")


def next_version(versions: DataFrame) -> DataFrame:
    """The version the next registration of each known source will get (an unknown one gets 1)."""
    return versions.groupBy("source_name").agg((F.max("version") + 1).alias("next_version"))


def register(versions: DataFrame, source_name: str, schema: dict[str, str], run_id: str, at: Column) -> DataFrame:
    """One ledger row for a schema registered by hand; equal schemas still get a new version."""
    spark = versions.sparkSession
    fields = [F.lit(part) for pair in schema.items() for part in pair]
    new = versions.where(F.col("source_name") == source_name).agg(
        (F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version")
    )
    row = new.select(
        F.lit(source_name).alias("source_name"), F.lit(run_id).alias("run_id"), "version",
        (F.create_map(*fields) if fields else F.create_map().cast("map<string,string>")).alias("schema"),
        F.lit("manual").alias("kind"), F.lit(None).cast("string").alias("batch_id"), at.alias("registered_at"),
    )
    return spark.createDataFrame([], VERSIONS).unionByName(row)
