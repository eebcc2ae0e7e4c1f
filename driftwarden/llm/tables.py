"""Intermediate tables of a job with several passes, kept in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwarden.scratch import fresh_folder


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: later passes neither recompute it nor lose it."""
    path = fresh_folder(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
