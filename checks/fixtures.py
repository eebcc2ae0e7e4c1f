"""Drifting inputs derived from the given tables, so that both engines build the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.operators.joins import bounded_join
from driftwarden.options import Options
from driftwarden.sources.batching import positions
from driftwarden.sources.pieces import Piece, tag

BATCHES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_pieces(spark: SparkSession, sf_dir: str) -> list[Piece]:
    """Ten batches of ``events`` in six layouts.

    The batch number is a range of event_id, so each layout reads its own id ranges only.
    """
    events = table(spark, sf_dir, "events")
    total = events.count()
    key = F.expr(f"event_id * {BATCHES} div {total}")

    def batches(*numbers: int) -> DataFrame:
        wanted = None
        for n in numbers:
            low, high = -(-n * total // BATCHES), -(-(n + 1) * total // BATCHES)
            part = (F.col("event_id") >= low) & (F.col("event_id") < high)
            wanted = part if wanted is None else wanted | part
        return tag(events.where(wanted), "events", key)

    region = F.element_at(
        F.array(F.lit("APAC"), F.lit("EMEA"), F.lit("AMER")), (F.col("user_id") % 3 + 1).cast("int")
    )
    text = F.col("value").cast("string")

    def priced(every: Column) -> Column:
        return F.when(F.col("event_id") % every == 0, F.concat(F.lit("$"), text)).otherwise(text)

    step = F.when(F.col("_batch") == 7, 10).otherwise(40)
    return [
        Piece(batches(0, 1, 2)),
        Piece(batches(3, 9).withColumn("region", region)),
        Piece(batches(4).drop("props")),
        Piece(batches(5, 7).withColumn("value", priced(step))),
        Piece(batches(6).withColumn("region", region).drop("props").withColumn("value", priced(F.lit(40)))),
        Piece(batches(8).withColumn("event_id", F.col("event_id").cast("string"))),
    ]


def numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    kind = F.col("l_linenumber") % 7
    text = F.when(kind == 0, F.col("l_orderkey").cast("string"))
    for n, spelled in enumerate([" 12 ", "1.0", "1e3", "1.5", "1_000", "$5.00"], start=1):
        text = text.when(kind == n, F.lit(spelled))
    return items.select("l_orderkey", F.when(F.col("l_partkey") % 50 != 0, text).alias("txt"))


def boolean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_linenumber") % 7
    text = F.when(kind == 0, F.lit("true"))
    for n, spelled in enumerate([" Yes", "N", "0", "maybe", "2"], start=1):
        text = text.when(kind == n, F.lit(spelled))
    return table(spark, sf_dir, "lineitem").select(text.alias("txt"))


def datetime_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 20
    text = (
        F.when(kind == 0, F.lit("n/a"))
        .when(kind == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(kind == 2, F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("txt"))


def quarantine_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("pipeline_name"),
        F.col("o_orderpriority").alias("source_name"),
        F.concat(F.lit("r"), F.col("o_orderkey") % 10).alias("run_id"),
        F.when(status == "O", F.lit("COERCION_FAILURE"))
        .when(status == "F", F.lit("HEALING_FAILED"))
        .when(status == "P", F.lit("SCHEMA_DRIFT")).alias("error_type"),
        F.col("o_orderdate").alias("quarantined_at"),
        (F.col("o_orderkey") % 2 == 0).alias("resolved"),
    )


def schema_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions per brand, numbered by part key: the position in the total order, less the brand's first."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_type", "p_size")
    placed = positions(parts, "pos", ["p_brand", "p_partkey"])
    first = placed.groupBy("p_brand").agg(F.min("pos").alias("first"))
    return bounded_join(placed, first, ["p_brand"], Options()).select(
        F.col("p_brand").alias("source_name"),
        (F.col("pos") - F.col("first") + 1).cast("int").alias("version"),
        F.concat_ws(":", "p_type", F.col("p_size").cast("string")).alias("schema_json"),
    )


def catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected and observed columns of every brand."""
    part = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source_name"), "p_size",
        F.when(F.length("p_type") % 2 == 0, "integer").otherwise("float").alias("bucket"),
    )
    sized = part.groupBy("source_name", "p_size").agg(F.min("bucket").alias("bucket"))
    expected = sized.select("source_name", F.concat(F.lit("c"), "p_size").alias("column_name"), "bucket")
    changed = F.when(F.col("p_size") % 5 == 0, "string").otherwise(F.col("bucket")).alias("bucket")
    kept = sized.where(F.col("p_size") % 7 != 0).select(
        "source_name", F.concat(F.lit("c"), "p_size").alias("column_name"), changed
    )
    new = sized.where(F.col("p_size") % 11 == 0).select(
        "source_name", F.concat(F.lit("n"), "p_size").alias("column_name"), F.lit("string").alias("bucket")
    )
    return expected, kept.union(new)
