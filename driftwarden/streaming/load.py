"""A streaming load: files are loaded as they arrive, each once, in micro-batches that continue each other's schema.

A streaming query finds the files. It reads no content, only names, times and sizes, and appends them to a table; its checkpoint tells what it
has seen. ``drain`` assigns what has arrived to micro-batches, writes the assignment down, and loads one micro-batch after the other as a run
of its own. A run starts from the ledger's active schema, which is how a stream starts from what the ledger holds, and
its rows, quarantined records and versions are those of its run id: a micro-batch that was cut short is loaded again under the same id
with the same files, and counts once. What a micro-batch holds on the driver is its list of files, ``max_files`` at most.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwarden.operators.joins import bounded_join
from driftwarden.options import Options
from driftwarden.plans.load import Transform
from driftwarden.plans.run import run
from driftwarden.plans.state import State

ARRIVED = "path string, modificationTime timestamp, length bigint"
ASSIGNED = "stream string, number int, path string, arrived_at timestamp"


@dataclass
class StreamingLoad:
    """Loads the files of a folder into a sink as they arrive; ``name`` tells streams of one state apart."""

    spark: SparkSession
    state: State
    name: str
    source_name: str
    path: str
    destination: str
    source_type: str = "jsonl"
    destination_path: str | None = None
    destination_table: str | None = None
    source_options: dict = field(default_factory=dict)
    custom_transform: Transform | None = None
    options: Options = field(default_factory=Options)
    max_files: int = 1000

    @property
    def _folder(self) -> str:
        return f"{self.state.folder}/streams/{self.name}"

    def discover(self) -> None:
        """Append the files that have arrived since the last time to the table of arrivals."""
        found = self.spark.readStream.format("binaryFile").schema(f"{ARRIVED}, content binary").option("recursiveFileLookup", "true").load(self.path)
        query = (
            found.select("path", "modificationTime", "length").writeStream.format("parquet").outputMode("append")
            .option("path", f"{self._folder}/arrivals").option("checkpointLocation", f"{self._folder}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def arrivals(self) -> DataFrame:
        return self.spark.read.schema(ARRIVED).parquet(f"{self._folder}/arrivals").where("length > 0")

    def assigned(self) -> DataFrame:
        return self.state.read("stream_batches", ASSIGNED).where(F.col("stream") == self.name)

    def run_id(self, number: int) -> str:
        return f"{self.name}-{number:08d}"

    def _unfinished(self) -> int | None:
        """The first micro-batch that is assigned but has not been committed."""
        done = self.state.commits().select("run_id")
        ids = self.assigned().select("number").distinct().withColumn("run_id", F.format_string("%s-%08d", F.lit(self.name), "number"))
        return ids.join(done, "run_id", "left_anti").agg(F.min("number")).first()[0]

    def _assign(self) -> int | None:
        """Write down the next micro-batch: the oldest files that no micro-batch has, or nothing where there are none."""
        before = self.assigned()
        known = before.select("path").withColumn("_known", F.lit(True))
        fresh = bounded_join(self.arrivals(), known, ["path"], self.options, "left").where("_known IS NULL")
        chosen = fresh.orderBy("modificationTime", "path").limit(self.max_files)
        number = before.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
        rows = chosen.select(
            F.lit(self.name).alias("stream"), F.lit(number).cast("int").alias("number"), "path", F.col("modificationTime").alias("arrived_at")
        ).collect()
        if not rows:
            return None
        # one file in one commit: an assignment is there whole or not at all
        self.state.append("stream_batches", ASSIGNED, self.spark.createDataFrame(rows, ASSIGNED).coalesce(1))
        return number

    def load(self, number: int, now: datetime | None = None) -> dict:
        """Load a micro-batch, or load it again."""
        files = [r["path"] for r in self.assigned().where(F.col("number") == number).orderBy("arrived_at", "path").collect()]
        return run(
            self.spark, self.state, self.source_name, self.destination, source_type=self.source_type, source_path=files,
            source_options=self.source_options, destination_path=self.destination_path, destination_table=self.destination_table,
            custom_transform=self.custom_transform, options=self.options, run_id=self.run_id(number), now=now,
        )

    def drain(self, now: datetime | None = None) -> list[dict]:
        """Load what an earlier call has left unfinished, then all that has arrived; the summaries of the runs."""
        told = []
        while (number := self._unfinished()) is not None:
            told.append(self.load(number, now))
        self.discover()
        while (number := self._assign()) is not None:
            told.append(self.load(number, now))
        return told
