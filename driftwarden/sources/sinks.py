"""Where clean rows go: delimited files, JSON lines, tables, or nowhere but counted."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwarden.functions.sql import named
from driftwarden.operators.joins import bounded_join
from driftwarden.options import Options
from driftwarden.scratch import partition_value, remove_matching

# The text format of times, and doubled quotes inside quoted fields.
TIMES = {
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}
DELIMITED = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false"}

DESTINATIONS = ("csv", "jsonl", "db", "memory")


def path_missing(exc: AnalysisException) -> bool:
    return exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


_COLUMNS = "_columns"  # readers skip names that start with an underscore


def existing_columns(spark: SparkSession, path: str) -> list[str]:
    """Columns of a delimited sink so far, from the list kept beside its files."""
    try:
        rows = spark.read.schema("n int, names array<string>").json(f"{path}/{_COLUMNS}").collect()
    except AnalysisException as exc:
        if path_missing(exc):
            return []
        raise
    return max(rows, key=lambda r: r["n"])["names"] if rows else []


#: Partition columns of rows that an attempt of a run has put into a sink.
RUN, ATTEMPT = "_load_run", "_load_attempt"
Attempt = tuple[str, int]


def _writer(frame: DataFrame, load: Attempt | None, mode: str = "append") -> DataFrameWriter:
    if load is None:
        return frame.write.mode(mode)
    clash = [c for c in frame.columns if c.lower() in (RUN, ATTEMPT)]
    if clash:
        raise ValueError(f"a sink of runs keeps {RUN} and {ATTEMPT} for itself")
    marked = frame.withColumns({RUN: F.lit(load[0]), ATTEMPT: F.lit(load[1])})
    return marked.write.mode(mode).partitionBy(RUN, ATTEMPT)


def write_delimited(frame: DataFrame, path: str, load: Attempt | None = None) -> None:
    """Append part files, each with its own header, columns matched to the sink by name.

    Columns the sink does not have yet go last; columns only the sink has are written as null.
    """
    spark = frame.sparkSession
    before = existing_columns(spark, path)
    ordered = before + [c for c in frame.columns if c not in before]
    columns = [
        F.col(named(c)) if c in frame.columns else F.lit(None).cast("string").alias(c) for c in ordered
    ]
    _writer(frame.select(*columns), load).options(**DELIMITED, **TIMES).csv(path)
    if ordered != before:
        entry = spark.createDataFrame([(len(ordered), ordered)], "n int, names array<string>")
        entry.write.mode("append").json(f"{path}/{_COLUMNS}")


def write_jsonl(frame: DataFrame, path: str, load: Attempt | None = None) -> None:
    _writer(frame, load).options(ignoreNullFields="false", **TIMES).json(path)


def write_table(frame: DataFrame, path: str, mode: str = "append", load: Attempt | None = None) -> None:
    """A columnar table in a folder; ``mode`` is append, overwrite or errorifexists."""
    _writer(frame, load, mode).parquet(path)


def _table_path(path: str, table: str | None) -> str:
    return f"{path}/{table}" if table else path


def committed(
    spark: SparkSession, destination: str, path: str, commits: DataFrame, table: str | None = None, options: Options | None = None
) -> DataFrame:
    """Rows of a sink that belong to the attempts in ``commits`` (run_id, attempt); others are not there.

    Delimited and JSON rows come back as text and as JSON infers them. The partition columns let a scan skip the folders of
    attempts that do not count.
    """
    marks = [T.StructField(RUN, T.StringType()), T.StructField(ATTEMPT, T.IntegerType())]
    if destination == "csv":
        names = existing_columns(spark, path)
        shape = T.StructType([T.StructField(c, T.StringType()) for c in names] + marks)
        rows = spark.read.schema(shape).options(**DELIMITED).csv(path)
    elif destination in ("jsonl", "db"):
        if destination == "db":
            path, found = _table_path(path, table), "parquet"
            shape = spark.read.option("mergeSchema", "true").parquet(path).schema
        else:
            found, shape = "json", spark.read.json(path).schema
        shape = T.StructType([f for f in shape.fields if f.name not in (RUN, ATTEMPT)] + marks)
        rows = spark.read.schema(shape).format(found).load(path)
    else:
        raise ValueError(f"no rows to read back: {destination!r}")
    counted = commits.select(F.col("run_id").alias(RUN), F.col("attempt").alias(ATTEMPT))
    return bounded_join(rows, counted, [RUN, ATTEMPT], options or Options(), "left_semi").drop(RUN, ATTEMPT)


def drop_attempts(spark: SparkSession, destination: str, path: str | None, load: Attempt, table: str | None = None) -> None:
    """Remove what other attempts of a run have left in a sink; they do not count any more."""
    if path is None or destination == "memory" or path.startswith("jdbc:"):
        return
    folder = _table_path(path, table) if destination == "db" else path
    key = partition_value(spark, load[0])
    for older in range(load[1]):
        remove_matching(spark, f"{folder}/{RUN}={key}/{ATTEMPT}={older}")


def write_database(frame: DataFrame, url: str, table: str, mode: str = "append", **properties: str) -> None:
    frame.write.mode(mode).jdbc(url, table, properties=properties)


def load_into(
    frame: DataFrame,
    destination: str,
    path: str | None = None,
    table: str | None = None,
    mode: str = "append",
    load: Attempt | None = None,
) -> int:
    """Write the rows and return how many there were, counted while they are written.

    With ``load``, a run and the number of its attempt, rows are put apart by both, and count for ``committed`` readers from the
    commit of the attempt on. A database gets them at once.
    """
    if destination not in DESTINATIONS:
        raise ValueError(f"unknown destination: {destination!r}")
    if not frame.columns:  # every batch was refused: there is no layout to write
        return 0
    seen = Observation()
    counted = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
    if destination == "csv":
        write_delimited(counted, path, load)
    elif destination == "jsonl":
        write_jsonl(counted, path, load)
    elif destination == "memory":
        counted.write.format("noop").mode("overwrite").save()
    elif path and path.startswith("jdbc:"):
        write_database(counted, path, table, mode)
    else:
        write_table(counted, _table_path(path, table), mode, load)
    return seen.get["rows"]
