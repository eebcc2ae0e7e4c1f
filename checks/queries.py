"""The registered queries: each runs an operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures as X
from driftwarden.functions import buckets, coercion
from driftwarden.functions.coercion import coerce
from driftwarden.functions.sql import named
from driftwarden.operators import alerts, drift, ledger, quarantine
from driftwarden.operators.joins import bounded_join
from driftwarden.operators.profile import profile, type_counts
from driftwarden.options import Options
from driftwarden.plans.load import Load
from driftwarden.plans.replay import replay
from driftwarden.plans.run import run
from driftwarden.plans.state import State, latest_runs
from driftwarden.plans.step import PASSING
from driftwarden.scratch import fresh_folder
from driftwarden.sources import sinks
from driftwarden.sources.batching import in_rows
from driftwarden.sources.delimited import delimited
from driftwarden.sources.frames import frame_pieces, pieces_of
from driftwarden.sources.json_lines import json_lines, json_text
from driftwarden.sources.pieces import BATCH, SOURCE, Piece, tag, with_own_names
from driftwarden.streaming import stream
from driftwarden.streaming.load import StreamingLoad

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}

RUN, PIPELINE = "r1", "etl_pipeline"
NOW = datetime(2024, 2, 1, tzinfo=UTC)
EVENT_SCHEMA = {
    "event_id": "integer", "ts": "datetime", "user_id": "integer",
    "event_type": "string", "value": "float", "props": "string",
}
MICROS = Options(datetime_formats=("yyyy-MM-dd HH:mm:ss.SSSSSS",))


def query(made: Query) -> Query:
    REGISTERED[made.__name__] = made
    return made


def batch_id() -> Column:
    return F.col(BATCH).alias("batch_id")


def moment() -> Column:
    return F.lit(NOW)


def event_load(spark: SparkSession, sf_dir: str, options: Options = Options()) -> Load:
    return Load(X.event_pieces(spark, sf_dir), options)


def joined(values, separator: str = ","):
    return F.array_join(values, separator)


def known_schema(spark: SparkSession, source_name: str, schema: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(
        [(source_name, 1, schema)], "source_name string, version int, schema map<string,string>"
    )


def events_by_range(spark: SparkSession, sf_dir: str) -> list[Piece]:
    events = X.table(spark, sf_dir, "events")
    return frame_pieces(events, "events", F.expr(f"event_id * {X.BATCHES} div {events.count()}"))


# -- sources and batching ----------------------------------------------------------------------


@query
def src_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "csv")
    sinks.write_delimited(X.table(spark, sf_dir, "events"), path)
    load = Load(delimited(spark, path, "events"), MICROS, known_schema(spark, "events", EVENT_SCHEMA))
    return load.clean.select(*EVENT_SCHEMA)


@query
def src_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "jsonl")
    sinks.write_jsonl(X.table(spark, sf_dir, "events"), path)
    load = Load(json_lines(spark, path, "events"), MICROS, known_schema(spark, "events", EVENT_SCHEMA))
    return load.clean.select(*EVENT_SCHEMA)


@query
def src_dataframe_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    (piece,) = frame_pieces(orders, "orders", batch_rows=1000, order_by=["o_orderdate", "o_orderkey"])
    return piece.frame.groupBy(batch_id()).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"),
        F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"),
    )


@query
def batch_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = in_rows(X.table(spark, sf_dir, "events").select("event_id"), 640, ["event_id"])
    return numbered.groupBy(batch_id()).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query
def extract_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {"events": "event_type", "orders": "o_orderpriority", "lineitem": "l_returnflag"}
    counted = [
        profile(
            pieces_of(spark, "dataframe", name, frame=X.table(spark, sf_dir, name), batch_by=F.col(key)),
            Options(),
        )
        for name, key in keys.items()
    ]
    batches = reduce(DataFrame.unionByName, counted)
    return batches.groupBy(F.col(SOURCE).alias("source_name")).agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n_rows").alias("n_rows")
    )


@query
def jsonl_skip_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "blank")
    orders = X.table(spark, sf_dir, "orders")
    line = F.to_json(F.struct("o_orderkey", "o_totalprice"))
    padded = F.when(F.col("o_orderkey") % 10 == 0, F.array(line, F.lit("   "), F.lit("")))
    orders.select(F.explode(F.coalesce(padded, F.array(line))).alias("value")).write.text(path)
    kept = json_text(spark, path)
    load = Load(json_lines(spark, path, "orders"))
    records = load.clean.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))
    lines = kept.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("key_sum"))
    return records.withColumn("what", F.lit("records")).unionByName(lines.withColumn("what", F.lit("lines")))


@query
def csv_na_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "missing")
    words = ["NA", "N/A", "NaN", "null", "None", "", "x"]
    word = F.array(*[F.lit(w) for w in words])[(F.col("o_orderkey") % len(words)).cast("int")]
    sinks.write_delimited(X.table(spark, sf_dir, "orders").select("o_orderkey", word.alias("word")), path)
    (piece,) = delimited(spark, path, "orders")
    return piece.frame.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("n_keys")
    )


@query
def malformed_to_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as text where some lines cannot be read, in both formats: what is loaded, and what is in quarantine with its place."""
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
    broken, found = F.col("o_orderkey") % 13 == 5, []
    as_csv = F.concat_ws(",", "o_orderkey", "o_totalprice", F.when(broken, F.lit("one,two too many")))
    as_json = F.when(broken, F.lit("{cut short")).otherwise(F.to_json(F.struct("o_orderkey", "o_totalprice")))
    for kind, line, read in (("csv", as_csv, delimited), ("jsonl", as_json, json_lines)):
        path = fresh_folder(spark, kind)
        orders.select(line.alias("line")).write.text(path)
        if kind == "csv":  # text files have no header: each gets one
            lines, path = spark.read.text(path), fresh_folder(spark, kind)
            lines.mapInArrow(_headed, "value string").write.text(path)
        load = Load(read(spark, path, "orders", on_malformed="quarantine"))
        lines = load.quarantined.select(F.from_json("record_json", "line string, file string, place bigint").alias("r")).select("r.*")
        good = load.clean.agg(F.lit("loaded").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))
        key = F.when(F.lit(kind == "csv"), F.expr("try_cast(split(line, ',')[0] as bigint)"))
        bad = lines.agg(F.lit("malformed").alias("what"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("key_sum"))
        total = load.totals.select(F.lit("extracted").alias("what"), F.col("rows_extracted").alias("n"), F.lit(None).cast("bigint").alias("key_sum"))
        files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        inside = lines.join(files, "file").where(F.col("place").between(1, F.col("n"))).groupBy("file").agg(F.countDistinct("place").alias("n"))
        places = inside.agg(F.lit("places").alias("what"), F.sum("n").alias("n"), F.lit(None).cast("bigint").alias("key_sum"))
        found.append(reduce(DataFrame.unionByName, [good, bad, total, places]).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, found)


def _headed(batches):
    import pyarrow as pa

    first = True
    for batch in batches:
        if first:
            yield pa.RecordBatch.from_pydict({"value": ["o_orderkey,o_totalprice"]})
        first = False
        yield batch


@query
def batches_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of rows over files of two headers: rows, first and last key of each."""
    path, orders = fresh_folder(spark, "mixed"), X.table(spark, sf_dir, "orders")
    half = F.col("o_orderkey") < orders.agg(F.expr("(min(o_orderkey) + max(o_orderkey)) div 2")).first()[0]
    for name, rows, columns in (("a", half, ["o_orderkey", "o_totalprice"]), ("b", ~half, ["o_orderpriority", "o_orderkey"])):
        part = orders.where(rows).select(*columns).coalesce(1).sortWithinPartitions("o_orderkey")
        part.write.options(**sinks.DELIMITED).csv(f"{path}/part={name}")
    pieces = delimited(spark, path, "orders", batch_rows=1000)
    key = F.col("o_orderkey").cast("bigint")
    counted = [
        p.frame.groupBy(batch_id()).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key")) for p in pieces
    ]
    return reduce(DataFrame.unionByName, counted)


# -- user transform and dispositions -------------------------------------------------------------


@query
def custom_transform_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    def normalise(frame: DataFrame) -> DataFrame:
        return frame.withColumns({
            "event_type": F.upper(F.trim("event_type")), "value": F.abs(F.col("value") - 250)
        })

    load = Load(events_by_range(spark, sf_dir), custom_transform=normalise)
    return load.clean.select("event_id", "event_type", "value")


@query
def transform_error_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def checked(frame: DataFrame) -> DataFrame:
        wrong = (F.col("event_id") % 3 == 0) & (F.col(BATCH) % 4 == 1)
        return frame.withColumn("_error", F.when(wrong, F.lit("event_id is a multiple of three")))

    load = Load(events_by_range(spark, sf_dir), custom_transform=checked)
    return load.quarantined.groupBy("batch_id", "error_type", "error_detail").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def strict_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = event_load(spark, sf_dir, Options(strict=True))
    return load.quarantined.select(
        "batch_id", "error_type", "error_detail", "schema_version",
        F.get_json_object("record_json", "$.event_id").try_cast("bigint").alias("event_id"),
    )


@query
def clean_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = event_load(spark, sf_dir)
    untouched = load.plan.where("disposition = 'CLEAN'").select(SOURCE, BATCH)
    rows = bounded_join(load.clean, untouched, [SOURCE, BATCH], load.options, "left_semi")
    return rows.select(batch_id(), "event_id", "ts", "user_id", "event_type", "value", "props", "region")


@query
def healing_failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).healing.rejected.select(
        "batch_id", "error_type", "error_detail", "schema_version",
        F.get_json_object("record_json", "$.event_id").try_cast("bigint").alias("event_id"),
    )


@query
def coercion_failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).healing.failures.select(
        "batch_id", "column_name", "error_type", "schema_version",
        F.get_json_object("record_json", "$.event_id").try_cast("bigint").alias("event_id"),
        F.get_json_object("record_json", "$.value").startswith("$").alias("keeps_raw_value"),
    )


@query
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).totals


@query
def excluded_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = event_load(spark, sf_dir, Options(on_coercion_failure="exclude"))
    return load.clean.groupBy(batch_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


@query
def evolving_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).plan.select(
        batch_id(), "n_rows", "disposition", "expected_version", "evolved_to", "loss",
        joined(F.col("added")).alias("added"), joined(F.col("removed")).alias("removed"),
    )


@query
def evolving_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type as a source of its own, folded side by side in many small partitions."""
    pieces = [
        Piece(p.frame.withColumn(SOURCE, F.col("event_type")), p.inferred) for p in X.event_pieces(spark, sf_dir)
    ]
    plan = Load(pieces, Options(batches_per_task=7)).plan
    return plan.select(
        F.col(SOURCE).alias("source_name"), batch_id(), "n_rows", "loss", "disposition", "expected_version", "evolved_to"
    )


@query
def stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches judged by the streaming query, arriving in two portions."""
    inbox, out, checkpoint = (fresh_folder(spark, name) for name in ("inbox", "verdicts", "stream"))
    pieces = X.event_pieces(spark, sf_dir)
    for arrived in (F.col(BATCH) < 5, F.col(BATCH) >= 5):
        portion = [Piece(p.frame.where(arrived), p.inferred) for p in pieces]
        stream.publish(portion, inbox, Options(), {"value": {"float"}, "event_id": {"integer"}})
        verdicts = stream.judge(stream.read_summaries(spark, inbox, 1000), Options())
        started = (
            verdicts.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            .option("path", out).option("checkpointLocation", checkpoint).start()
        )
        started.awaitTermination()
    return spark.read.parquet(out).select(
        "batch_id", "n_rows", "disposition", "expected_version", "evolved_to", "loss"
    )


# -- schema snapshot and drift ---------------------------------------------------------------------


@query
def type_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for name in ("events", "orders", "lineitem", "part"):
        frame = X.table(spark, sf_dir, name)
        counts = frame.agg(*[F.count(F.col(named(c))).alias(c) for c in frame.columns])
        pairs = [F.struct(F.lit(c).alias("column_name"), F.col(named(c)).alias("n_present")) for c in frame.columns]
        present = counts.select(F.inline(F.array(*pairs)))
        # one row per column of a table
        found.append(
            buckets.snapshot(frame).drop("ordinal").join(F.broadcast(present), "column_name")
            .withColumn("table_name", F.lit(name))
        )
    return reduce(DataFrame.unionByName, found)


@query
def schema_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events")
    observed = profile(frame_pieces(events, "events"), Options())
    return observed.select("n_rows", F.inline("observed")).select(
        F.col("column").alias("column_name"), "ordinal", "bucket", "n_rows"
    )


@query
def batch_type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events")
    total = events.count()
    value = F.col("value").cast("string")
    text = events.select(
        F.expr(f"event_id * {X.BATCHES} div {total}").alias("b"),
        F.col("event_id").cast("string").alias("id_text"),
        F.when(F.col("event_id") % 40 == 0, F.concat(F.lit("$"), value)).otherwise(value).alias("price_text"),
        value.alias("value_text"),
        F.when(F.col("event_id") % 2 == 0, "true").otherwise("False").alias("flag_text"),
        F.when(F.col("user_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time_text"),
    )
    names = [c for c in text.columns if c != "b"]
    piece = Piece(tag(text.select(*names, F.col("b").alias(BATCH)), "events", F.col(BATCH)), dict.fromkeys(names, "text"))
    return type_counts(piece, Options()).drop(SOURCE).withColumnRenamed(BATCH, "batch_id")


@query
def drift_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).plan.select(batch_id(), F.explode("added").alias("column_name"))


@query
def drift_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).plan.select(batch_id(), F.explode("removed").alias("column_name"))


@query
def drift_type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        event_load(spark, sf_dir).plan.select(batch_id(), F.inline("type_changes"))
        .toDF("batch_id", "column_name", "old_bucket", "new_bucket")
    )


@query
def drift_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).plan.select(batch_id(), "has_drift", "drift_types")


@query
def drift_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).plan.select(batch_id(), joined(F.col("hints"), "\n").alias("hints"))


@query
def drift_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = event_load(spark, sf_dir).plan.where("has_drift")
    shape = (
        "added_columns array<string>, removed_columns array<string>, "
        "type_changes map<string,array<string>>, root_cause_hints array<string>"
    )
    parsed = plan.select(batch_id(), F.from_json(drift.details_json(), shape).alias("d"))
    changes = F.transform(
        F.map_entries("d.type_changes"), lambda e: F.concat_ws(":", e["key"], F.array_join(e["value"], ">"))
    )
    return parsed.select(
        "batch_id", joined(F.col("d.added_columns")).alias("added"),
        joined(F.col("d.removed_columns")).alias("removed"), joined(changes).alias("type_changes"),
        F.size("d.root_cause_hints").cast("bigint").alias("n_hints"),
    )


@query
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).plan.select(batch_id(), "summary")


@query
def drift_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, observed = X.catalogs(spark, sf_dir)
    return drift.compare_catalogs(expected, observed, ["source_name"])


@query
def drift_catalog_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, observed = X.catalogs(spark, sf_dir)
    found = drift.catalog_reports(drift.compare_catalogs(expected, observed, ["source_name"]), ["source_name"])
    return found.select(
        "source_name", "drift_types", joined(F.col("added")).alias("added"),
        joined(F.col("removed")).alias("removed"), F.size("type_changes").cast("bigint").alias("n_type_changes"),
    )


# -- schema ledger -----------------------------------------------------------------------------------


@query
def registry_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.active(X.schema_ledger(spark, sf_dir), "schema_json")


@query
def registry_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.flagged(X.schema_ledger(spark, sf_dir), Options()).select("source_name", "version", "is_active")


@query
def registry_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.history(X.schema_ledger(spark, sf_dir), "Brand#7")


@query
def registry_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.next_version(X.schema_ledger(spark, sf_dir))


def _schema_text(schema):
    pairs = F.transform(F.map_entries(schema), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return F.array_join(F.array_sort(pairs), ",")


@query
def registry_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events")
    key = F.expr(f"event_id * {X.BATCHES} div {events.count()}")
    by_type = events.withColumns({SOURCE: F.col("event_type"), BATCH: key})
    made = ledger.registrations(Load([Piece(by_type)]).plan, RUN, moment())
    return made.select("source_name", "version", "kind", _schema_text("schema").alias("schema_text"))


@query
def registry_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ledger.registrations(event_load(spark, sf_dir).plan, RUN, moment())
    return made.select("batch_id", "version", "kind", _schema_text("schema").alias("schema_text"))


# -- healing -----------------------------------------------------------------------------------------


@query
def heal_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = event_load(spark, sf_dir).clean
    return clean.select(
        batch_id(), "event_id", F.col("props").isNull().alias("no_props"), F.col("region").isNull().alias("no_region")
    )


@query
def heal_keep_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = event_load(spark, sf_dir).clean
    return clean.where(F.col("region").isNotNull()).select("event_id", "region")


@query
def heal_drop_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = event_load(spark, sf_dir, Options(schema_evolution=False)).clean
    names = ",".join(sorted(c for c in clean.columns if c not in (SOURCE, BATCH)))
    return clean.select("event_id", "value", F.lit(names).alias("column_names"))


@query
def heal_coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).clean.select("event_id", "value", "ts", "user_id")


def _coerced(text: DataFrame, target: str, options: Options = Options()) -> DataFrame:
    data_type = text.schema["txt"].dataType
    number = None
    if isinstance(data_type, T.StringType):
        text, number = coercion.with_numbers(text, ["txt"]), coercion.number_column("txt")
    failed = coercion.losing("txt", data_type, target, options, number) or "false"
    return text.groupBy("txt", F.expr(coerce("txt", data_type, target, options, number)).alias("result")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"count_if({failed})").alias("n_failed")
    )


@query
def coerce_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coerced(X.numeric_text(spark, sf_dir), "integer")


@query
def coerce_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coerced(X.numeric_text(spark, sf_dir), "float")


@query
def coerce_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coerced(X.boolean_text(spark, sf_dir), "boolean")


@query
def coerce_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")
    found = _coerced(X.datetime_text(spark, sf_dir), "datetime", Options(datetime_formats=formats))
    return found.withColumn("result", F.date_format("result", "yyyy-MM-dd HH:mm:ss"))


@query
def coerce_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = X.table(spark, sf_dir, "lineitem")
    return _coerced(items.select(F.when(F.col("l_partkey") % 50 != 0, F.col("l_orderkey")).alias("txt")), "string")


@query
def coerce_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values moved between buckets: numbers, booleans and times."""
    items, options = X.table(spark, sf_dir, "lineitem"), Options()
    kind = dict(items.dtypes)
    typed = {name: items.schema[name].dataType for name in kind}

    def to(name: str, target: str):
        return F.expr(coerce(name, typed[name], target, options))

    return items.select(
        to("l_quantity", "integer").alias("quantity_integer"), to("l_tax", "integer").alias("tax_integer"),
        to("l_tax", "boolean").alias("tax_boolean"), to("l_linenumber", "float").alias("line_float"),
        to("l_linenumber", "boolean").alias("line_boolean"), to("l_shipdate", "integer").alias("ship_integer"),
    ).groupBy("quantity_integer", "tax_integer", "tax_boolean", "line_float", "line_boolean").agg(
        F.count(F.lit(1)).alias("n"), F.min("ship_integer").alias("first_ship")
    )


@query
def batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = event_load(spark, sf_dir)
    lost = F.aggregate(
        F.filter("observed", lambda c: c["column"] == "value"), F.lit(0).cast("bigint"),
        lambda total, c: total + F.coalesce(c["lost"][F.lit("float")], F.lit(0)),
    )
    return load.profiled.select(batch_id(), F.col("n_rows").alias("n"), lost.alias("lost"))


@query
def loss_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).plan.select(
        batch_id(), F.col("n_rows").alias("n"), F.col("loss").alias("lost"), F.round("loss_pct", 6).alias("pct"), "disposition"
    )


@query
def healing_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_load(spark, sf_dir).plan.select(batch_id(), quarantine.healing_summary().alias("actions"))


SWITCHES = {
    "no_backfill": Options(column_backfill=False),
    "no_coercion": Options(type_coercion=False),
    "no_evolution": Options(schema_evolution=False),
    "gate_2pct": Options(max_coercion_loss_pct=2.0),
}


@query
def heal_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = []
    for name, options in SWITCHES.items():
        plan = event_load(spark, sf_dir, options).plan
        made.append(plan.select(
            F.lit(name).alias("setting"), batch_id(), "disposition", "expected_version", "evolved_to", "loss",
            joined(F.col("added")).alias("added"), joined(F.col("removed")).alias("removed"),
        ))
    return reduce(DataFrame.union, made)


# -- quarantine and drift events -----------------------------------------------------------------------


@query
def quarantine_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = State(spark, fresh_folder(spark, "state"))
    made = quarantine.records(event_load(spark, sf_dir).quarantined, PIPELINE, RUN, moment())
    state.write_records(made)
    state.write_records(made)  # repeating a run changes nothing
    return state.records().groupBy("source_name", "run_id", "batch_id", "error_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"),
        F.count_if("resolved").alias("n_resolved"),
    )


@query
def quarantine_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = "event_id bigint, ts string, user_id bigint, event_type string, value string, props string"
    parsed = event_load(spark, sf_dir).quarantined.select(
        "batch_id", F.from_json("record_json", shape).alias("r"),
        F.array_join(F.array_sort(F.json_object_keys("record_json")), ",").alias("keys"),
    )
    number = F.replace(F.col("r.value"), F.lit("$"), F.lit("")).try_cast("double")
    return parsed.select(
        "batch_id", "keys", "r.event_id", "r.ts", "r.user_id", "r.event_type", "r.props", number.alias("value"),
        F.col("r.value").startswith("$").alias("priced"),
    )


@query
def drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quarantine.drift_events(event_load(spark, sf_dir).plan, PIPELINE, RUN, moment())
    return made.select("batch_id", "drift_type", "healed", "healing_action")


@query
def drift_events_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(NOW) + F.make_dt_interval(F.col(BATCH).cast("int"))
    made = quarantine.drift_events(event_load(spark, sf_dir).plan, PIPELINE, RUN, at)
    return quarantine.latest_events(made, "events", 5).select("batch_id", "id", "drift_type", "healed")


@query
def quarantine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quarantine.latest(X.quarantine_records(spark, sf_dir), source_name="1-URGENT")
    return found.select("id", "error_type", "quarantined_at")


@query
def quarantine_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = X.quarantine_records(spark, sf_dir).drop("resolved")
    done = stored.where(F.col("id") % 6 == 0).select("id")
    return quarantine.with_resolution(stored, done).groupBy("error_type", "resolved").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum")
    )


@query
def quarantine_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(datetime(1999, 1, 1)).cast("timestamp_ntz")
    left = quarantine.purged(X.quarantine_records(spark, sf_dir), 30, now)
    return left.select("id", "error_type", "quarantined_at", "resolved")


def _kept_records(spark: SparkSession, sf_dir: str) -> State:
    """A state that holds the records, with every second one resolved by its id."""
    state, rows = State(spark, fresh_folder(spark, "state")), X.quarantine_records(spark, sf_dir)
    nothing = {c: F.lit(None).cast("string") for c in ("batch_id", "column_name", "record_json", "error_detail", "root_cause_hint")}
    stored = rows.withColumns({
        "id": F.col("id").cast("string"), "schema_version": F.lit(1), "quarantined_at": F.col("quarantined_at").cast("timestamp"), **nothing
    })
    state.write_records(stored)
    state.mark_resolved(rows.where("resolved").select(F.col("id").cast("string").alias("id")))
    return state


@query
def quarantine_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that a state keeps, resolved by id and purged: what was purged, and what is left."""
    state = _kept_records(spark, sf_dir)
    gone = state.purge(30, F.lit("1999-01-01").cast("timestamp"))
    left = state.records().groupBy("error_type", "resolved").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("bigint")).alias("id_sum"))
    return left.withColumn("purged", F.lit(gone).cast("bigint"))


@query
def quarantine_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per day, source and error type, from the daily counts of the runs; a purge does not change them."""
    state = _kept_records(spark, sf_dir)
    state.purge(30, F.lit("1999-01-01").cast("timestamp"))
    return state.trend()


@query
def quarantine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = X.quarantine_records(spark, sf_dir)
    everything = quarantine.stats(stored).withColumn("pipeline_name", F.lit("all"))
    return everything.unionByName(quarantine.stats(stored, "p1").withColumn("pipeline_name", F.lit("p1")))


@query
def quarantine_stats_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.stats_sets(X.quarantine_records(spark, sf_dir))


@query
def quarantine_count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.count_by(X.quarantine_records(spark, sf_dir), "run_id")


# -- sinks ---------------------------------------------------------------------------------------------


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = X.table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    return orders.where(even), orders.where(~even)


@query
def sink_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "sink")
    first, second = _halves(spark, sf_dir)
    sinks.load_into(first, "csv", path)
    # other column order, one column fewer and one more: still matched by name
    moved = second.select("o_orderpriority", "o_totalprice", "o_orderkey", "o_custkey", F.lit("b").alias("half"))
    sinks.load_into(moved, "csv", path)
    load = Load(delimited(spark, path, "orders"))
    return load.clean.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "half")


@query
def sink_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "sink")
    for half in _halves(spark, sf_dir):
        sinks.load_into(half, "jsonl", path)
    shape = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return spark.read.schema(shape).json(path)


@query
def sink_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "sink")
    first, second = _halves(spark, sf_dir)
    sinks.load_into(second, "db", path, "orders_clean", "overwrite")
    sinks.load_into(first, "db", path, "orders_clean", "overwrite")
    sinks.load_into(second, "db", path, "orders_clean")
    return spark.read.parquet(f"{path}/orders_clean")


@query
def sink_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = ("events", "lineitem", "orders")
    counts = [(name, sinks.load_into(X.table(spark, sf_dir, name), "memory")) for name in tables]
    return spark.createDataFrame(counts, "table_name string, n bigint")


# -- names, types and runs that go wrong easily ---------------------------------------------------------


@query
def reserved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data columns with names that a load uses itself, through every kind of source."""
    events = X.table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("_source"), F.col("props").alias("_error"),
        F.col("user_id").alias("_tokens"), F.col("value").alias("_batch"),
    )
    as_csv, as_json = fresh_folder(spark, "csv"), fresh_folder(spark, "jsonl")
    sinks.write_delimited(events, as_csv)
    sinks.write_jsonl(events, as_json)
    sources = {
        "frame": frame_pieces(events, "events", F.expr("_tokens % 3")),
        "csv": delimited(spark, as_csv, "events"),
        "jsonl": json_lines(spark, as_json, "events"),
    }
    found = [
        with_own_names(Load(pieces).clean.drop(SOURCE, BATCH)).select(*events.columns, F.lit(via).alias("via"))
        for via, pieces in sources.items()
    ]
    return reduce(DataFrame.unionByName, found)


@query
def late_typed_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is all null at first, then integer, then text: the text is a change of type."""
    events, third = X.table(spark, sf_dir, "events"), F.expr("event_id % 3")
    shown = [F.lit(None), F.col("user_id"), F.col("event_type")]
    pieces = [
        Piece(tag(events.where(third == i).select("event_id", value.alias("late")), "events", F.lit(i)))
        for i, value in enumerate(shown)
    ]
    load = Load(pieces)
    kinds = F.array_join(F.transform("registrations", lambda r: r["kind"]), ",")
    return load.plan.select(
        batch_id(), "n_rows", "disposition", "expected_version", "has_drift", kinds.alias("registered")
    )


@query
def run_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that drifts and fails at its sink, then the same run id again on input without drift."""
    state, pieces = State(spark, fresh_folder(spark, "state")), X.event_pieces(spark, sf_dir)
    seen = []
    for attempt, given, sink in ((1, pieces, "nowhere"), (2, pieces[:1], "memory")):
        try:
            run(spark, state, "events", sink, pieces=given, run_id=RUN, now=NOW, options=Options(min_severity="DEBUG"))
        except ValueError:
            pass
        raised = state.alerts().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "CRITICAL").alias("bad")).first()
        seen.append((
            attempt, state.runs().first()["status"], raised["n"], raised["bad"], state.drift_events().count(),
            state.records().count(), state.versions().agg(F.max("version")).first()[0],
        ))
    return spark.createDataFrame(
        seen, "attempt int, status string, alerts bigint, failures bigint, drift_events bigint, records bigint, version int"
    )


def _stand(step: int, state: State, path: str, told: dict) -> tuple:
    """What a run or replay did, and what is in the sink, in quarantine and in the ledger after it."""
    left = state.records().where(~F.col("resolved")).count()
    return (
        step, told["rows_extracted"], told["rows_loaded"], told["rows_quarantined"], left,
        state.loaded("jsonl", path).count(), state.versions().agg(F.max("version")).first()[0],
    )


_STAND = "step int, rows_extracted bigint, rows_loaded bigint, rows_left bigint, unresolved bigint, sink_rows bigint, version int"


@query
def quarantine_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load with refused batches (1), replayed (2), the same replay again (3), and one more after the price has become text (4)."""
    state, path = State(spark, fresh_folder(spark, "state")), fresh_folder(spark, "sink")
    told = run(spark, state, "events", "jsonl", pieces=X.event_pieces(spark, sf_dir), destination_path=path, run_id=RUN, now=NOW)
    seen = [_stand(1, state, path, told)]
    for step, name in ((2, "p1"), (3, "p1"), (4, "p2")):
        if step == 4:
            schema = dict(state.active(["events"]).first()["schema"]) | {"value": "string"}
            state.write_versions(ledger.register(state.versions(), "events", schema, "by-hand", moment()))
        told = replay(spark, state, "events", "jsonl", destination_path=path, run_id=name, now=NOW)
        seen.append(_stand(step, state, path, told))
    return spark.createDataFrame(seen, _STAND)


@query
def sink_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run into files (1), the same run again (2), and rows of an attempt that was never committed (3)."""
    state, path = State(spark, fresh_folder(spark, "state")), fresh_folder(spark, "sink")
    pieces, seen = X.event_pieces(spark, sf_dir), []
    for step in (1, 2):
        told = run(spark, state, "events", "jsonl", pieces=pieces, destination_path=path, run_id=RUN, now=NOW)
        seen.append(_stand(step, state, path, told))
    told["rows_loaded"] = sinks.load_into(X.table(spark, sf_dir, "events"), "jsonl", path, load=(RUN, 2))
    seen.append(_stand(3, state, path, told))
    return spark.createDataFrame(seen, _STAND)


@query
def streaming_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten files of events that arrive in two halves, loaded as a stream in micro-batches of up to five; a new object goes on after the first."""
    state, folder = State(spark, fresh_folder(spark, "state")), fresh_folder(spark, "arriving")
    sink, pieces, seen = fresh_folder(spark, "sink"), X.event_pieces(spark, sf_dir), []
    layout = [0, 0, 0, 1, 2, 3, 4, 3, 5, 1]
    for step, numbers in ((1, range(5)), (2, range(5, 10))):
        for k in numbers:
            rows = pieces[layout[k]].frame.where(F.col(BATCH) == k).drop(SOURCE, BATCH).coalesce(1)
            sinks.write_jsonl(rows, f"{folder}/b{k}")
        told = StreamingLoad(spark, state, "arriving", "events", folder, "jsonl", destination_path=sink, max_files=5).drain(NOW)
        seen.append((
            step, len(told), *(sum(t[c] for t in told) for c in ("rows_extracted", "rows_loaded", "rows_quarantined")),
            state.loaded("jsonl", sink).count(), state.records().count(), state.versions().agg(F.max("version")).first()[0],
        ))
    return spark.createDataFrame(
        seen, "step int, micro_batches int, rows_extracted bigint, rows_loaded bigint, rows_quarantined bigint, sink_rows bigint, records bigint, version int"
    )


# -- runs and alerts -------------------------------------------------------------------------------------


def _recorded_run(spark: SparkSession, sf_dir: str) -> tuple[State, dict]:
    state = State(spark, fresh_folder(spark, "state"))
    summary = run(
        spark, state, "events", "memory", pieces=X.event_pieces(spark, sf_dir), run_id=RUN, now=NOW
    )
    return state, summary


@query
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = _recorded_run(spark, sf_dir)
    return state.runs().select(
        "run_id", "pipeline_name", "source_name", "status", "rows_extracted", "rows_loaded",
        "rows_quarantined", "drift_detected", F.col("finished_at").isNotNull().alias("finished"),
    )


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, summary = _recorded_run(spark, sf_dir)
    shape = (
        "run_id string, source string, status string, rows_extracted bigint, rows_loaded bigint, "
        "rows_quarantined bigint, schema_evolved boolean, drift_detected boolean"
    )
    return spark.createDataFrame([summary], shape)


@query
def run_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs told from status events: every order opens a run, shipped ones close it."""
    orders = X.table(spark, sf_dir, "orders")
    run_id = F.concat(F.lit("r"), F.col("o_orderkey"))
    opened = orders.select(run_id.alias("run_id"), F.lit("RUNNING").alias("status"), F.lit(0).alias("seq"))
    closed = orders.where("o_orderstatus <> 'O'").select(
        run_id.alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("FAILED").alias("status"),
        F.lit(1).alias("seq"),
    )
    return latest_runs(opened.union(closed)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _event_alerts(spark: SparkSession, sf_dir: str, options: Options = Options(min_severity="DEBUG")) -> DataFrame:
    return alerts.plan_alerts(event_load(spark, sf_dir).plan, options, RUN, moment())


@query
def alerts_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = "struct<alert:struct<title:string,severity:string,timestamp:string,run_id:string>,summary:string>"
    parsed = F.from_json(alerts.record_json(), shape)
    return _event_alerts(spark, sf_dir).select("batch_id", parsed.alias("r")).select(
        "batch_id", "r.alert.title", "r.alert.severity", "r.alert.run_id", "r.summary",
        F.col("r.alert.timestamp").alias("at"),
    )


@query
def alerts_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole alert records: how many hints and actions, the types of the metrics, and the rows they tell."""
    record = F.parse_json(alerts.record_json()).alias("r")
    return _event_alerts(spark, sf_dir).select("batch_id", record).selectExpr(
        "batch_id", "variant_get(r, '$.alert.title', 'string') AS title",
        "size(variant_get(r, '$.root_cause_hints', 'array<string>')) AS n_hints",
        "size(variant_get(r, '$.suggested_actions', 'array<string>')) AS n_actions",
        "schema_of_variant(variant_get(r, '$.metrics', 'variant')) AS shape",
        "coalesce(try_variant_get(r, '$.metrics.rows', 'bigint'), try_variant_get(r, '$.metrics.rows_healed', 'bigint')) AS n",
    )


@query
def alerts_min_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _event_alerts(spark, sf_dir, Options(min_severity="error"))
    return found.groupBy("severity", "title").agg(F.count(F.lit(1)).alias("n"))


@query
def alerts_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = alerts.drift_alerts(event_load(spark, sf_dir).plan, PIPELINE, RUN, moment())
    metrics = F.transform(F.map_entries("metrics"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return made.select(
        "batch_id", "severity", "summary", joined(F.col("suggested_actions"), "|").alias("suggested"),
        joined(metrics, "|").alias("metrics_text"),
    )


@query
def alerts_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = alerts.quarantine_alerts(event_load(spark, sf_dir).plan, PIPELINE, RUN, moment())
    return made.select(
        "batch_id", "severity", "title", "summary", joined(F.col("suggested_actions"), "|").alias("suggested")
    )


@query
def alerts_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = X.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("r"), F.col("o_orderkey")).alias("run_id"),
        F.concat(F.lit("p"), F.col("o_custkey") % 3).alias("pipeline_name"),
        F.col("o_orderpriority").alias("source_name"),
        F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" is late")).alias("error_message"),
    )
    made = alerts.failure_alerts(failed, moment())
    return made.select("run_id", "severity", "summary", joined(F.col("suggested_actions"), "|").alias("suggested"))


@query
def alerts_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = (
        "struct<attachments:array<struct<color:string,title:string,text:string,footer:string,"
        "fields:array<struct<title:string,value:string,short:boolean>>>>>"
    )
    parsed = F.from_json(alerts.chat_payload("driftwarden"), shape)["attachments"][0]
    return _event_alerts(spark, sf_dir).select("batch_id", parsed.alias("a")).select(
        "batch_id", "a.color", "a.title", "a.text", "a.footer",
        F.array_join(F.transform("a.fields", lambda f: f["title"]), ",").alias("field_titles"),
        F.col("a.fields")[5]["value"].alias("suggested"),
    )


@query
def alerts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = alerts.quarantine_alerts(event_load(spark, sf_dir).plan, PIPELINE, RUN, moment())
    return made.select("batch_id", alerts.human_text().alias("text"))
