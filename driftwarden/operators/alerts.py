"""Alerts as rows: derived from the batch plan and from failed runs. Delivery is not built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.functions import wording as W
from driftwarden.operators.quarantine import healing_summary
from driftwarden.options import Options
from driftwarden.plans.step import COERCION_FAILURE, HEALED, HEALING_FAILED
from driftwarden.sources.pieces import BATCH, SOURCE

ALERTS = """
    source_name string, run_id string, title string, severity string, pipeline_name string,
    batch_id string, summary string, root_cause_hints array<string>, suggested_actions array<string>,
    metrics map<string,string>, alerted_at timestamp
"""


def severity_rank(name: str) -> int:
    """Rank of a severity name; an unknown name is a KeyError."""
    return W.SEVERITIES[name.upper()]


def at_least(alerts: DataFrame, min_severity: str) -> DataFrame:
    least = severity_rank(min_severity)
    return alerts.where(F.col("severity").isin(*[n for n, rank in W.SEVERITIES.items() if rank >= least]))


def _columns(title: str, severity: Column, about: dict[str, Column], at: Column) -> list[Column]:
    return [
        about["source_name"].alias("source_name"), about["run_id"].alias("run_id"),
        F.lit(title).alias("title"), severity.alias("severity"),
        about["pipeline_name"].alias("pipeline_name"), about["batch_id"].alias("batch_id"),
        about["summary"].alias("summary"), about["hints"].alias("root_cause_hints"),
        about["actions"].alias("suggested_actions"), about["metrics"].alias("metrics"),
        at.alias("alerted_at"),
    ]


def _metrics(**values: Column) -> Column:
    pairs = [part for name, value in values.items() for part in (F.lit(name), value.cast("string"))]
    return F.create_map(*pairs)


def _about_batch(pipeline_name: str, run_id: str, **more: Column) -> dict[str, Column]:
    return {
        "source_name": F.col(SOURCE), "run_id": F.lit(run_id), "pipeline_name": F.lit(pipeline_name),
        "batch_id": F.col(BATCH).cast("string"), "hints": F.col("hints"), **more,
    }


def drift_alerts(plan: DataFrame, pipeline_name: str, run_id: str, at: Column) -> DataFrame:
    """One per drifted batch: a warning when healed, an error otherwise."""
    healed = F.col("disposition") == HEALED
    phrase = F.when(healed, F.lit(W.HEALED_PHRASE)).otherwise(F.lit(W.UNHEALED_PHRASE))
    batch, rows = F.col(BATCH), F.col("n_rows")
    refused = F.col("disposition") == HEALING_FAILED
    metrics = (
        F.when(healed, _metrics(batch_index=batch, rows_healed=rows, rows_coerced=F.col("loss"),
                                actions=healing_summary()))
        .when(refused, _metrics(batch_index=batch, rows=rows, coercion_loss=F.col("loss")))
        .otherwise(_metrics(batch_index=batch, rows=rows))
    )
    about = _about_batch(
        pipeline_name, run_id,
        summary=F.format_string(W.DRIFT_SUMMARY, F.col(SOURCE), phrase, F.col("summary")),
        actions=F.when(healed, W.texts(W.DRIFT_ACTIONS + W.HEALED_ACTIONS)).otherwise(
            W.texts(W.DRIFT_ACTIONS + W.UNHEALED_ACTIONS)
        ),
        metrics=metrics,
    )
    severity = F.when(healed, F.lit("WARNING")).otherwise(F.lit("ERROR"))
    return plan.where("has_drift").select(*_columns(W.DRIFT_TITLE, severity, about, at))


def quarantine_alerts(plan: DataFrame, pipeline_name: str, run_id: str, at: Column) -> DataFrame:
    """One per healed batch with cells that could not be coerced."""
    lossy = (F.col("disposition") == HEALED) & (F.col("loss") > 0)
    about = _about_batch(
        pipeline_name, run_id,
        summary=F.format_string(W.QUARANTINE_SUMMARY, F.col("loss"), F.col(SOURCE), F.lit(COERCION_FAILURE)),
        actions=W.texts(W.QUARANTINE_ACTIONS),
        metrics=_metrics(batch_index=F.col(BATCH)),
    )
    return plan.where(lossy).select(*_columns(W.QUARANTINE_TITLE, F.lit("ERROR"), about, at))


def failure_alerts(failed_runs: DataFrame, at: Column, endpoints: str = "") -> DataFrame:
    """One per failed run (run_id, pipeline_name, source_name, error_message)."""
    hints = W.texts([*W.FAILURE_HINTS, endpoints] if endpoints else W.FAILURE_HINTS)
    about = {
        "source_name": F.col("source_name"), "run_id": F.col("run_id"),
        "pipeline_name": F.col("pipeline_name"), "batch_id": F.lit(None).cast("string"),
        "summary": F.format_string(W.FAILURE_SUMMARY, F.col("pipeline_name"), F.col("error_message")),
        "hints": hints, "actions": W.texts(W.FAILURE_ACTIONS),
        "metrics": F.create_map().cast("map<string,string>"),
    }
    return failed_runs.select(*_columns(W.FAILURE_TITLE, F.lit("CRITICAL"), about, at))


def plan_alerts(plan: DataFrame, options: Options, run_id: str, at: Column) -> DataFrame:
    """All alerts of a load at or above the minimum severity."""
    name = options.pipeline_name
    both = drift_alerts(plan, name, run_id, at).unionByName(quarantine_alerts(plan, name, run_id, at))
    return at_least(both, options.min_severity)


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def record_json() -> Column:
    """An alert as a nested JSON record."""
    head = F.struct(
        "title", "severity", _iso(F.col("alerted_at")).alias("timestamp"),
        F.col("pipeline_name").alias("pipeline"), F.col("source_name").alias("source"), "run_id",
    )
    return F.to_json(
        F.struct(head.alias("alert"), "summary", "root_cause_hints", "suggested_actions", _typed_metrics().alias("metrics"))
    )


#: Metrics that are text also where they look like a number.
_TEXTS = ("actions",)


def _typed_metrics() -> Column:
    """The metrics as a nested value: counts as numbers, the rest as text."""

    def entry(e: Column) -> Column:
        text = F.to_json(F.array(e["value"]))
        number = ~e["key"].isin(*_TEXTS) & e["value"].rlike("^-?(0|[1-9][0-9]{0,17})$")
        name = F.to_json(F.array(e["key"]))
        value = F.when(number, e["value"]).otherwise(_inside(text))
        return F.concat(_inside(name), F.lit(":"), value)

    pairs = F.array_join(F.transform(F.map_entries("metrics"), entry), ",")
    return F.parse_json(F.concat(F.lit("{"), pairs, F.lit("}")))


def _inside(listed: Column) -> Column:
    """The one value of a JSON list."""
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _bullets(lines: Column) -> Column:
    text = F.array_join(F.transform(lines, lambda line: F.concat(F.lit("• "), line)), "\n")
    return F.when(text == "", F.lit(W.NOTHING_LISTED)).otherwise(text)


def chat_payload(footer: str) -> Column:
    """An alert as the JSON body of a chat webhook message."""
    colors = F.create_map(*[F.lit(part) for pair in W.COLORS.items() for part in pair])

    def entry(title: str, value: Column, short: bool) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short"))

    attachment = F.struct(
        F.coalesce(colors[F.col("severity")], F.lit(W.COLORS["DEBUG"])).alias("color"),
        F.format_string("[%s] %s", "severity", "title").alias("title"),
        F.col("summary").alias("text"),
        F.array(
            entry("Pipeline", F.col("pipeline_name"), True),
            entry("Source", F.col("source_name"), True),
            entry("Run ID", F.col("run_id"), True),
            entry("Time", _iso(F.col("alerted_at")), True),
            entry("Root-cause hints", _bullets(F.col("root_cause_hints")), False),
            entry("Suggested actions", _bullets(F.col("suggested_actions")), False),
        ).alias("fields"),
        F.lit(footer).alias("footer"),
    )
    return F.to_json(F.struct(F.array(attachment).alias("attachments")))


def human_text() -> Column:
    """An alert as plain text; the summary stays on one line."""
    rule = F.lit("=" * 60)

    def section(title: str, lines: Column) -> Column:
        head = ["", title, "-" * len(title)]
        return F.when(W.some(lines), F.concat(W.texts(head), lines)).otherwise(F.array().cast("array<string>"))

    metrics = F.transform(
        F.map_entries("metrics"), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])
    )

    def indented(lines: str) -> Column:
        return F.transform(F.col(lines), lambda line: F.concat(F.lit("  • "), line))

    head = F.array(
        rule,
        F.format_string("[%s] %s", "severity", "title"),
        F.concat(F.lit("Pipeline : "), "pipeline_name"),
        F.concat(F.lit("Source   : "), "source_name"),
        F.concat(F.lit("Run ID   : "), "run_id"),
        F.concat(F.lit("Time     : "), _iso(F.col("alerted_at"))),
    )
    body = F.concat(
        head,
        section("Summary", F.array("summary")),
        section("Metrics", metrics),
        section("Root-cause hints", indented("root_cause_hints")),
        section("Suggested actions", indented("suggested_actions")),
        F.array(rule),
    )
    return F.array_join(body, "\n")
