"""SQL counterparts of the registered queries, written against the rules and not the library.

The fold is a recursive query over the ten event batches: state in, verdict and next state out.
"""

from __future__ import annotations

NUMBER = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"

_COLUMNS = {
    "events": {"event_id": "BIGINT", "ts": "TIMESTAMP", "user_id": "BIGINT", "event_type": "VARCHAR",
               "value": "DOUBLE", "props": "VARCHAR"},
    "orders": {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "VARCHAR",
               "o_totalprice": "DOUBLE", "o_orderdate": "TIMESTAMP", "o_orderpriority": "VARCHAR"},
    "lineitem": {"l_orderkey": "BIGINT", "l_partkey": "BIGINT", "l_suppkey": "BIGINT", "l_linenumber": "INTEGER",
                 "l_quantity": "DOUBLE", "l_extendedprice": "DOUBLE", "l_discount": "DOUBLE", "l_tax": "DOUBLE",
                 "l_returnflag": "VARCHAR", "l_linestatus": "VARCHAR", "l_shipdate": "TIMESTAMP"},
    "part": {"p_partkey": "BIGINT", "p_name": "VARCHAR", "p_brand": "VARCHAR", "p_type": "VARCHAR",
             "p_size": "INTEGER", "p_retailprice": "DOUBLE"},
}

_BASE = {
    "event_id": "integer", "ts": "datetime", "user_id": "integer",
    "event_type": "string", "value": "float", "props": "string",
}


def _layout(batch: int) -> dict[str, str]:
    columns = dict(_BASE)
    if batch in (4, 6):
        del columns["props"]
    if batch in (5, 6, 7):
        columns["value"] = "string"
    if batch == 8:
        columns["event_id"] = "string"
    if batch in (3, 6, 9):
        columns["region"] = "string"
    return columns


def _map(columns: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{c}': '{b}'" for c, b in columns.items()) + "}"


_LAYOUTS = ",\n".join(f"({b}, {_map(_layout(b))})" for b in range(10))

_CELLS = f"""
total AS (SELECT count(*) AS n FROM events),
cells AS (
  SELECT e.*, e.event_id * 10 // t.n AS b,
    CASE WHEN (e.event_id * 10 // t.n IN (5, 6) AND e.event_id % 40 = 0)
           OR (e.event_id * 10 // t.n = 7 AND e.event_id % 10 = 0)
         THEN '$' || CAST(e.value AS VARCHAR) ELSE CAST(e.value AS VARCHAR) END AS price
  FROM events e, total t),
lossy AS (
  SELECT *, price IS NOT NULL AND NOT regexp_matches(price, '{NUMBER}') AS bad FROM cells),
layouts(b, observed) AS (VALUES {_LAYOUTS})
"""

_HAS = "list_contains(map_keys({m}), c)"


def fold(strict=False, evolution=True, coercion=True, backfill=True, gate=5.0, by: str = "'events'") -> str:
    """CTEs ending in ``plan``: one row per source and batch."""
    lost = "CASE WHEN list_contains(retyped, 'value') THEN cell_losses ELSE 0 END" if coercion else "0"
    kept = "map_entries(expected)" if backfill else (
        "list_filter(map_entries(expected), lambda e: list_contains(map_keys(observed), e.key))"
    )
    changed = "false" if coercion else "list_contains(retyped, e.key)"
    refused = "has_drift" if strict else "false"
    return f"""
WITH RECURSIVE {_CELLS},
summaries AS (
  SELECT {by} AS src, b, count(*) AS n_rows, count(*) FILTER (WHERE bad) AS cell_losses FROM lossy GROUP BY 1, 2),
numbered AS (
  SELECT s.*, l.observed, row_number() OVER (PARTITION BY src ORDER BY s.b) AS pos
  FROM summaries s JOIN layouts l ON s.b = l.b),
steps AS (
  SELECT src, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS n_rows,
    CAST(0 AS BIGINT) AS loss, '' AS disposition, 0 AS expected_version, 1 AS version,
    observed AS expected, observed, observed AS state, false AS evolved
  FROM numbered WHERE pos = 1
  UNION ALL
  SELECT src, pos, b, n_rows, loss,
    CASE WHEN NOT has_drift THEN 'CLEAN' WHEN {refused} THEN 'SCHEMA_DRIFT' WHEN failed THEN 'HEALING_FAILED'
         ELSE 'HEALED' END,
    version, CASE WHEN evolves THEN version + 1 ELSE version END, expected, observed,
    CASE WHEN evolves THEN map_from_entries(list_concat(
        list_transform({kept}, lambda e: CASE WHEN {changed}
            THEN {{'key': e.key, 'value': observed[e.key]}} ELSE {{'key': e.key, 'value': e.value}} END),
        list_filter(map_entries(observed), lambda e: NOT list_contains(map_keys(expected), e.key))))
      ELSE expected END,
    evolves
  FROM (
    SELECT *, has_drift AND NOT failed AND NOT {str(strict).lower()} AND {str(evolution).lower()}
        AND (len(added) > 0 OR len(retyped) > 0) AS evolves
    FROM (
      SELECT *, len(added) + len(removed) + len(retyped) > 0 AS has_drift,
        CASE WHEN {refused} THEN 0 ELSE loss_if_healed END AS loss,
        NOT ({refused}) AND loss_if_healed * 100.0 / n_rows > {gate} AS failed
      FROM (
        SELECT *, {lost} AS loss_if_healed FROM (
          SELECT *, len(added) + len(removed) + len(retyped) > 0 AS has_drift FROM (
            SELECT s.src, s.pos + 1 AS pos, n.b, n.n_rows, n.cell_losses, s.version, s.state AS expected, n.observed,
              list_filter(map_keys(n.observed), lambda c: NOT {_HAS.format(m='s.state')}) AS added,
              list_filter(map_keys(s.state), lambda c: NOT {_HAS.format(m='n.observed')}) AS removed,
              list_filter(map_keys(n.observed), lambda c: {_HAS.format(m='s.state')}
                  AND n.observed[c] <> s.state[c]) AS retyped
            FROM steps s JOIN numbered n ON n.src = s.src AND n.pos = s.pos + 1))))))
,
plan AS (
  SELECT *, CASE WHEN evolved THEN version END AS evolved_to,
    list_sort(list_filter(map_keys(observed), lambda c: NOT {_HAS.format(m='expected')})) AS added,
    list_sort(list_filter(map_keys(expected), lambda c: NOT {_HAS.format(m='observed')})) AS removed,
    list_sort(list_filter(map_keys(observed), lambda c: {_HAS.format(m='expected')}
        AND observed[c] <> expected[c])) AS retyped
  FROM steps WHERE pos > 0)
"""


def _texts(inner: str) -> str:
    """``plan`` with the report texts."""
    return f"""{inner},
flags AS (
  SELECT *, len(added) + len(removed) + len(retyped) > 0 AS has_drift,
    concat_ws(',', CASE WHEN len(added) > 0 THEN 'added_columns' END,
      CASE WHEN len(removed) > 0 THEN 'removed_columns' END,
      CASE WHEN len(retyped) > 0 THEN 'type_changed' END) AS drift_types,
    list_filter(list_concat(
      [CASE WHEN len(added) > 0 THEN 'New columns detected (' || array_to_string(added, ', ') || '). '
        || 'Likely a upstream producer schema migration. Check source changelog or producer deployment history.' END,
       CASE WHEN len(removed) > 0 THEN 'Expected columns missing (' || array_to_string(removed, ', ') || '). '
        || 'Source may have dropped/renamed columns or query projection changed. '
        || 'Verify source DDL and any recent ALTER TABLE statements.' END],
      list_transform(retyped, lambda c: 'Column ''' || c || ''' changed type ''' || expected[c] || ''' -> '''
        || observed[c] || '''. Common causes: upstream cast change, CSV text promotion, or ORM mapping update.')),
      lambda h: h IS NOT NULL) AS hints,
    concat_ws('; ',
      CASE WHEN len(added) > 0 THEN 'added=[''' || array_to_string(added, ''', ''') || ''']' END,
      CASE WHEN len(removed) > 0 THEN 'removed=[''' || array_to_string(removed, ''', ''') || ''']' END,
      CASE WHEN len(retyped) > 0 THEN 'type_changes={{' || array_to_string(list_transform(retyped,
        lambda c: '''' || c || ''': ''' || expected[c] || '->' || observed[c] || ''''), ', ') || '}}' END) AS diff
  FROM plan),
told AS (
  SELECT *, CASE WHEN diff = '' THEN 'no drift' ELSE diff END AS summary,
    CASE WHEN disposition NOT IN ('HEALED', 'HEALING_FAILED') THEN '' ELSE array_to_string(list_concat(list_concat(
      list_transform(removed, lambda c: 'backfilled missing column ''' || c || ''' (' || expected[c] || ') with null'),
      CASE WHEN len(added) > 0 THEN ['kept new columns for schema evolution: ['''
        || array_to_string(added, ''', ''') || ''']'] ELSE [] END),
      CASE WHEN list_contains(retyped, 'value') AND loss > 0
        THEN ['coerced column ''value'' from ''string'' to ''float'' (' || loss || ' nulled)'] ELSE [] END), '; ')
    END AS actions
  FROM flags),
final AS (
  SELECT *, CASE WHEN actions = '' THEN 'no healing applied' ELSE actions END AS healing FROM told)
"""


_REGION = "['APAC', 'EMEA', 'AMER'][user_id % 3 + 1]"
_DRIFT_ACTIONS = (
    "Review drift_events table for full change details.|Notify the upstream data producer of the schema change.|"
)
_HEALED = _DRIFT_ACTIONS + (
    "Validate the healed output sample before promoting to production.|"
    "Update downstream consumers if new columns were added."
)
_UNHEALED = _DRIFT_ACTIONS + (
    "Manual intervention required — check quarantine_records.|"
    "Fix schema or healing config, then re-run the pipeline."
)
_REVIEW = (
    "Review quarantine_records table for affected rows.|Identify whether issue is systemic or isolated batch.|"
    "Re-run with healing enabled after fixing upstream."
)
_FAILED = (
    "Check pipeline logs for full traceback.|Verify source connectivity and credentials.|"
    "Inspect quarantine store for partial loads."
)
_LOSS_TEXT = "format('Coercion loss {:.1f}% exceeds threshold 5.0% — batch marked for quarantine', loss * 100.0 / n_rows)"
_DRIFT_SUMMARY = (
    "'Schema drift detected in source ''events''. ' || CASE WHEN disposition = 'HEALED' THEN 'Auto-healed.' "
    "ELSE 'Could NOT auto-heal — manual review required.' END || ' Details: ' || summary"
)
_QUARANTINE_SUMMARY = "loss || ' record(s) quarantined from source ''events'' due to [COERCION_FAILURE].'"

_ALERTS = f"""
alerts AS (
  SELECT b, 'Schema Drift Detected' AS title, CASE WHEN disposition = 'HEALED' THEN 'WARNING' ELSE 'ERROR' END AS severity,
    {_DRIFT_SUMMARY} AS summary, CASE WHEN disposition = 'HEALED' THEN '{_HEALED}' ELSE '{_UNHEALED}' END AS suggested,
    CASE WHEN disposition = 'HEALED' THEN 'batch_index=' || b || '|rows_healed=' || n_rows || '|rows_coerced=' || loss
        || '|actions=' || healing
      WHEN disposition = 'HEALING_FAILED' THEN 'batch_index=' || b || '|rows=' || n_rows || '|coercion_loss=' || loss
      ELSE 'batch_index=' || b || '|rows=' || n_rows END AS metrics_text,
    hints
  FROM final WHERE has_drift
  UNION ALL
  SELECT b, 'Records Quarantined', 'ERROR', {_QUARANTINE_SUMMARY}, '{_REVIEW}', 'batch_index=' || b, hints
  FROM final WHERE disposition = 'HEALED' AND loss > 0)
"""

_BATCH = "CAST(b AS VARCHAR) AS batch_id"
_STORE = """
WITH q AS (
  SELECT o_orderkey AS id, 'p' || (o_custkey % 3) AS pipeline_name, o_orderpriority AS source_name,
    'r' || (o_orderkey % 10) AS run_id,
    CASE o_orderstatus WHEN 'O' THEN 'COERCION_FAILURE' WHEN 'F' THEN 'HEALING_FAILED' WHEN 'P' THEN 'SCHEMA_DRIFT' END
      AS error_type,
    o_orderdate AS quarantined_at, o_orderkey % 2 = 0 AS resolved
  FROM orders)
"""
_LEDGER = """
WITH reg AS (
  SELECT p_brand AS source_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS version,
    p_type || ':' || p_size AS schema_json
  FROM part)
"""
_CATALOG = """
WITH sized AS (
  SELECT p_brand AS source_name, p_size, min(CASE WHEN length(p_type) % 2 = 0 THEN 'integer' ELSE 'float' END) AS bucket
  FROM part GROUP BY 1, 2),
e AS (SELECT source_name, 'c' || p_size AS col, bucket FROM sized),
o AS (
  SELECT source_name, 'c' || p_size AS col, CASE WHEN p_size % 5 = 0 THEN 'string' ELSE bucket END AS bucket
  FROM sized WHERE p_size % 7 <> 0
  UNION ALL
  SELECT source_name, 'n' || p_size, 'string' FROM sized WHERE p_size % 11 = 0),
diff AS (
  SELECT coalesce(e.source_name, o.source_name) AS source_name, coalesce(e.col, o.col) AS column_name,
    e.bucket AS old_bucket, o.bucket AS new_bucket,
    CASE WHEN e.col IS NULL THEN 'added' WHEN o.col IS NULL THEN 'removed' ELSE 'type_changed' END AS kind
  FROM e FULL OUTER JOIN o ON e.source_name = o.source_name AND e.col = o.col
  WHERE e.col IS NULL OR o.col IS NULL OR e.bucket <> o.bucket)
"""
_NUMERIC_TEXT = """
WITH t AS (
  SELECT CASE WHEN l_partkey % 50 <> 0 THEN
    CASE l_linenumber % 7 WHEN 0 THEN CAST(l_orderkey AS VARCHAR) WHEN 1 THEN ' 12 ' WHEN 2 THEN '1.0' WHEN 3 THEN '1e3'
      WHEN 4 THEN '1.5' WHEN 5 THEN '1_000' WHEN 6 THEN '$5.00' END END AS txt
  FROM lineitem),
d AS (SELECT txt, CASE WHEN regexp_matches(txt, '{number}') THEN TRY_CAST(trim(txt) AS DOUBLE) END AS num FROM t),
r AS (
  SELECT txt, num, coalesce(CASE WHEN regexp_matches(trim(txt), '^[+-]?[0-9]+$') THEN TRY_CAST(trim(txt) AS BIGINT) END,
    CASE WHEN num = floor(num) AND abs(num) <= 9007199254740992 THEN CAST(num AS BIGINT) END) AS whole
  FROM d)
""".replace("{number}", NUMBER)


def _grouped(prelude: str, result: str) -> str:
    return f"""{prelude} SELECT txt, {result} AS result, count(*) AS n,
      count(*) FILTER (WHERE txt IS NOT NULL AND ({result}) IS NULL) AS n_failed FROM r GROUP BY txt, {result}"""


def _bucket(sql_type: str) -> str:
    return {"BIGINT": "integer", "INTEGER": "integer", "DOUBLE": "float", "VARCHAR": "string",
            "TIMESTAMP": "datetime"}[sql_type]


def _typeof(table: str, column: str) -> str:
    return (
        f"CASE typeof(min({column})) WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer' "
        "WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'datetime' END"
    )


def _type_buckets() -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {_typeof(t, c)} AS bucket, count({c}) AS n_present FROM {t}"
        for t, columns in _COLUMNS.items()
        for c in columns
    )


def _snapshot() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS ordinal, {_typeof('events', c)} AS bucket, count(*) AS n_rows FROM events"
        for i, c in enumerate(_COLUMNS["events"])
    )


def _human_text() -> str:
    rule = "=" * 60
    head = [rule, "[ERROR] Records Quarantined", "Pipeline : etl_pipeline", "Source   : events", "Run ID   : r1",
            "Time     : 2024-02-01T00:00:00.000000+00:00", "", "Summary", "-------"]
    mid = ["", "Metrics", "-------"]
    hints = ["", "Root-cause hints", "----------------"]
    tail = ["", "Suggested actions", "-----------------"]
    tail += ["  • " + a for a in _REVIEW.split("|")] + [rule]

    def block(lines: list[str]) -> str:
        return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in lines)

    return (
        f"{block(head)} || chr(10) || {_QUARANTINE_SUMMARY} || chr(10) || {block(mid)} || chr(10) || '  batch_index: ' || b"
        f" || chr(10) || {block(hints)} || chr(10) || '  • ' || array_to_string(hints, chr(10) || '  • ')"
        f" || chr(10) || {block(tail)}"
    )


_SWITCHES = {
    "no_backfill": {"backfill": False},
    "no_coercion": {"coercion": False},
    "no_evolution": {"evolution": False},
    "gate_2pct": {"gate": 2.0},
}


def _switches() -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM ({fold(**how)} SELECT '{name}' AS setting, b AS batch_id, disposition, expected_version, evolved_to,
          loss, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed FROM plan)"""
        for name, how in _SWITCHES.items()
    )


def _stands(plan: str) -> str:
    """Row counts of a load: all, clean, of refused batches, of these with a failing cell, failed cells elsewhere, and the last version."""
    return f"""{plan}, t AS (SELECT CAST(sum(n_rows) AS BIGINT) AS total,
        CAST(sum(CASE WHEN disposition = 'HEALING_FAILED' THEN 0 ELSE n_rows END) AS BIGINT) AS clean,
        CAST(sum(CASE WHEN disposition = 'HEALING_FAILED' THEN n_rows ELSE 0 END) AS BIGINT) AS refused,
        CAST(sum(CASE WHEN disposition = 'HEALING_FAILED' THEN loss ELSE 0 END) AS BIGINT) AS bad,
        CAST(sum(CASE WHEN disposition = 'HEALING_FAILED' THEN 0 ELSE loss END) AS BIGINT) AS cells,
        CAST(1 + count(*) FILTER (evolved) AS INTEGER) AS version FROM plan)"""


def statements() -> dict[str, str]:
    plan, told = fold(), _texts(fold())
    strict = _texts(fold(strict=True))
    alerts = f"{told}, {_ALERTS}"
    schema_text = (
        "array_to_string(list_sort(list_transform(map_entries({m}), lambda e: e.key || ':' || e.value)), ',')"
    )
    cells = f"WITH {_CELLS}"
    micros = "SELECT event_id, ts, user_id, event_type, value, props FROM events"
    healed_value = "CASE WHEN NOT bad THEN value END"
    bullets = "'• ' || replace(suggested, '|', chr(10) || '• ')"
    return {
        # sources and batching
        "src_csv_roundtrip": micros,
        "src_jsonl_roundtrip": micros,
        "src_dataframe_batches": """SELECT (pos - 1) // 1000 AS batch_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT)
            AS key_sum, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM (SELECT *, row_number() OVER
            (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders) GROUP BY 1""",
        "batch_row_counts": """SELECT (pos - 1) // 640 AS batch_id, count(*) AS n, min(event_id) AS first_id FROM
            (SELECT *, row_number() OVER (ORDER BY event_id) AS pos FROM events) GROUP BY 1""",
        "extract_counts": """SELECT 'events' AS source_name, count(DISTINCT event_type) AS n_batches, count(*) AS n_rows FROM events
            UNION ALL SELECT 'orders', count(DISTINCT o_orderpriority), count(*) FROM orders
            UNION ALL SELECT 'lineitem', count(DISTINCT l_returnflag), count(*) FROM lineitem""",
        "jsonl_skip_blank": """SELECT 'records' AS what, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders
            UNION ALL SELECT 'lines', count(*), 0 FROM orders""",
        "csv_na_markers": """SELECT CASE WHEN o_orderkey % 7 = 6 THEN 'x' END AS word, count(*) AS n, count(o_orderkey) AS n_keys
            FROM orders GROUP BY 1""",
        "malformed_to_quarantine": """WITH t AS (SELECT count(*) AS total, count(*) FILTER (o_orderkey % 13 = 5) AS bad,
              CAST(sum(o_orderkey) FILTER (o_orderkey % 13 <> 5) AS BIGINT) AS good_sum,
              CAST(sum(o_orderkey) FILTER (o_orderkey % 13 = 5) AS BIGINT) AS bad_sum FROM orders)
            SELECT kind, what, CASE what WHEN 'loaded' THEN total - bad WHEN 'extracted' THEN total ELSE bad END AS n,
              CASE WHEN what = 'loaded' THEN good_sum WHEN what = 'malformed' AND kind = 'csv' THEN bad_sum END AS key_sum
            FROM t, (VALUES ('csv'), ('jsonl')) k(kind), (VALUES ('loaded'), ('malformed'), ('extracted'), ('places')) w(what)""",
        "batches_mixed_headers": """WITH m AS (SELECT (min(o_orderkey) + max(o_orderkey)) // 2 AS mid FROM orders),
              p AS (SELECT o_orderkey, o_orderkey >= mid AS late, row_number() OVER (PARTITION BY o_orderkey >= mid ORDER BY o_orderkey) - 1 AS pos
                FROM orders, m),
              b AS (SELECT (count(*) FILTER (NOT late) + 999) // 1000 AS n FROM p)
            SELECT pos // 1000 + CASE WHEN late THEN b.n ELSE 0 END AS batch_id, count(*) AS n, min(o_orderkey) AS first_key,
              max(o_orderkey) AS last_key FROM p, b GROUP BY 1""",
        # user transform and dispositions
        "custom_transform_norm": "SELECT event_id, upper(trim(event_type)) AS event_type, abs(value - 250) AS value FROM events",
        "transform_error_batches": f"""{cells}, errors AS (SELECT DISTINCT b FROM cells WHERE event_id % 3 = 0 AND b % 4 = 1)
            SELECT {_BATCH}, 'TRANSFORM_ERROR' AS error_type, 'event_id is a multiple of three' AS error_detail, count(*) AS n
            FROM cells WHERE b IN (SELECT b FROM errors) GROUP BY b""",
        "strict_quarantine": f"""{strict} SELECT CAST(f.b AS VARCHAR) AS batch_id, 'SCHEMA_DRIFT' AS error_type,
            f.summary AS error_detail, f.expected_version AS schema_version, c.event_id
            FROM final f JOIN lossy c ON c.b = f.b WHERE f.disposition = 'SCHEMA_DRIFT'""",
        "clean_passthrough": f"""{plan} SELECT p.b AS batch_id, c.event_id, c.ts, c.user_id, c.event_type, c.value, c.props,
            CASE WHEN list_contains(map_keys(p.observed), 'region') THEN {_REGION} END AS region
            FROM plan p JOIN lossy c ON c.b = p.b WHERE p.disposition = 'CLEAN'""",
        "healing_failed_rows": f"""{told} SELECT CAST(f.b AS VARCHAR) AS batch_id, 'HEALING_FAILED' AS error_type,
            {_LOSS_TEXT} AS error_detail, f.expected_version AS schema_version, c.event_id
            FROM final f JOIN lossy c ON c.b = f.b WHERE f.disposition = 'HEALING_FAILED'""",
        "coercion_failure_rows": f"""{plan} SELECT CAST(p.b AS VARCHAR) AS batch_id, 'value' AS column_name,
            'COERCION_FAILURE' AS error_type, p.expected_version AS schema_version, c.event_id,
            starts_with(c.price, '$') AS keeps_raw_value
            FROM plan p JOIN lossy c ON c.b = p.b WHERE p.disposition = 'HEALED' AND c.bad""",
        "run_totals": f"""{plan} SELECT src AS source_name, CAST(sum(n_rows) AS BIGINT) AS rows_extracted,
            CAST(sum(CASE WHEN disposition IN ('CLEAN', 'HEALED') THEN n_rows ELSE 0 END) AS BIGINT) AS rows_clean,
            CAST(sum(CASE WHEN disposition = 'HEALING_FAILED' THEN n_rows WHEN disposition = 'HEALED' THEN loss ELSE 0 END)
              AS BIGINT) AS rows_quarantined,
            bool_or(len(added) + len(removed) + len(retyped) > 0) AS drift_detected, bool_or(evolved) AS schema_evolved
            FROM plan GROUP BY src""",
        "excluded_failures": f"""{plan} SELECT p.b AS batch_id, count(*) AS n, CAST(sum(c.event_id) AS BIGINT) AS id_sum
            FROM plan p JOIN lossy c ON c.b = p.b WHERE p.disposition IN ('CLEAN', 'HEALED') AND NOT c.bad GROUP BY p.b""",
        "evolving_batches": f"""{plan} SELECT b AS batch_id, n_rows, disposition, expected_version, evolved_to, loss,
            array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed FROM plan""",
        "evolving_sources": f"""{fold(by="event_type")} SELECT src AS source_name, b AS batch_id, n_rows, loss, disposition,
            expected_version, evolved_to FROM plan""",
        "stream_verdicts": f"""{plan} SELECT {_BATCH}, n_rows, disposition, expected_version, evolved_to, loss FROM plan""",
        # schema snapshot and drift
        "type_buckets": _type_buckets(),
        "schema_snapshot": _snapshot(),
        "batch_type_profile": f"""WITH total AS (SELECT count(*) AS n FROM events),
            t AS (SELECT event_id * 10 // n AS batch_id, CAST(event_id AS VARCHAR) AS id_text,
              CASE WHEN event_id % 40 = 0 THEN '$' || CAST(value AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS price_text,
              CAST(value AS VARCHAR) AS value_text, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'False' END AS flag_text,
              CASE WHEN user_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time_text FROM events, total),
            v AS (SELECT batch_id, unnest([{{'c': 'id_text', 't': id_text}}, {{'c': 'price_text', 't': price_text}},
              {{'c': 'value_text', 't': value_text}}, {{'c': 'flag_text', 't': flag_text}},
              {{'c': 'time_text', 't': time_text}}]) AS x FROM t),
            k AS (SELECT batch_id, x.c AS column_name, count(*) AS n_rows, count(x.t) AS n_present,
              count(*) - count(x.t) AS n_null,
              count(*) FILTER (WHERE regexp_matches(x.t, '^[+-]?[0-9]+$')) AS n_integer,
              count(*) FILTER (WHERE regexp_matches(x.t, '{NUMBER}')) AS n_float,
              count(*) FILTER (WHERE lower(x.t) IN ('true', 'false')) AS n_boolean,
              count(*) FILTER (WHERE TRY_CAST(x.t AS TIMESTAMP) IS NOT NULL AND x.c = 'time_text') AS n_datetime
              FROM v GROUP BY 1, 2)
            SELECT *, CASE WHEN n_present = 0 THEN 'unknown' WHEN n_integer = n_present THEN 'integer'
              WHEN n_float = n_present THEN 'float' WHEN n_boolean = n_present THEN 'boolean' ELSE 'string' END AS bucket FROM k""",
        "drift_added": f"{plan} SELECT b AS batch_id, unnest(added) AS column_name FROM plan",
        "drift_removed": f"{plan} SELECT b AS batch_id, unnest(removed) AS column_name FROM plan",
        "drift_type_changes": f"""{plan} SELECT batch_id, c AS column_name, expected[c] AS old_bucket, observed[c] AS new_bucket
            FROM (SELECT b AS batch_id, unnest(retyped) AS c, expected, observed FROM plan)""",
        "drift_flags": f"{told} SELECT b AS batch_id, has_drift, drift_types FROM final",
        "drift_hints": f"{told} SELECT b AS batch_id, array_to_string(hints, chr(10)) AS hints FROM final",
        "drift_details": f"""{told} SELECT b AS batch_id, array_to_string(added, ',') AS added,
            array_to_string(removed, ',') AS removed,
            array_to_string(list_transform(retyped, lambda c: c || ':' || expected[c] || '>' || observed[c]), ',') AS type_changes,
            len(hints) AS n_hints FROM final WHERE has_drift""",
        "drift_summary": f"{told} SELECT b AS batch_id, summary FROM final",
        "drift_catalog": f"{_CATALOG} SELECT source_name, column_name, old_bucket, new_bucket, kind FROM diff",
        "drift_catalog_reports": f"""{_CATALOG} SELECT source_name,
            concat_ws(',', CASE WHEN bool_or(kind = 'added') THEN 'added_columns' END,
              CASE WHEN bool_or(kind = 'removed') THEN 'removed_columns' END,
              CASE WHEN bool_or(kind = 'type_changed') THEN 'type_changed' END) AS drift_types,
            coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE kind = 'added'), '') AS added,
            coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE kind = 'removed'), '') AS removed,
            count(*) FILTER (WHERE kind = 'type_changed') AS n_type_changes FROM diff GROUP BY source_name""",
        # schema ledger
        "registry_active": f"""{_LEDGER} SELECT source_name, max(version) AS version, arg_max(schema_json, version) AS schema_json
            FROM reg GROUP BY 1""",
        "registry_flags": f"""{_LEDGER} SELECT source_name, version,
            version = max(version) OVER (PARTITION BY source_name) AS is_active FROM reg""",
        "registry_history": f"{_LEDGER} SELECT * FROM reg WHERE source_name = 'Brand#7' ORDER BY version",
        "registry_next_version": f"{_LEDGER} SELECT source_name, max(version) + 1 AS next_version FROM reg GROUP BY 1",
        "registry_baseline": f"""SELECT DISTINCT event_type AS source_name, 1 AS version, 'baseline' AS kind,
            {schema_text.format(m=_map(_BASE))} AS schema_text FROM events""",
        "registry_evolution": f"""{plan} SELECT '0' AS batch_id, 1 AS version, 'baseline' AS kind,
            {schema_text.format(m="expected")} AS schema_text FROM plan WHERE b = 0
            UNION ALL SELECT {_BATCH}, evolved_to, 'evolution', {schema_text.format(m="state")} FROM plan WHERE evolved""",
        # healing
        "heal_backfill": f"""{plan} SELECT p.b AS batch_id, c.event_id,
            c.props IS NULL OR NOT list_contains(map_keys(p.observed), 'props') AS no_props,
            NOT list_contains(map_keys(p.observed), 'region') AS no_region
            FROM plan p JOIN lossy c ON c.b = p.b WHERE p.disposition IN ('CLEAN', 'HEALED')""",
        "heal_keep_added": f"""{plan} SELECT c.event_id, {_REGION} AS region FROM plan p JOIN lossy c ON c.b = p.b
            WHERE p.disposition IN ('CLEAN', 'HEALED') AND list_contains(map_keys(p.observed), 'region')""",
        "heal_drop_added": f"""{fold(evolution=False)} SELECT c.event_id, {healed_value} AS value,
            'event_id,event_type,props,ts,user_id,value' AS column_names
            FROM plan p JOIN lossy c ON c.b = p.b WHERE p.disposition IN ('CLEAN', 'HEALED')""",
        "heal_coerced_values": f"""{plan} SELECT c.event_id, {healed_value} AS value, c.ts, c.user_id
            FROM plan p JOIN lossy c ON c.b = p.b WHERE p.disposition IN ('CLEAN', 'HEALED')""",
        "coerce_integer": _grouped(_NUMERIC_TEXT, "whole"),
        "coerce_float": _grouped(_NUMERIC_TEXT, "num"),
        "coerce_boolean": _grouped(
            """WITH r AS (SELECT txt, CASE WHEN lower(trim(txt)) IN ('true', '1', 'yes', 'y', 't') THEN true
                WHEN lower(trim(txt)) IN ('false', '0', 'no', 'n', 'f') THEN false END AS flag FROM (SELECT CASE l_linenumber % 7
                WHEN 0 THEN 'true' WHEN 1 THEN ' Yes' WHEN 2 THEN 'N' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' WHEN 5 THEN '2' END
                AS txt FROM lineitem))""",
            "flag",
        ),
        "coerce_datetime": _grouped(
            """WITH r AS (SELECT txt, strftime(coalesce(try_strptime(txt, '%Y-%m-%d %H:%M:%S'), try_strptime(txt, '%Y-%m-%d'),
                try_strptime(txt, '%m/%d/%Y')), '%Y-%m-%d %H:%M:%S') AS t FROM (SELECT CASE o_orderkey % 20 WHEN 0 THEN 'n/a'
                WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
                ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS txt FROM orders))""",
            "t",
        ),
        "coerce_string": """SELECT l_orderkey AS txt, CAST(l_orderkey AS VARCHAR) AS result, count(*) AS n, 0 AS n_failed
            FROM lineitem WHERE l_partkey % 50 <> 0 GROUP BY 1, 2
            UNION ALL SELECT NULL, NULL, count(*), 0 FROM lineitem WHERE l_partkey % 50 = 0""",
        "coerce_typed": """SELECT CASE WHEN l_quantity = floor(l_quantity) THEN CAST(l_quantity AS BIGINT) END AS quantity_integer,
            CASE WHEN l_tax = floor(l_tax) THEN CAST(l_tax AS BIGINT) END AS tax_integer, l_tax <> 0 AS tax_boolean,
            CAST(l_linenumber AS DOUBLE) AS line_float, l_linenumber <> 0 AS line_boolean, count(*) AS n,
            min(epoch_us(l_shipdate) * 1000) AS first_ship FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
        "batch_loss": f"{cells} SELECT b AS batch_id, count(*) AS n, count(*) FILTER (WHERE bad) AS lost FROM lossy GROUP BY b",
        "loss_gate": f"""{plan} SELECT b AS batch_id, n_rows AS n, loss AS lost,
            round(CAST(loss AS DOUBLE) / n_rows * 100, 6) AS pct, disposition FROM plan""",
        "healing_actions": f"{told} SELECT b AS batch_id, healing AS actions FROM final",
        "heal_switches": _switches(),
        # quarantine and drift events
        "quarantine_append": f"""{plan} SELECT 'events' AS source_name, 'r1' AS run_id, CAST(p.b AS VARCHAR) AS batch_id,
            CASE WHEN p.disposition = 'HEALED' THEN 'COERCION_FAILURE' ELSE p.disposition END AS error_type, count(*) AS n,
            count(*) AS n_ids, 0 AS n_resolved FROM plan p JOIN lossy c ON c.b = p.b
            WHERE p.disposition = 'HEALING_FAILED' OR (p.disposition = 'HEALED' AND c.bad) GROUP BY p.b, p.disposition""",
        "quarantine_json": f"""{plan} SELECT CAST(p.b AS VARCHAR) AS batch_id,
            array_to_string(list_sort(map_keys(p.observed)), ',') AS keys, c.event_id,
            strftime(c.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, c.user_id, c.event_type,
            CASE WHEN list_contains(map_keys(p.observed), 'props') THEN c.props END AS props, c.value,
            starts_with(c.price, '$') AS priced FROM plan p JOIN lossy c ON c.b = p.b
            WHERE p.disposition = 'HEALING_FAILED' OR (p.disposition = 'HEALED' AND c.bad)""",
        "drift_events": f"""{told} SELECT {_BATCH}, drift_types AS drift_type, false AS healed, '' AS healing_action
            FROM final WHERE has_drift
            UNION ALL SELECT {_BATCH}, drift_types, true, 'Schema evolved to v' || evolved_to || '. Actions: ' || healing
            FROM final WHERE evolved""",
        "drift_events_topk": f"""{told}, ev AS (SELECT b, drift_types, false AS healed FROM final WHERE has_drift
            UNION ALL SELECT b, drift_types, true FROM final WHERE evolved)
            SELECT batch_id, id, drift_type, healed FROM (SELECT {_BATCH},
              sha256(concat_ws(chr(31), 'r1', 'events', CAST(b AS VARCHAR), CASE WHEN healed THEN 'true' ELSE 'false' END)) AS id,
              drift_types AS drift_type, healed, b FROM ev) ORDER BY b DESC, id LIMIT 5""",
        "quarantine_topk": f"""{_STORE} SELECT id, error_type, quarantined_at FROM q WHERE NOT resolved
            AND source_name = '1-URGENT' ORDER BY quarantined_at DESC, id LIMIT 500""",
        "quarantine_resolve": f"""{_STORE} SELECT error_type, id % 6 = 0 AS resolved, count(*) AS n,
            CAST(sum(id) AS BIGINT) AS id_sum FROM q GROUP BY 1, 2""",
        "quarantine_purge": f"""{_STORE} SELECT id, error_type, quarantined_at, resolved FROM q
            WHERE NOT (resolved AND quarantined_at < TIMESTAMP '1999-01-01' - INTERVAL 30 DAY)""",
        "quarantine_upkeep": f"""{_STORE}, k AS (SELECT *, resolved AND quarantined_at < TIMESTAMP '1999-01-01' - INTERVAL 30 DAY AS old FROM q)
            SELECT error_type, resolved, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, (SELECT count(*) FROM k WHERE old) AS purged
            FROM k WHERE NOT old GROUP BY 1, 2""",
        "quarantine_trend": f"""{_STORE} SELECT CAST(quarantined_at AS DATE) AS day, source_name, error_type, count(*) AS n
            FROM q GROUP BY 1, 2, 3""",
        "quarantine_stats": f"""{_STORE} SELECT 'all' AS pipeline_name, count(*) AS total,
            count(*) FILTER (WHERE NOT resolved) AS unresolved, count(*) FILTER (WHERE resolved) AS resolved FROM q
            UNION ALL SELECT 'p1', count(*), count(*) FILTER (WHERE NOT resolved), count(*) FILTER (WHERE resolved)
            FROM q WHERE pipeline_name = 'p1'""",
        "quarantine_stats_sets": f"""{_STORE} SELECT error_type, source_name, count(*) AS n FROM q
            GROUP BY GROUPING SETS ((), (error_type), (source_name))""",
        "quarantine_count_by": f"{_STORE} SELECT run_id, count(*) AS n FROM q GROUP BY 1",
        # sinks
        "sink_csv_roundtrip": """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus,
            o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 2 <> 0 THEN 'b' END AS half FROM orders""",
        "sink_jsonl_roundtrip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
        "sink_table_roundtrip": "SELECT * FROM orders",
        "sink_count": """SELECT 'events' AS table_name, count(*) AS n FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem
            UNION ALL SELECT 'orders', count(*) FROM orders""",
        # names, types and runs that go wrong easily
        "reserved_names": """SELECT event_id, event_type AS "_source", props AS "_error", user_id AS "_tokens", value AS "_batch", via
            FROM events, (VALUES ('frame'), ('csv'), ('jsonl')) v(via)""",
        "late_typed_column": """SELECT CAST(event_id % 3 AS INTEGER) AS batch_id, count(*) AS n_rows,
            CASE event_id % 3 WHEN 2 THEN 'HEALING_FAILED' ELSE 'CLEAN' END AS disposition,
            CASE event_id % 3 WHEN 2 THEN 2 ELSE 1 END AS expected_version, event_id % 3 = 2 AS has_drift,
            CASE event_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'resolution' ELSE '' END AS registered
            FROM events GROUP BY event_id % 3""",
        "run_retry": f"""{alerts}, n AS (SELECT count(*) AS n FROM alerts)
            SELECT 1 AS attempt, 'FAILED' AS status, max(n.n) + 1 AS alerts, 1 AS failures,
              count(*) FILTER (has_drift) + count(*) FILTER (evolved) AS drift_events,
              CAST(sum(CASE WHEN disposition = 'HEALING_FAILED' THEN n_rows ELSE loss END) AS BIGINT) AS records,
              CAST(1 + count(*) FILTER (evolved) AS INTEGER) AS version FROM final, n
            UNION ALL SELECT 2, 'SUCCESS', 0, 0, 0, 0, 1""",
        # replays and repeated runs
        "quarantine_replay": f"""{_stands(plan)} SELECT 1 AS step, total AS rows_extracted, clean AS rows_loaded, refused + cells AS rows_left,
              refused + cells AS unresolved, clean AS sink_rows, version FROM t
            UNION ALL SELECT s, refused, refused - bad, bad, bad + cells, clean + refused - bad, version FROM t, (VALUES (2), (3)) v(s)
            UNION ALL SELECT 4, bad, bad, 0, cells, clean + refused, version + 1 FROM t""",
        "sink_retry": f"""{_stands(plan)} SELECT s AS step, total AS rows_extracted, CASE s WHEN 3 THEN total ELSE clean END AS rows_loaded,
              refused + cells AS rows_left, refused + cells AS unresolved, clean AS sink_rows, version
            FROM t, (VALUES (1), (2), (3)) v(s)""",
        "streaming_load": f"""{plan}, h AS (SELECT *, CASE WHEN b < 5 THEN 1 ELSE 2 END AS step,
              CASE WHEN disposition = 'HEALING_FAILED' THEN n_rows ELSE loss END AS held,
              CASE WHEN disposition = 'HEALING_FAILED' THEN 0 ELSE n_rows END AS good FROM plan),
            s AS (SELECT step, CAST(sum(n_rows) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good, CAST(sum(held) AS BIGINT) AS held,
              count(*) FILTER (evolved) AS evolved FROM h GROUP BY step)
            SELECT CAST(step AS INTEGER) AS step, 1 AS micro_batches, n AS rows_extracted, good AS rows_loaded, held AS rows_quarantined,
              CAST(sum(good) OVER w AS BIGINT) AS sink_rows, CAST(sum(held) OVER w AS BIGINT) AS records,
              CAST(1 + sum(evolved) OVER w AS INTEGER) AS version FROM s WINDOW w AS (ORDER BY step)""",
        # runs and alerts
        "run_ledger": f"""{plan} SELECT 'r1' AS run_id, 'etl_pipeline' AS pipeline_name, 'events' AS source_name,
            'SUCCESS' AS status, CAST(sum(n_rows) AS BIGINT) AS rows_extracted,
            CAST(sum(CASE WHEN disposition IN ('CLEAN', 'HEALED') THEN n_rows ELSE 0 END) AS BIGINT) AS rows_loaded,
            CAST(sum(CASE WHEN disposition = 'HEALING_FAILED' THEN n_rows ELSE loss END) AS BIGINT) AS rows_quarantined,
            bool_or(disposition <> 'CLEAN') AS drift_detected, true AS finished FROM plan""",
        "run_summary": f"""{plan} SELECT 'r1' AS run_id, 'events' AS source, 'SUCCESS' AS status,
            CAST(sum(n_rows) AS BIGINT) AS rows_extracted,
            CAST(sum(CASE WHEN disposition IN ('CLEAN', 'HEALED') THEN n_rows ELSE 0 END) AS BIGINT) AS rows_loaded,
            CAST(sum(CASE WHEN disposition = 'HEALING_FAILED' THEN n_rows ELSE loss END) AS BIGINT) AS rows_quarantined,
            bool_or(evolved) AS schema_evolved, bool_or(disposition <> 'CLEAN') AS drift_detected FROM plan""",
        "run_latest_status": """SELECT CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'SUCCESS' ELSE 'FAILED' END AS status,
            count(*) AS n FROM orders GROUP BY 1""",
        "alerts_table": f"""{alerts} SELECT {_BATCH}, title, severity, 'r1' AS run_id, summary,
            '2024-02-01T00:00:00.000000+00:00' AS at FROM alerts""",
        "alerts_record": f"""{alerts} SELECT CAST(a.b AS VARCHAR) AS batch_id, title, CAST(len(a.hints) AS INTEGER) AS n_hints,
              CAST(len(string_split(suggested, '|')) AS INTEGER) AS n_actions,
              CASE WHEN title = 'Records Quarantined' THEN 'OBJECT<batch_index: BIGINT>'
                WHEN disposition = 'HEALED' THEN 'OBJECT<actions: STRING, batch_index: BIGINT, rows_coerced: BIGINT, rows_healed: BIGINT>'
                ELSE 'OBJECT<batch_index: BIGINT, coercion_loss: BIGINT, rows: BIGINT>' END AS shape,
              CASE WHEN title <> 'Records Quarantined' THEN n_rows END AS n
            FROM alerts a JOIN final f ON f.b = a.b""",
        "alerts_min_severity": f"{alerts} SELECT severity, title, count(*) AS n FROM alerts WHERE severity = 'ERROR' GROUP BY 1, 2",
        "alerts_drift": f"""{alerts} SELECT {_BATCH}, severity, summary, suggested, metrics_text FROM alerts
            WHERE title = 'Schema Drift Detected'""",
        "alerts_quarantine": f"""{alerts} SELECT {_BATCH}, severity, title, summary, suggested FROM alerts
            WHERE title = 'Records Quarantined'""",
        "alerts_failure": f"""SELECT 'r' || o_orderkey AS run_id, 'CRITICAL' AS severity, 'Pipeline ''p' || (o_custkey % 3)
            || ''' failed: order ' || o_orderkey || ' is late' AS summary, '{_FAILED}' AS suggested
            FROM orders WHERE o_orderstatus = 'F'""",
        "alerts_payload": f"""{alerts} SELECT {_BATCH}, CASE severity WHEN 'WARNING' THEN '#f39c12' ELSE '#e74c3c' END AS color,
            '[' || severity || '] ' || title AS title, summary AS text, 'driftwarden' AS footer,
            'Pipeline,Source,Run ID,Time,Root-cause hints,Suggested actions' AS field_titles, {bullets} AS suggested FROM alerts""",
        "alerts_text": f"{told} SELECT {_BATCH}, {_human_text()} AS text FROM final WHERE disposition = 'HEALED' AND loss > 0",
    }
