"""DuckDB text of the derived tables (FIXTURES.md §2-3), used by every oracle query.

Written independently of the Spark code (plain CASE / VALUES / joins) so the DuckDB
run is a real cross-check of the DataFrame implementation.
"""

from __future__ import annotations

from ..functions import rules as R
from ..sources import testdata as TD


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def _case(expr: str, values: list) -> str:
    whens = " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in rows)


def _event_rules() -> list[tuple]:
    last = {}
    for i, (eid, tech) in enumerate(R.EVENT_TECHNIQUE_RULES):
        last[eid] = tech
    return [(eid, tech) for eid, tech in last.items()]


_LOGS = f"""
logs AS (
  SELECT e.eid AS id,
         e.ts AS "timestamp",
         {_case('e.uid % 11', TD.FIXTURE_SOURCES)} AS source,
         {_case('e.eid % 12', TD.FIXTURE_EVENT_IDS)} AS event_id,
         CASE WHEN e.eid % 12 = 1 THEN 'Failed Logon' ELSE e.etype END AS event_type,
         CASE WHEN e.eid % 97 = 0 THEN NULL
              WHEN e.etype = 'error' AND e.val > 60 THEN 'CRITICAL'
              WHEN e.etype = 'error' AND e.val > 20 THEN 'HIGH'
              WHEN e.etype = 'error' THEN 'ERROR'
              WHEN e.etype = 'purchase' AND e.val > 40 THEN 'MEDIUM'
              WHEN e.etype = 'signup' THEN 'WARNING'
              WHEN e.etype = 'click' THEN 'INFO'
              ELSE 'LOW' END AS severity,
         {_case('e.eid % 13', TD.FIXTURE_TEXTS)} || ' user' || CAST(e.uid AS VARCHAR)
           || CASE WHEN e.eid % 3 = 0 THEN ' from 10.0.0.' || CAST(e.uid % 250 AS VARCHAR) ELSE '' END
           || CASE WHEN e.eid % 5 = 0 THEN ' port ' || CAST(1024 + e.eid % 60000 AS VARCHAR) ELSE '' END AS message,
         CASE WHEN e.uid % 7 = 0 THEN NULL ELSE 'host-' || CAST(e.uid % 20 AS VARCHAR) END AS hostname,
         CASE WHEN e.eid % 4 = 0 THEN NULL ELSE 'user' || CAST(e.uid AS VARCHAR) END AS username,
         CASE WHEN e.eid % 2 = 0 THEN 'proc' ELSE NULL END AS process_name,
         CASE WHEN e.eid % 2 = 0 THEN CAST(e.eid % 32768 AS BIGINT) ELSE NULL END AS process_id,
         e.ts + to_seconds(CAST(e.eid % 600 AS BIGINT)) AS ingestion_time
  FROM (SELECT event_id AS eid, ts, user_id AS uid, event_type AS etype, value AS val FROM events) e
)"""

_TECH = f"""
mitre_techniques(technique_id, technique_name, tactic) AS (VALUES {_values(TD.FIXTURE_TECHNIQUES)}),
eid_rules(rule_key, technique_id) AS (VALUES {_values(_event_rules())}),
kw_rules(rule_order, rule_key, technique_id) AS (VALUES {_values([(i + 1, k, t) for i, (k, t) in enumerate(R.KEYWORD_TECHNIQUE_RULES)])}),
log_technique AS (
  SELECT id, technique_id, tactic FROM (
    SELECT c.id, c.technique_id, t.tactic,
           row_number() OVER (PARTITION BY c.id ORDER BY c.rule_order) AS rn
    FROM (
      SELECT l.id, r.technique_id, 0 AS rule_order FROM logs l JOIN eid_rules r ON l.event_id = r.rule_key
      UNION ALL
      SELECT l.id, k.technique_id, k.rule_order FROM logs l JOIN kw_rules k
        ON contains(lower(coalesce(l.message, '')) || ' ' || lower(coalesce(l.event_type, '')), k.rule_key)
    ) c JOIN mitre_techniques t ON t.technique_id = c.technique_id
  ) WHERE rn = 1
)"""

_ANOM = f"""
anomalies AS (
  SELECT l.id AS id, l.id AS log_id,
         0.5 + CAST(l.id % 50 AS DOUBLE) / 100.0 AS anomaly_score,
         {_case('l.id % 3', TD.FIXTURE_ALGORITHMS)} AS algorithm,
         CASE WHEN 0.5 + CAST(l.id % 50 AS DOUBLE) / 100.0 >= 0.90 THEN 'CRITICAL'
              WHEN 0.5 + CAST(l.id % 50 AS DOUBLE) / 100.0 >= 0.75 THEN 'HIGH'
              WHEN 0.5 + CAST(l.id % 50 AS DOUBLE) / 100.0 >= 0.55 THEN 'MEDIUM'
              ELSE 'LOW' END AS severity,
         l."timestamp" AS detected_at,
         lt.technique_id AS mitre_technique_id,
         lt.tactic AS mitre_tactic
  FROM logs l LEFT JOIN log_technique lt ON lt.id = l.id
  WHERE l.severity IN ('CRITICAL', 'HIGH', 'ERROR', 'MEDIUM')
)"""

_SESS_ROWS = ", ".join(
    f"({_q(sid)}, TIMESTAMP '{st:%Y-%m-%d %H:%M:%S}', "
    + (f"TIMESTAMP '{en:%Y-%m-%d %H:%M:%S}'" if en else "CAST(NULL AS TIMESTAMP)")
    + f", 'completed', {_q(alg)}, {thr!r}, {_q(src)})"
    for sid, st, en, alg, thr, src in TD.FIXTURE_SESSIONS)

_SESS = f"""
analysis_sessions_raw(session_id, start_time, end_time, status, algorithm, threshold, log_source) AS (VALUES {_SESS_ROWS}),
analysis_sessions AS (
  SELECT session_id, start_time, end_time, status,
         to_json(struct_pack(algorithm := algorithm, threshold := threshold, log_source := log_source))::VARCHAR AS parameters
  FROM analysis_sessions_raw
)"""

_HUB = f"""
hub_one AS (
  SELECT a.log_id AS original_id, 'node-' || CAST(a.log_id % {TD.FIXTURE_NODES} AS VARCHAR) AS source_node,
         a.anomaly_score, a.severity, a.algorithm, a.mitre_technique_id, a.mitre_tactic,
         l."timestamp" AS log_timestamp, l.source, l.event_type,
         substr(coalesce(l.message, ''), 1, 500) AS message, l.hostname, l.username
  FROM anomalies a JOIN logs l ON a.log_id = l.id
),
hub_anomalies AS (
  SELECT *, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 48 HOUR AS imported_at, 0 AS import_batch FROM hub_one
  UNION ALL
  SELECT *, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 24 HOUR AS imported_at, 1 AS import_batch FROM hub_one
)"""

_DEV = f"""
device_events AS (
  SELECT 'dev-' || CAST(user_id % {TD.FIXTURE_DEVICES} AS VARCHAR) AS device_id,
         {_case('user_id % 9', [n for n, _ in TD.FIXTURE_DEVICE_KINDS])} AS name,
         {_case('user_id % 9', [v for _, v in TD.FIXTURE_DEVICE_KINDS])} AS vendor_id,
         ts AS event_time,
         CASE WHEN event_id % 2 = 0 THEN 'connected' ELSE 'disconnected' END AS event,
         event_id AS seq
  FROM events
)"""

PRELUDE = "WITH " + ",".join([_LOGS, _TECH, _ANOM, _SESS, _HUB, _DEV]) + "\n"


def with_prelude(body: str) -> str:
    """Full oracle text: the shared CTEs, then the query body (which may add CTEs with a leading comma)."""
    body = body.strip()
    if body.startswith(","):
        return PRELUDE + body
    return PRELUDE + body
