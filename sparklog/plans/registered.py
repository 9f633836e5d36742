"""The registered queries and their DuckDB oracles, grouped by SURVEY §2 section.

Conventions (both sides): counts BIGINT, floating results rounded to 6 places,
every computed column aliased, top-k ties broken by a key.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import aggregations as A
from ..operators import classify as C
from ..operators import devices as DV
from ..operators import features as FE
from ..operators import filters as FL
from ..operators import hub as H
from ..operators import joins as J
from ..operators import mitre as M
from ..operators import reports as RP
from ..operators import windows as WN
from ..sources.testdata import AS_OF
from .catalog import query

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
S2_START, S2_END = _dt.datetime(2024, 1, 10), _dt.datetime(2024, 1, 20)
S2_SQL = "a.detected_at >= TIMESTAMP '2024-01-10 00:00:00' AND a.detected_at <= TIMESTAMP '2024-01-20 00:00:00'"
S3_SQL = f"a.detected_at >= TIMESTAMP '2024-01-20 00:00:00' AND a.detected_at <= {AS_OF_SQL}"
HUB_SQL = """hub AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY original_id, source_node ORDER BY import_batch) AS rn FROM hub_anomalies)
  WHERE rn = 1)"""


def _r6(c):
    return X.round6(c)


# ==================================================================== 2.3 filters
query("f01_analysis_scan", """
SELECT id, "timestamp", source, event_id, event_type, severity, message, hostname, username, process_name, process_id
FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-05 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-25 00:00:00'
""")(lambda t: FL.analysis_scan(t.logs, _dt.datetime(2024, 1, 5), _dt.datetime(2024, 1, 25)))

query("f02_latest_source_scan", """
, latest AS (SELECT source FROM logs ORDER BY ingestion_time DESC, id DESC LIMIT 1)
SELECT l.id, l."timestamp", l.source, l.event_id, l.event_type, l.severity, l.message, l.hostname, l.username,
       l.process_name, l.process_id
FROM logs l JOIN latest ON l.source = latest.source
""")(lambda t: FL.analysis_scan(t.logs, source="latest"))

query("f03_named_source_fallback", """
SELECT id, "timestamp", source, event_id, event_type, severity, message, hostname, username, process_name, process_id
FROM logs WHERE source = 'sshd' OR NOT EXISTS (SELECT 1 FROM logs WHERE source = 'sshd')
""")(lambda t: FL.analysis_scan(t.logs, source="sshd"))

query("f03_missing_source_fallback", """
SELECT id, "timestamp", source, event_id, event_type, severity, message, hostname, username, process_name, process_id
FROM logs WHERE source = 'no-such-source' OR NOT EXISTS (SELECT 1 FROM logs WHERE source = 'no-such-source')
""")(lambda t: FL.analysis_scan(t.logs, source="no-such-source"))

query("f04_search_logs", """
SELECT id, "timestamp", source, severity, message FROM logs
WHERE contains(lower(message), 'denied') OR contains(lower(source), 'denied') OR contains(lower(severity), 'denied')
   OR contains(lower(message), '%')
""")(lambda t: FL.search_logs(t.logs, "denied").unionByName(FL.search_logs(t.logs, "%"))
     .select("id", "timestamp", "source", "severity", "message").distinct())

query("f05_high_risk_logs", """
SELECT id, "timestamp", severity, message FROM logs
WHERE lower(coalesce(severity, '')) IN ('critical', 'high', 'error')
   OR contains(lower(coalesce(message, '')), 'failed') OR contains(lower(coalesce(message, '')), 'unauthorized')
ORDER BY "timestamp" DESC NULLS LAST, id DESC LIMIT 500
""")(lambda t: FL.high_risk_logs(t.logs, 500).select("id", "timestamp", "severity", "message"))

query("f06_error_logs", """
SELECT "timestamp", source, event_type, message FROM logs WHERE severity IN ('CRITICAL', 'HIGH', 'ERROR')
""")(lambda t: FL.error_logs(t.logs))

query("f07_login_failures", """
SELECT "timestamp", hostname, username, message FROM logs
WHERE event_type LIKE '%Failed%Login%' OR event_type LIKE '%Failed%Logon%'
""")(lambda t: FL.login_failures(t.logs))

query("f08_recent_logs", """
SELECT "timestamp", source, event_type, severity, message FROM logs ORDER BY "timestamp" DESC, id DESC LIMIT 100
""")(lambda t: FL.recent_logs(t.logs, 100))

query("f10_list_anomalies", """
SELECT a.id, round(a.anomaly_score, 6) AS anomaly_score, a.algorithm, a.severity, a.mitre_technique_id, a.mitre_tactic,
       a.detected_at, l."timestamp", l.source, l.event_type, l.message
FROM anomalies a JOIN logs l ON a.log_id = l.id
WHERE a.detected_at >= TIMESTAMP '2024-01-10 00:00:00' AND a.severity = 'HIGH'
ORDER BY a.anomaly_score DESC, a.id ASC LIMIT 100
""")(lambda t: FL.list_anomalies(t.anomalies, t.logs, t.sessions, "s2", "high", 100)
     .withColumn("anomaly_score", _r6("anomaly_score")))

query("f11_min_severity", """
SELECT a.id, a.severity, round(a.anomaly_score, 6) AS anomaly_score FROM anomalies a
WHERE CASE upper(a.severity) WHEN 'INFO' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3
      WHEN 'CRITICAL' THEN 4 ELSE 0 END >= 3 AND a.anomaly_score >= 0.8
""")(lambda t: FL.min_severity(t.anomalies, "HIGH", 0.8).select("id", "severity", _r6("anomaly_score").alias("anomaly_score")))

query("f13_session_lookup", """
SELECT s.session_id, s.start_time, s.end_time, s.status,
       (SELECT CAST(count(*) AS BIGINT) FROM anomalies a WHERE a.detected_at >= s.start_time
          AND a.detected_at <= coalesce(s.end_time, TIMESTAMP '2024-01-31 00:00:00')) AS anomalies_detected
FROM analysis_sessions s WHERE s.session_id = 's2'
""")(lambda t: FL.lookup_key(t.sessions, "session_id", "s2").select("session_id", "start_time", "end_time", "status")
     .crossJoin(A.table_count(J.within_session(t.anomalies, t.sessions, "s2", AS_OF), "anomalies_detected")))

query("f14_retention_survivors", """
SELECT id, "timestamp", source FROM logs
WHERE NOT coalesce("timestamp" >= TIMESTAMP '2024-01-03 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-08 00:00:00'
                  AND source = 'nginx', false)
""")(lambda t: FL.retention_split(t.logs, _dt.datetime(2024, 1, 3), _dt.datetime(2024, 1, 8), "nginx")[0]
     .select("id", "timestamp", "source"))

query("f14_retention_deleted_count", """
SELECT CAST(count(*) AS BIGINT) AS deleted FROM logs
WHERE "timestamp" >= TIMESTAMP '2024-01-03 00:00:00' AND "timestamp" <= TIMESTAMP '2024-01-08 00:00:00' AND source = 'nginx'
""")(lambda t: A.table_count(FL.retention_split(t.logs, _dt.datetime(2024, 1, 3), _dt.datetime(2024, 1, 8), "nginx")[1],
                             "deleted"))

query("f16_f18_f19_display", """
SELECT id,
       CASE WHEN upper(trim(coalesce(severity, ''))) IN ('CRITICAL', 'HIGH', 'MEDIUM') THEN upper(trim(coalesce(severity, '')))
            ELSE 'LOW' END AS norm_severity,
       CASE upper(trim(coalesce(severity, ''))) WHEN 'CRITICAL' THEN 0.95 WHEN 'HIGH' THEN 0.82 WHEN 'MEDIUM' THEN 0.66
            ELSE 0.42 END::DOUBLE AS display_score,
       CASE WHEN contains(upper(source), 'WORKSTATION') THEN 'WKST' WHEN contains(upper(source), 'SERVER') THEN 'SRV'
            ELSE substr(upper(source), 1, 4) END AS short_source
FROM logs
""")(lambda t: t.logs.select("id", X.normalize_severity("severity").alias("norm_severity"),
                             FL.default_score(t.logs).alias("display_score"),
                             FL.short_source("source").alias("short_source")))

# ==================================================================== 2.4 joins
query("j01_anomalies_with_logs", """
SELECT a.id, round(a.anomaly_score, 6) AS anomaly_score, a.algorithm, a.severity, a.mitre_technique_id, a.mitre_tactic,
       a.detected_at, l."timestamp" AS log_timestamp, l.source, l.event_id, l.event_type, l.hostname, l.username, l.message
FROM anomalies a JOIN logs l ON a.log_id = l.id
""")(lambda t: J.anomalies_with_logs(t.anomalies, t.logs)
     .select("id", _r6("anomaly_score").alias("anomaly_score"), "algorithm", "severity", "mitre_technique_id",
             "mitre_tactic", "detected_at", "log_timestamp", "source", "event_id", "event_type", "hostname",
             "username", "message"))

query("j02_logs_left_anomalies", """
SELECT l.id, l."timestamp", l.source, coalesce(a.severity, l.severity, 'LOW') AS severity,
       round(a.anomaly_score, 6) AS anomaly_score, coalesce(a.algorithm, 'none') AS algorithm
FROM logs l LEFT JOIN anomalies a ON l.id = a.log_id
""")(lambda t: J.logs_with_anomalies(t.logs, t.anomalies)
     .select("id", "timestamp", "source", "severity", _r6("anomaly_score").alias("anomaly_score"), "algorithm"))

query("j04_j05_m01_technique_mapping", """
SELECT l.id, lt.technique_id AS mitre_technique_id, lt.tactic AS mitre_tactic
FROM logs l LEFT JOIN log_technique lt ON lt.id = l.id
""")(lambda t: t.mapped_logs.select("id", "mitre_technique_id", "mitre_tactic"))

query("u02_technique_lists", """
, cand AS (
  SELECT l.id, r.technique_id, 0 AS o FROM logs l JOIN eid_rules r ON l.event_id = r.rule_key
  UNION ALL
  SELECT l.id, k.technique_id, k.rule_order FROM logs l JOIN kw_rules k
    ON contains(lower(coalesce(l.message, '')) || ' ' || lower(coalesce(l.event_type, '')), k.rule_key))
, firsts AS (SELECT c.id, c.technique_id, min(c.o) AS o FROM cand c JOIN mitre_techniques t USING (technique_id)
             GROUP BY c.id, c.technique_id)
SELECT l.id, coalesce(array_to_string(list(f.technique_id ORDER BY f.o), ','), '') AS techniques
FROM logs l LEFT JOIN firsts f ON f.id = l.id GROUP BY l.id
""")(lambda t: M.technique_list(t.logs, t.techniques).select("id", F.array_join("techniques", ",").alias("techniques")))

query("j06_session_interval_anomalies", """
SELECT a.id, a.severity, a.detected_at FROM anomalies a
WHERE a.detected_at >= TIMESTAMP '2024-01-20 00:00:00' AND a.detected_at <= TIMESTAMP '2024-01-31 00:00:00'
""")(lambda t: J.within_session(t.anomalies, t.sessions, "s3", AS_OF).select("id", "severity", "detected_at"))

query("j06_assign_all_sessions", """
SELECT a.id, s.session_id FROM anomalies a JOIN analysis_sessions s
  ON a.detected_at >= s.start_time AND a.detected_at <= coalesce(s.end_time, TIMESTAMP '2024-01-31 00:00:00')
""")(lambda t: J.assign_sessions(t.anomalies, t.sessions, AS_OF).select("id", "session_id"))

query("j07_session_lower_bound", """
SELECT a.id, round(a.anomaly_score, 6) AS anomaly_score, l."timestamp", l.source, l.event_type, l.message
FROM anomalies a JOIN logs l ON a.log_id = l.id WHERE a.detected_at >= TIMESTAMP '2024-01-10 00:00:00'
""")(lambda t: J.anomalies_with_logs(J.within_session(t.anomalies, t.sessions, "s2", AS_OF, open_ended=True), t.logs,
                                     ["timestamp", "source", "event_type", "message"])
     .select("id", _r6("anomaly_score").alias("anomaly_score"), F.col("log_timestamp").alias("timestamp"),
             "source", "event_type", "message"))

query("j08_idempotent_hub_merge", f"""
, {HUB_SQL}
SELECT original_id, source_node, round(anomaly_score, 6) AS anomaly_score, severity, mitre_technique_id, message, imported_at
FROM hub
""")(lambda t: H.hub_state(t.hub_anomalies)
     .select("original_id", "source_node", _r6("anomaly_score").alias("anomaly_score"), "severity",
             "mitre_technique_id", "message", "imported_at"))

query("j08_second_import_adds_nothing", f"""
SELECT CAST(0 AS BIGINT) AS appended FROM (SELECT 1) t
""")(lambda t: A.table_count(H.merge_into_hub(H.hub_state(t.hub_anomalies.filter("import_batch = 0")),
                                               t.hub_anomalies.filter("import_batch = 1")), "appended"))

query("j09_asof_device_sessions", """
, w AS (
  SELECT device_id, seq, event_time, event,
         max(CASE WHEN event = 'connected' THEN event_time END)
           OVER (PARTITION BY device_id ORDER BY event_time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS connected_at
  FROM device_events)
SELECT device_id, seq, connected_at, event_time AS removed_at,
       round((epoch_us(event_time) - epoch_us(connected_at)) / 1e6, 2) AS duration_seconds
FROM w WHERE event = 'disconnected'
""")(lambda t: J.latest_connect_asof(t.device_events))

query("j10_node_names", f"""
, {HUB_SQL}
, per AS (SELECT source_node, CAST(count(*) AS BIGINT) AS total FROM hub GROUP BY source_node)
, nodes AS (SELECT 'node-' || CAST(i AS VARCHAR) AS node_id, 'host-node-' || CAST(i AS VARCHAR) AS hostname
            FROM range(0, 5, 2) r(i))
SELECT p.source_node, p.total, coalesce(n.hostname, substr(p.source_node, 1, 12)) AS node_name
FROM per p LEFT JOIN nodes n ON n.node_id = p.source_node
""")(lambda t: J.node_names(
    H.hub_state(t.hub_anomalies).groupBy("source_node").agg(F.count(F.lit(1)).cast("bigint").alias("total")),
    t.spark.range(0, 5, 2).select(F.concat(F.lit("node-"), F.col("id").cast("string")).alias("node_id"),
                                  F.concat(F.lit("host-node-"), F.col("id").cast("string")).alias("hostname")))
    .select("source_node", "total", "node_name"))

query("j11_update_from_mapping", """
SELECT a.id, lt.technique_id AS mitre_technique_id, lt.tactic AS mitre_tactic
FROM anomalies a LEFT JOIN log_technique lt ON lt.id = a.log_id
""")(lambda t: M.update_anomaly_techniques(
    t.anomalies.withColumn("mitre_technique_id", F.lit(None).cast("string")).withColumn("mitre_tactic", F.lit(None).cast("string")),
    t.mapped_logs).select("id", "mitre_technique_id", "mitre_tactic"))

query("j12_dominant_source", """
, c AS (
  SELECT s.session_id, l.source, count(*) AS cnt
  FROM anomalies a JOIN logs l ON l.id = a.log_id JOIN analysis_sessions s
    ON a.detected_at >= s.start_time AND (s.end_time IS NULL OR a.detected_at <= s.end_time)
  GROUP BY s.session_id, l.source)
SELECT session_id, source AS dominant_source, CAST(cnt AS BIGINT) AS dominant_count FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cnt DESC, source ASC NULLS LAST) AS rn FROM c)
WHERE rn = 1
""")(lambda t: J.dominant_source(t.anomalies, t.logs, t.sessions, AS_OF))

query("j13_node_upsert", f"""
, {HUB_SQL}
, cur AS (SELECT source_node AS node_id, 'active' AS status, CAST(count(*) AS BIGINT) AS total_anomalies
          FROM hub WHERE import_batch = 0 AND CAST(substr(source_node, 6) AS INT) < 3 GROUP BY source_node)
, upd AS (SELECT source_node AS node_id, 'inactive' AS status, CAST(count(*) AS BIGINT) AS total_anomalies
          FROM hub WHERE CAST(substr(source_node, 6) AS INT) >= 1 GROUP BY source_node)
SELECT coalesce(c.node_id, u.node_id) AS node_id,
       CASE WHEN u.node_id IS NOT NULL THEN u.status ELSE c.status END AS status,
       CASE WHEN u.node_id IS NOT NULL THEN u.total_anomalies ELSE c.total_anomalies END AS total_anomalies
FROM cur c FULL OUTER JOIN upd u ON c.node_id = u.node_id
""")(lambda t: _node_upsert(t))


def _node_upsert(t):
    hub = H.hub_state(t.hub_anomalies)
    idx = F.substring("source_node", 6, 10).cast("int")
    cur = (hub.filter((F.col("import_batch") == 0) & (idx < 3)).groupBy("source_node")
           .agg(F.count(F.lit(1)).cast("bigint").alias("total_anomalies"))
           .select(F.col("source_node").alias("node_id"), F.lit("active").alias("status"), "total_anomalies"))
    upd = (hub.filter(idx >= 1).groupBy("source_node").agg(F.count(F.lit(1)).cast("bigint").alias("total_anomalies"))
           .select(F.col("source_node").alias("node_id"), F.lit("inactive").alias("status"), "total_anomalies"))
    return J.upsert(cur, upd, "node_id", ["status", "total_anomalies"])


query("j16_logs_by_technique", """
SELECT l.id, l.source, a.mitre_technique_id, a.mitre_tactic FROM logs l JOIN anomalies a ON l.id = a.log_id
WHERE a.mitre_technique_id IS NOT NULL
""")(lambda t: J.logs_by_technique(t.logs, t.anomalies).select("id", "source", "mitre_technique_id", "mitre_tactic"))

# ==================================================================== 2.5 aggregations
query("a01_log_count", """
SELECT CAST(count(*) AS BIGINT) AS count FROM logs
""")(lambda t: A.table_count(t.logs))

query("a02_severity_counts", """
SELECT severity, CAST(count(*) AS BIGINT) AS count FROM logs WHERE severity IS NOT NULL GROUP BY severity
""")(lambda t: A.severity_distribution(t.logs))

query("a03_top_sources", """
SELECT source, CAST(count(*) AS BIGINT) AS count FROM logs GROUP BY source ORDER BY count DESC, source ASC NULLS LAST LIMIT 10
""")(lambda t: A.top_sources(t.logs, 10))

query("a04_event_type_summary", """
SELECT event_type, CAST(count(*) AS BIGINT) AS count FROM logs GROUP BY event_type
""")(lambda t: A.event_type_summary(t.logs))

query("a04_event_type_top10", """
SELECT event_type, CAST(count(*) AS BIGINT) AS count FROM logs WHERE event_type IS NOT NULL GROUP BY event_type
ORDER BY count DESC, event_type LIMIT 10
""")(lambda t: A.event_type_summary(t.logs, 10))

query("a05_time_range", """
SELECT min("timestamp") AS earliest, max("timestamp") AS latest FROM logs
""")(lambda t: A.time_range(t.logs))

query("a06_logs_by_hour", """
SELECT strftime("timestamp", '%Y-%m-%d %H:00') AS hour, CAST(count(*) AS BIGINT) AS count FROM logs GROUP BY 1
""")(lambda t: A.logs_by_hour(t.logs))

query("a07_anomaly_summary", """
SELECT severity, algorithm, CAST(count(*) AS BIGINT) AS count, round(avg(anomaly_score), 6) AS avg_score
FROM anomalies GROUP BY severity, algorithm
""")(lambda t: A.anomaly_summary(t.anomalies))

query("a08_severity_zero_filled", """
, dim(severity, o) AS (VALUES ('CRITICAL', 0), ('HIGH', 1), ('MEDIUM', 2), ('LOW', 3))
, c AS (SELECT upper(severity) AS severity, count(*) AS n FROM anomalies GROUP BY 1)
SELECT d.severity, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM dim d LEFT JOIN c ON c.severity = d.severity
""")(lambda t: A.severity_zero_filled(t.anomalies))

query("a09_timeline_24h", """
, spine AS (SELECT i AS bucket, TIMESTAMP '2024-01-30 02:00:00' + to_hours(CAST(2 * i AS BIGINT)) AS bucket_start
            FROM range(12) r(i))
, hits AS (
  SELECT CAST(floor((epoch(detected_at) - epoch(TIMESTAMP '2024-01-30 02:00:00')) / 7200) AS BIGINT) AS bucket,
         count(*) AS n, count(*) FILTER (WHERE upper(coalesce(severity, '')) = 'CRITICAL') AS crit
  FROM anomalies WHERE detected_at >= TIMESTAMP '2024-01-30 02:00:00' GROUP BY 1)
SELECT CAST(s.bucket AS INTEGER) AS bucket, strftime(s.bucket_start, '%H:00') AS time,
       CAST(coalesce(h.n, 0) AS BIGINT) AS anomalies, CAST(coalesce(h.crit, 0) AS BIGINT) AS critical
FROM spine s LEFT JOIN hits h ON h.bucket = s.bucket
""")(lambda t: A.timeline_24h(t.anomalies, AS_OF))

query("a10_technique_summary", """
, g AS (
  SELECT a.mitre_technique_id AS id, coalesce(mt.technique_name, a.mitre_technique_id) AS name,
         coalesce(a.mitre_tactic, mt.tactic, 'Unknown') AS tactic, CAST(count(*) AS BIGINT) AS detections,
         coalesce(max(a.anomaly_score), 0) AS max_score
  FROM anomalies a LEFT JOIN mitre_techniques mt ON a.mitre_technique_id = mt.technique_id
  WHERE a.mitre_technique_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT id, name, tactic, detections,
       CASE WHEN max_score >= 0.90 THEN 'CRITICAL' WHEN max_score >= 0.75 THEN 'HIGH'
            WHEN max_score >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM g
""")(lambda t: A.technique_summary(t.anomalies, t.techniques))

query("a11_attack_matrix", """
, det AS (SELECT mitre_technique_id AS technique_id, count(*) AS n FROM anomalies WHERE mitre_technique_id IS NOT NULL GROUP BY 1)
SELECT t.tactic, CAST(count(*) AS BIGINT) AS total_techniques,
       CAST(count(*) FILTER (WHERE d.n IS NOT NULL) AS BIGINT) AS detected_techniques,
       CAST(coalesce(sum(d.n), 0) AS BIGINT) AS detections
FROM mitre_techniques t LEFT JOIN det d ON d.technique_id = t.technique_id GROUP BY t.tactic
""")(lambda t: A.attack_matrix(t.techniques, t.anomalies).drop("techniques"))

query("a10_technique_totals", """
SELECT string_agg(DISTINCT coalesce(a.mitre_tactic, mt.tactic, 'Unknown'), ',' ORDER BY coalesce(a.mitre_tactic, mt.tactic, 'Unknown')) AS tactics,
       CAST(count(*) AS BIGINT) AS total_detections
FROM anomalies a LEFT JOIN mitre_techniques mt ON a.mitre_technique_id = mt.technique_id WHERE a.mitre_technique_id IS NOT NULL
""")(lambda t: A.technique_totals(A.technique_summary(t.anomalies, t.techniques)))

query("a11_attack_matrix_techniques", """
, det AS (SELECT mitre_technique_id AS technique_id, count(*) AS n FROM anomalies WHERE mitre_technique_id IS NOT NULL GROUP BY 1)
SELECT t.tactic, t.technique_id, t.technique_name, d.n IS NOT NULL AS detected, CAST(coalesce(d.n, 0) AS BIGINT) AS detection_count
FROM mitre_techniques t LEFT JOIN det d ON d.technique_id = t.technique_id
""")(lambda t: A.matrix_techniques(A.attack_matrix(t.techniques, t.anomalies)))

query("a11_attack_matrix_totals", """
SELECT CAST(count(*) AS BIGINT) AS total_techniques,
       CAST(count(*) FILTER (WHERE technique_id IN (SELECT mitre_technique_id FROM anomalies)) AS BIGINT) AS total_detected
FROM mitre_techniques
""")(lambda t: A.matrix_totals(A.attack_matrix(t.techniques, t.anomalies)))

query("a12_detected_tactics", """
SELECT DISTINCT mitre_tactic AS tactic FROM anomalies WHERE mitre_tactic IS NOT NULL
""")(lambda t: M.all_tactics(t.anomalies.filter(F.col("mitre_tactic").isNotNull())
                             .select(F.col("mitre_tactic").alias("tactic"))))

query("a13_attack_coverage", """
SELECT CAST(count(DISTINCT mitre_technique_id) AS BIGINT) AS unique_techniques,
       CAST(count(DISTINCT mitre_tactic) AS BIGINT) AS unique_tactics
FROM anomalies WHERE mitre_technique_id IS NOT NULL
""")(lambda t: A.attack_coverage(t.anomalies))

query("a14_score_stats", f"""
SELECT round(coalesce(avg(anomaly_score), 0), 6) AS avg_score, round(coalesce(max(anomaly_score), 0), 6) AS max_score,
       round(coalesce(min(anomaly_score), 0), 6) AS min_score
FROM anomalies a WHERE {S2_SQL}
""")(lambda t: A.score_stats(J.within_session(t.anomalies, t.sessions, "s2", AS_OF)))

query("a15_algorithm_distribution", """
SELECT algorithm, CAST(count(*) AS BIGINT) AS count FROM anomalies GROUP BY algorithm
""")(lambda t: A.algorithm_distribution(t.anomalies))

query("a16_top_techniques", """
SELECT mitre_technique_id, mitre_tactic, CAST(count(*) AS BIGINT) AS count FROM anomalies
WHERE mitre_technique_id IS NOT NULL GROUP BY 1, 2 ORDER BY count DESC, mitre_technique_id, mitre_tactic NULLS LAST LIMIT 10
""")(lambda t: A.top_techniques(t.anomalies, 10))

query("a17_top_anomalous_sources", """
SELECT coalesce(l.source, 'unknown') AS source, CAST(count(*) AS BIGINT) AS count
FROM anomalies a JOIN logs l ON a.log_id = l.id GROUP BY l.source ORDER BY count DESC, 1 LIMIT 5
""")(lambda t: A.top_anomalous_sources(t.anomalies, t.logs, 5))

query("a18_tactic_distribution", """
SELECT mitre_tactic, CAST(count(*) AS BIGINT) AS count FROM anomalies WHERE mitre_tactic IS NOT NULL GROUP BY 1
""")(lambda t: A.tactic_distribution(t.anomalies))

query("a19_session_severity_counts", f"""
SELECT severity, CAST(count(*) AS BIGINT) AS count FROM anomalies a WHERE {S3_SQL} GROUP BY severity
""")(lambda t: A.severity_counts(J.within_session(t.anomalies, t.sessions, "s3", AS_OF)))

query("a20_severity_share", """
, c AS (SELECT severity, count(*) AS count FROM anomalies GROUP BY severity)
SELECT severity, CAST(count AS BIGINT) AS count,
       round(count / greatest((SELECT sum(count) FROM c), 1) * 100.0, 6) AS percent FROM c
""")(lambda t: A.share_of_total(A.severity_counts(t.anomalies)))

query("a21_report_header", f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM logs) AS total_logs,
       (SELECT CAST(count(*) AS BIGINT) FROM anomalies a WHERE {S2_SQL}) AS total_anomalies,
       round(CASE WHEN (SELECT count(*) FROM logs) = 0 THEN 0.0 ELSE
         (SELECT count(*) FROM anomalies a WHERE {S2_SQL}) / (SELECT count(*) FROM logs) * 100.0 END, 6) AS anomaly_rate
""")(lambda t: A.report_header(t.logs, J.within_session(t.anomalies, t.sessions, "s2", AS_OF)))

query("a22_risk_index", """
, agg AS (SELECT CAST(coalesce(sum(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 6
                                                WHEN 'CRITICAL' THEN 10 ELSE 0 END), 0) AS BIGINT) AS weighted,
                 CAST(count(*) AS BIGINT) AS n FROM anomalies)
SELECT weighted, n, CAST(round_even(weighted / greatest(n * 10, 1) * 100.0, 0) AS BIGINT) AS risk_index,
       CASE WHEN round_even(weighted / greatest(n * 10, 1) * 100.0, 0) >= 70 THEN 'HIGH'
            WHEN round_even(weighted / greatest(n * 10, 1) * 100.0, 0) >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM agg
""")(lambda t: A.risk_index(t.anomalies))

query("a23_recommendations", """
, sev AS (SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS crit, count(*) FILTER (WHERE severity = 'HIGH') AS high
          FROM anomalies)
, src AS (SELECT coalesce(l.source, 'unknown') AS s, count(*) AS n FROM anomalies a JOIN logs l ON a.log_id = l.id
          GROUP BY l.source ORDER BY n DESC, 1 LIMIT 1)
, tech AS (SELECT mitre_technique_id AS t, mitre_tactic AS tac, count(*) AS n FROM anomalies WHERE mitre_technique_id IS NOT NULL
           GROUP BY 1, 2 ORDER BY n DESC, 1, 2 NULLS LAST LIMIT 1)
, recs AS (
  SELECT 1 AS k, 'Prioritize triage of ' || crit || ' CRITICAL anomaly/anomalies within 24 hours and isolate affected endpoints immediately.' AS r FROM sev WHERE crit > 0
  UNION ALL SELECT 2, 'Investigate ' || high || ' HIGH-severity finding(s) and validate whether they indicate active lateral movement or privilege misuse.' FROM sev WHERE high > 0
  UNION ALL SELECT 3, 'Increase logging and detection coverage for top source ''' || s || ''' which produced ' || n || ' anomaly/anomalies.' FROM src
  UNION ALL SELECT 4, 'Map incident-response playbooks to MITRE ' || coalesce(t, 'N/A') || ' (' || replace(coalesce(tac, 'unknown'), '_', ' ') || ') and run targeted containment drills for this pattern.' FROM tech
  UNION ALL SELECT 5, 'Schedule rule/model tuning to reduce false positives while preserving coverage on HIGH and CRITICAL detections.')
SELECT CAST(row_number() OVER (ORDER BY k) AS BIGINT) AS rank, r AS recommendation FROM recs QUALIFY rank <= 5
""")(lambda t: A.recommendations(t.anomalies, t.logs))

query("a24_dataset_severity", """
SELECT upper(coalesce(severity, 'LOW')) AS severity, CAST(count(*) AS BIGINT) AS count,
       (SELECT CAST(count(*) AS BIGINT) FROM logs) AS total
FROM logs GROUP BY 1
""")(lambda t: A.dataset_severity(t.logs))

query("a25_dataset_risk", """
, hr AS (SELECT CAST(count(*) AS BIGINT) AS high_risk FROM logs
         WHERE lower(coalesce(severity, '')) IN ('critical', 'high', 'error')
            OR contains(lower(coalesce(message, '')), 'failed') OR contains(lower(coalesce(message, '')), 'unauthorized'))
, n AS (SELECT CAST(count(*) AS BIGINT) AS total FROM logs)
SELECT total, high_risk, round(least(1.0, high_risk * 3.0 / greatest(total, 1)), 4) AS threat_score,
       round(least(0.99, 0.65 + high_risk / greatest(total, 1)), 6) AS confidence,
       CASE WHEN high_risk > 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level
FROM n CROSS JOIN hr
""")(lambda t: A.dataset_risk(t.logs, FL.high_risk_logs(t.logs, None)))

query("a26_batch_summary", """
SELECT CAST(count(*) AS BIGINT) AS total_anomalies,
       CAST(count(*) FILTER (WHERE anomaly_score >= 0.95) AS BIGINT) AS critical,
       CAST(count(*) FILTER (WHERE anomaly_score < 0.95 AND anomaly_score >= 0.85) AS BIGINT) AS high,
       CAST(count(*) FILTER (WHERE anomaly_score < 0.85 AND anomaly_score >= 0.70) AS BIGINT) AS medium,
       CAST(count(*) FILTER (WHERE anomaly_score < 0.70) AS BIGINT) AS low,
       (SELECT CAST(count(*) AS BIGINT) FROM logs) AS total_logs_analyzed,
       round(count(*) / greatest((SELECT count(*) FROM logs), 1), 6) AS anomaly_rate
FROM anomalies
""")(lambda t: A.batch_summary(t.anomalies, t.logs))

query("a27_hub_severity", f"""
, {HUB_SQL}
SELECT severity, CAST(count(*) AS BIGINT) AS count FROM hub GROUP BY severity
""")(lambda t: A.severity_counts(H.hub_state(t.hub_anomalies)))

query("a28_hub_tactics", f"""
, {HUB_SQL}
SELECT mitre_tactic, CAST(count(*) AS BIGINT) AS count FROM hub WHERE mitre_tactic IS NOT NULL GROUP BY 1
""")(lambda t: A.tactic_distribution(H.hub_state(t.hub_anomalies)))

query("a29_hub_node_totals", f"""
, {HUB_SQL}
SELECT source_node, CAST(count(*) AS BIGINT) AS total_anomalies,
       CAST(sum(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS critical,
       CAST(sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high,
       round(avg(anomaly_score), 6) AS avg_score, max(imported_at) AS last_sync
FROM hub GROUP BY source_node
""")(lambda t: H.node_totals(H.hub_state(t.hub_anomalies)))

query("a29_hub_totals", f"""
, {HUB_SQL}
SELECT CAST(count(DISTINCT source_node) AS BIGINT) AS total_nodes, CAST(count(*) AS BIGINT) AS total_anomalies FROM hub
""")(lambda t: H.hub_totals(H.hub_state(t.hub_anomalies)))

query("a30_cross_node_correlations", f"""
, {HUB_SQL}
SELECT mitre_technique_id, mitre_tactic, CAST(count(DISTINCT source_node) AS BIGINT) AS node_count,
       CAST(count(*) AS BIGINT) AS total_hits, string_agg(DISTINCT source_node, ',' ORDER BY source_node) AS affected_nodes,
       round(avg(anomaly_score), 6) AS avg_score, min(log_timestamp) AS first_seen, max(log_timestamp) AS last_seen,
       CASE WHEN count(DISTINCT source_node) >= 3 THEN 'CRITICAL' ELSE 'HIGH' END AS threat_level,
       count(DISTINCT source_node) >= 2 AS is_coordinated
FROM hub WHERE mitre_technique_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source_node) >= 2
""")(lambda t: H.cross_node_correlations(H.hub_state(t.hub_anomalies)))

query("a31_tactic_heatmap", f"""
, {HUB_SQL}
, h AS (SELECT * FROM hub WHERE mitre_tactic IS NOT NULL)
, c AS (SELECT source_node, mitre_tactic, count(*) AS n FROM h GROUP BY 1, 2)
SELECT nn.source_node, tt.mitre_tactic, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT DISTINCT source_node FROM h) nn CROSS JOIN (SELECT DISTINCT mitre_tactic FROM h) tt
LEFT JOIN c ON c.source_node = nn.source_node AND c.mitre_tactic = tt.mitre_tactic
""")(lambda t: H.tactic_heatmap_long(H.hub_state(t.hub_anomalies)))

query("a32_node_threat_level", f"""
, {HUB_SQL}
, per AS (SELECT source_node, count(*) AS a FROM hub GROUP BY 1)
, lg AS (SELECT 'node-' || CAST(id % 5 AS VARCHAR) AS source_node, count(*) AS n FROM logs GROUP BY 1)
SELECT p.source_node, CAST(p.a AS BIGINT) AS total_anomalies, CAST(l.n AS BIGINT) AS total_logs,
       CASE WHEN p.a = 0 THEN 'CLEAN' WHEN p.a / greatest(l.n, 1) >= 0.20 THEN 'CRITICAL'
            WHEN p.a / greatest(l.n, 1) >= 0.10 THEN 'HIGH' WHEN p.a / greatest(l.n, 1) >= 0.05 THEN 'MEDIUM'
            ELSE 'LOW' END AS threat_level
FROM per p JOIN lg l ON l.source_node = p.source_node
""")(lambda t: _node_threat(t))


def _node_threat(t):
    per = H.hub_state(t.hub_anomalies).groupBy("source_node").agg(F.count(F.lit(1)).cast("bigint").alias("total_anomalies"))
    lg = t.logs.groupBy(F.concat(F.lit("node-"), (F.col("id") % 5).cast("string")).alias("source_node")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("total_logs"))
    j = per.join(lg, "source_node")
    return j.select("source_node", "total_anomalies", "total_logs",
                    H.node_threat_level(F.col("total_anomalies"), F.col("total_logs")).alias("threat_level"))


query("a34_device_event_counters", """
, d AS (SELECT *, CASE WHEN lower(name) LIKE '%flash%' OR lower(name) LIKE '%storage%' OR lower(name) LIKE '%phone%'
                         OR lower(name) LIKE '%ethernet%' THEN 'HIGH' ELSE 'LOW' END AS risk_level FROM device_events)
SELECT CAST(count(*) FILTER (WHERE event = 'connected') AS BIGINT) AS connected,
       CAST(count(*) FILTER (WHERE event = 'disconnected') AS BIGINT) AS disconnected,
       CAST(count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS BIGINT) AS high_risk
FROM d
""")(lambda t: DV.event_counters(t.device_events.withColumn(
    "risk_level", F.when(X.contains_any(F.lower("name"), ["flash", "storage", "phone", "ethernet"]), F.lit("HIGH"))
    .otherwise(F.lit("LOW")))))

query("a35_session_listing", """
, cnt AS (SELECT s.session_id, count(a.id) AS n FROM analysis_sessions s LEFT JOIN anomalies a
            ON a.detected_at >= s.start_time AND a.detected_at <= coalesce(s.end_time, TIMESTAMP '2024-01-31 00:00:00')
          GROUP BY 1)
, lg AS (SELECT s.session_id, count(l.id) AS n FROM analysis_sessions s LEFT JOIN logs l
           ON l."timestamp" >= s.start_time AND l."timestamp" <= coalesce(s.end_time, TIMESTAMP '2024-01-31 00:00:00')
         GROUP BY 1)
, dom AS (SELECT session_id, source FROM (
            SELECT s.session_id, l.source, row_number() OVER (PARTITION BY s.session_id ORDER BY count(*) DESC, l.source) AS rn
            FROM anomalies a JOIN logs l ON l.id = a.log_id JOIN analysis_sessions s
              ON a.detected_at >= s.start_time AND (s.end_time IS NULL OR a.detected_at <= s.end_time)
            GROUP BY s.session_id, l.source) WHERE rn = 1)
SELECT s.session_id, s.start_time, upper(coalesce(s.status, 'completed')) AS status,
       round(CASE WHEN s.end_time IS NULL THEN 0.0 ELSE (epoch_us(s.end_time) - epoch_us(s.start_time)) / 1e6 END, 2) AS duration_seconds,
       coalesce(json_extract_string(s.parameters, '$.algorithm'), 'statistical') AS algorithm,
       CAST(coalesce(json_extract_string(s.parameters, '$.threshold'), '0.7') AS DOUBLE) AS threshold,
       CAST(lg.n AS BIGINT) AS total_logs, CAST(cnt.n AS BIGINT) AS anomalies_found,
       CASE WHEN lower(coalesce(json_extract_string(s.parameters, '$.log_source'), '')) NOT IN ('', 'all', 'latest')
              THEN json_extract_string(s.parameters, '$.log_source')
            WHEN lower(coalesce(json_extract_string(s.parameters, '$.log_source'), '')) = 'all' THEN 'all'
            ELSE coalesce(dom.source, 'unknown') END AS source_filename
FROM analysis_sessions s JOIN cnt USING (session_id) JOIN lg USING (session_id) LEFT JOIN dom USING (session_id)
""")(lambda t: _session_listing(t))


def _session_listing(t):
    from ..operators import reports as RP
    return RP.session_listing(t.sessions, t.logs, t.anomalies, AS_OF)


query("a36_coverage_by_tactic", """
, det AS (SELECT mitre_technique_id AS technique_id, count(*) AS n FROM anomalies WHERE mitre_technique_id IS NOT NULL GROUP BY 1)
SELECT t.tactic, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS detections,
       CAST(count(*) FILTER (WHERE d.n > 0) AS BIGINT) AS covered_techniques, CAST(count(*) AS BIGINT) AS total_techniques
FROM mitre_techniques t LEFT JOIN det d ON d.technique_id = t.technique_id GROUP BY t.tactic
""")(lambda t: A.coverage_by_tactic(t.anomalies, t.techniques))

query("a37_system_overview", f"""
, {HUB_SQL}
, cur AS (SELECT source_node AS node_id FROM hub WHERE import_batch = 0 AND CAST(substr(source_node, 6) AS INT) < 3 GROUP BY source_node)
, upd AS (SELECT source_node AS node_id FROM hub WHERE CAST(substr(source_node, 6) AS INT) >= 1 GROUP BY source_node)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM logs) AS total_logs,
       (SELECT CAST(count(*) AS BIGINT) FROM anomalies) AS total_anomalies,
       (SELECT CAST(count(*) AS BIGINT) FROM analysis_sessions) AS total_sessions,
       (SELECT session_id FROM analysis_sessions ORDER BY start_time DESC, session_id DESC LIMIT 1) AS last_session,
       (SELECT CAST(count(*) AS BIGINT) FROM cur WHERE node_id NOT IN (SELECT node_id FROM upd)) AS nodes_online
""")(lambda t: A.system_overview(t.logs, t.anomalies, t.sessions, _node_upsert(t)))

query("a38_listed_severity", """
, listed AS (SELECT * FROM anomalies ORDER BY anomaly_score DESC, id ASC LIMIT 100)
SELECT severity, CAST(count(*) AS BIGINT) AS count FROM listed GROUP BY severity
""")(lambda t: A.listed_severity(t.anomalies, 100))

# ==================================================================== 2.6 windows
query("w01_recent_with_display_id", """
, r AS (SELECT id, "timestamp", source, message FROM logs WHERE contains(lower(message), 'refused')
        ORDER BY "timestamp" DESC, id DESC LIMIT 200)
SELECT CAST(row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS BIGINT) AS display_id, id, "timestamp", source, message FROM r
""")(lambda t: _w01(t))


def _w01(t):
    order = [F.desc("timestamp"), F.desc("id")]
    r = FL.search_logs(t.logs, "refused", ["message"]).orderBy(*order).limit(200)
    return WN.display_ids(r, order).select("display_id", "id", "timestamp", "source", "message")


query("w03_counter_rates", """
, s AS (SELECT user_id, ts, event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS counter FROM events)
SELECT user_id, event_id, round(greatest(counter - lag(counter) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 6) AS rate
FROM s
""")(lambda t: _w03(t))


def _w03(t):
    from ..operators import windows as WN
    s = WN.running_counter(t.events, "user_id", ["ts", "event_id"], "value", "counter")
    return WN.counter_rate(s, "user_id", ["ts", "event_id"], "counter", "rate") \
        .select("user_id", "event_id", _r6("rate").alias("rate"))


query("w04_latest_per_source", """
SELECT source, id AS latest_id, "timestamp" AS latest_ts FROM (
  SELECT source, id, "timestamp", row_number() OVER (PARTITION BY source ORDER BY ingestion_time DESC, id DESC) AS rn FROM logs)
WHERE rn = 1
""")(lambda t: _w04(t))


def _w04(t):
    from ..operators import windows as WN
    return WN.latest_per_key(t.logs, "source", [F.col("ingestion_time"), F.col("id")]) \
        .select("source", F.col("id").alias("latest_id"), F.col("timestamp").alias("latest_ts"))


query("w05_dense_ids", """
SELECT event_id, CAST(999999 + row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS new_id FROM events
""")(lambda t: _w05(t))


def _w05(t):
    from ..operators import windows as WN
    return WN.continue_ids(t.events.select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 999999, "new_id") \
        .select("event_id", "new_id")


query("w06_ordinal_encoding", """
SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS BIGINT) AS code FROM (
  SELECT DISTINCT CASE WHEN source IS NULL OR source = '' THEN 'unknown' ELSE source END AS source FROM logs)
""")(lambda t: FE.ordinal_encoding(
    t.logs.select(F.when(X.is_present("source"), F.col("source")).otherwise(F.lit("unknown")).alias("source")),
    "source", "code").withColumnRenamed("value", "source"))

# ==================================================================== 2.7 top-k
query("l01_recent_logs_search", """
SELECT l.id, l."timestamp", l.source, coalesce(a.severity, l.severity, 'LOW') AS severity, l.message
FROM logs l LEFT JOIN anomalies a ON a.log_id = l.id
WHERE contains(lower(l.message), 'user1') OR contains(lower(l.source), 'user1') OR contains(lower(l.severity), 'user1')
ORDER BY l."timestamp" DESC, l.id DESC LIMIT 50
""")(lambda t: RP.recent_logs_search(t.logs, t.anomalies, "user1", 50)
     .select("id", "timestamp", "source", "severity", "message"))

query("l02_top_anomalies", f"""
SELECT round(a.anomaly_score, 6) AS anomaly_score, a.severity, a.mitre_technique_id, a.mitre_tactic,
       l."timestamp" AS log_timestamp, l.source, l.event_id, a.id
FROM anomalies a JOIN logs l ON a.log_id = l.id WHERE {S2_SQL}
ORDER BY a.anomaly_score DESC, a.id ASC LIMIT 20
""")(lambda t: RP.top_anomalies(J.anomalies_with_logs(J.within_session(t.anomalies, t.sessions, "s2", AS_OF), t.logs), 20)
     .select(_r6("anomaly_score").alias("anomaly_score"), "severity", "mitre_technique_id", "mitre_tactic",
             "log_timestamp", "source", "event_id", "id"))

query("l03_score_timeline", f"""
SELECT a.detected_at, round(a.anomaly_score, 6) AS anomaly_score, a.severity, a.id FROM anomalies a WHERE {S3_SQL}
""")(lambda t: RP.score_timeline(J.within_session(t.anomalies, t.sessions, "s3", AS_OF))
     .select("detected_at", _r6("anomaly_score").alias("anomaly_score"), "severity", "id"))

query("l09_recent_critical", """
SELECT id, detected_at, round(anomaly_score, 6) AS anomaly_score FROM anomalies WHERE severity = 'CRITICAL'
ORDER BY detected_at DESC, id DESC LIMIT 10
""")(lambda t: RP.recent_critical(t.anomalies, 10)
     .select("id", "detected_at", _r6("anomaly_score").alias("anomaly_score")))

# ==================================================================== 2.8 sets
query("u01_snapshot_diff", """
, snap AS (SELECT DISTINCT device_id, CAST(date_diff('day', DATE '2024-01-01', CAST(event_time AS DATE)) AS BIGINT) AS snapshot
           FROM device_events)
, days AS (SELECT DISTINCT snapshot FROM snap)
, devs AS (SELECT DISTINCT device_id FROM snap)
, grid AS (SELECT d.device_id, s.snapshot, (x.device_id IS NOT NULL) AS now_p
           FROM devs d CROSS JOIN days s LEFT JOIN snap x ON x.device_id = d.device_id AND x.snapshot = s.snapshot)
, g AS (SELECT *, coalesce(lag(now_p) OVER (PARTITION BY device_id ORDER BY snapshot), false) AS before_p FROM grid)
SELECT device_id, snapshot, CASE WHEN now_p THEN 'connected' ELSE 'disconnected' END AS event FROM g WHERE now_p <> before_p
""")(lambda t: DV.snapshot_history_diff(
    t.device_events.select("device_id", F.datediff(F.to_date("event_time"), F.lit("2024-01-01").cast("date"))
                           .cast("bigint").alias("snapshot"))))

# ==================================================================== 2.11 classification
query("g03_threat_scores", """
, b AS (SELECT a.id, a.anomaly_score AS s, l.severity, l.event_type, hour(l."timestamp") AS h
        FROM anomalies a JOIN logs l ON a.log_id = l.id)
, m AS (SELECT id, s, s * 100.0 AS base,
               1.0::DOUBLE * (CASE WHEN upper(coalesce(severity, '')) IN ('CRITICAL', 'HIGH', 'ERROR') THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END)
                   * (CASE WHEN contains(lower(coalesce(event_type, '')), 'failed') OR contains(lower(coalesce(event_type, '')), 'error')
                           OR contains(lower(coalesce(event_type, '')), 'unauthorized') THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END)
                   * (CASE WHEN h IS NOT NULL AND (h < 6 OR h > 22) THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END) AS mult FROM b)
SELECT id, round(least(base * mult, 100.0), 2) AS threat_score,
       CASE WHEN least(base * mult, 100.0) / 100.0 >= 0.95 THEN 'CRITICAL' WHEN least(base * mult, 100.0) / 100.0 >= 0.85 THEN 'HIGH'
            WHEN least(base * mult, 100.0) / 100.0 >= 0.70 THEN 'MEDIUM' WHEN least(base * mult, 100.0) / 100.0 >= 0.50 THEN 'LOW'
            ELSE 'INFO' END AS threat_level,
       round(mult, 2) AS multiplier
FROM m
""")(lambda t: _g03(t))


def _g03(t):
    a = t.anomalies.select("id", "log_id", "anomaly_score")
    l = t.logs.select(F.col("id").alias("_lid"), "severity", "event_type", F.hour("timestamp").alias("hour_of_day"))
    j = a.join(l, a["log_id"] == l["_lid"])
    return C.threat_score(j).select("id", "threat_score", "threat_level", "multiplier")


query("g06_threat_classification", """
SELECT a.id AS log_id,
       coalesce(CASE l.event_id WHEN '4625' THEN 'unauthorized_access' WHEN '4672' THEN 'privilege_escalation'
                  WHEN '4720' THEN 'persistence' WHEN '4732' THEN 'privilege_escalation' WHEN '4688' THEN 'command_execution'
                  WHEN '5140' THEN 'lateral_movement' WHEN '7045' THEN 'persistence' END,
         CASE WHEN regexp_matches(lower(coalesce(l.message, '')), 'unauthorized|failed login|access denied|invalid credentials') THEN 'unauthorized_access'
              WHEN regexp_matches(lower(coalesce(l.message, '')), 'privilege|administrator|sudo|elevation|root') THEN 'privilege_escalation'
              WHEN regexp_matches(lower(coalesce(l.message, '')), 'powershell|cmd\\.exe|bash|script|execute') THEN 'command_execution'
              WHEN regexp_matches(lower(coalesce(l.message, '')), 'virus|malware|trojan|ransomware|suspicious') THEN 'malware_activity'
              WHEN regexp_matches(lower(coalesce(l.message, '')), 'exfiltration|data transfer|upload|copy') THEN 'data_exfiltration'
              ELSE 'unknown' END) AS category,
       CASE WHEN a.anomaly_score >= 0.95 THEN 'CRITICAL' WHEN a.anomaly_score >= 0.85 THEN 'HIGH'
            WHEN a.anomaly_score >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       substr(coalesce(l.message, ''), 1, 200) AS description,
       CAST(CASE WHEN l.username IS NOT NULL AND l.username <> '' THEN 1 ELSE 0 END
          + CASE WHEN l.process_name IS NOT NULL AND l.process_name <> '' THEN 1 ELSE 0 END AS BIGINT) AS n_indicators,
       round(least(CASE WHEN a.anomaly_score >= 0.95 THEN 1.0 WHEN a.anomaly_score >= 0.85 THEN 0.75
                        WHEN a.anomaly_score >= 0.70 THEN 0.5 ELSE 0.25 END * 100.0 * a.anomaly_score
                   * least(1.0 + CASE WHEN l.hostname IS NOT NULL AND l.hostname <> '' THEN 1 ELSE 0 END * 0.1, 2.0), 100.0), 2) AS risk_score
FROM anomalies a JOIN logs l ON a.log_id = l.id
""")(lambda t: _g06(t))


def _g06(t):
    a = t.anomalies.select(F.col("log_id").alias("_aid"), "anomaly_score")
    j = t.logs.join(a, t.logs["id"] == a["_aid"])
    th = C.classify_threats(j)
    return th.select("log_id", "category", "severity", "description",
                     F.size("indicators").cast("bigint").alias("n_indicators"),
                     C.threat_risk_score().alias("risk_score"))


query("g08_g10_device_classes", """
, d AS (SELECT DISTINCT device_id, name, vendor_id FROM device_events)
, c AS (SELECT *, CASE
    WHEN regexp_matches(lower(name), 'storage|flash|disk|drive|card|pendrive') THEN 'storage'
    WHEN regexp_matches(lower(name), 'audio|headphone|headset|speaker|microphone|sound') THEN 'audio'
    WHEN regexp_matches(lower(name), 'keyboard|mouse|hid|input') THEN 'hid'
    WHEN regexp_matches(lower(name), 'network|ethernet|wifi|wlan|adapter') THEN 'network'
    WHEN regexp_matches(lower(name), 'camera|webcam|imaging') THEN 'camera'
    WHEN regexp_matches(lower(name), 'android|iphone|phone|mtp|adb') THEN 'smartphone'
    WHEN contains(lower(name), 'print') THEN 'printer'
    WHEN vendor_id IN ('18d1', '0e8d', '2717', '04e8', '0bb4', '12d1', '05ac') THEN 'smartphone'
    WHEN vendor_id IN ('0781', '058f', '13fe', '0951', '8564', '14cd') THEN 'storage'
    WHEN vendor_id IN ('0d8c', '08bb') THEN 'audio'
    WHEN vendor_id IN ('0bda', '0b95') THEN 'network'
    ELSE 'unknown' END AS device_class FROM d)
SELECT device_id, device_class,
       CASE WHEN device_class IN ('storage', 'network', 'smartphone') THEN
              CASE WHEN lower(vendor_id) IN ('046d', '045e', '04f2', '0461', '04b3', '413c', '05ac', '0b05') THEN 'LOW' ELSE 'HIGH' END
            WHEN device_class = 'audio' THEN 'MEDIUM' WHEN device_class = 'hid' THEN 'LOW' ELSE 'INFO' END AS risk_level
FROM c
""")(lambda t: DV.classify_devices(t.device_events.select("device_id", "name", "vendor_id").distinct())
     .select("device_id", "device_class", "risk_level"))
