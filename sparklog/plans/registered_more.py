"""More registered queries: report/export rows, device views, catalogue merges, parse statistics."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import aggregations as A
from ..operators import classify as C
from ..operators import devices as DV
from ..operators import filters as FL
from ..operators import hub as H
from ..operators import joins as J
from ..operators import parse as P
from ..operators import windows as WN
from ..sources import sinks as SK
from ..sources import testdata as TD
from ..sources.testdata import AS_OF
from .catalog import query
from .registered import HUB_SQL

query("k04_report_rows", """
SELECT a.id AS "ID", CAST(l."timestamp" AS VARCHAR) AS "Timestamp", coalesce(l.source, '') AS "Source",
       coalesce(l.event_type, '') AS "Event Type", coalesce(a.severity, '') AS "Severity",
       round(a.anomaly_score, 4) AS "Score", coalesce(a.algorithm, '') AS "Algorithm",
       coalesce(a.mitre_technique_id, '') AS "MITRE Technique", coalesce(a.mitre_tactic, '') AS "MITRE Tactic",
       coalesce(l.hostname, '') AS "Hostname", coalesce(l.username, '') AS "Username",
       substr(coalesce(l.message, ''), 1, 200) AS "Message"
FROM anomalies a JOIN logs l ON a.log_id = l.id
""")(lambda t: SK.anomaly_report_rows(J.anomalies_with_logs(t.anomalies, t.logs)))

query("k07_sync_package_rows", """
SELECT a.id, round(a.anomaly_score, 6) AS anomaly_score, a.severity, a.algorithm, a.mitre_technique_id, a.mitre_tactic,
       l."timestamp", l.source, l.event_type, l.message, l.hostname, l.username
FROM anomalies a JOIN logs l ON a.log_id = l.id ORDER BY a.anomaly_score DESC, a.id ASC LIMIT 500
""")(lambda t: H.package_rows(t.anomalies, t.logs, 500).withColumn("anomaly_score", X.round6("anomaly_score")))

query("k07_sync_package_summary", """
SELECT 'node-a' AS source_node, CAST(count(*) AS BIGINT) AS packaged,
       (SELECT CAST(count(*) AS BIGINT) FROM logs) AS total_logs,
       (SELECT CAST(count(*) AS BIGINT) FROM anomalies) AS total_anomalies
FROM (SELECT 1 FROM anomalies LIMIT 500)
""")(lambda t: H.export_package(t.anomalies, t.logs, "node-a", "hub").select(
    "source_node", F.size("anomalies").cast("bigint").alias("packaged"),
    F.col("logs_summary.total_logs").alias("total_logs"), F.col("logs_summary.total_anomalies").alias("total_anomalies")))

_DEV_CLASS_SQL = """
CASE
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
    ELSE 'unknown' END"""
_DEV_RISK_SQL = """
CASE WHEN device_class IN ('storage', 'network', 'smartphone') THEN
       CASE WHEN lower(vendor_id) IN ('046d', '045e', '04f2', '0461', '04b3', '413c', '05ac', '0b05') THEN 'LOW' ELSE 'HIGH' END
     WHEN device_class = 'audio' THEN 'MEDIUM' WHEN device_class = 'hid' THEN 'LOW' ELSE 'INFO' END"""
_DEVICES_SQL = f"""
, dv0 AS (SELECT device_id, name, vendor_id, min(event_time) AS first_seen FROM device_events GROUP BY 1, 2, 3)
, dv1 AS (SELECT *, {_DEV_CLASS_SQL} AS device_class FROM dv0)
, dv AS (SELECT *, {_DEV_RISK_SQL} AS risk_level, first_seen >= TIMESTAMP '2024-01-01 06:00:00' AS is_new FROM dv1)
"""


def _devices(t):
    d = (t.device_events.groupBy("device_id", "name", "vendor_id").agg(F.min("event_time").alias("first_seen")))
    d = DV.classify_devices(d)
    return d.withColumn("is_new", F.col("first_seen") >= X.ntz(_dt.datetime(2024, 1, 1, 6)))


query("a33_device_scan_summary", _DEVICES_SQL + """
SELECT CAST(count(*) AS BIGINT) AS total_devices, CAST(count(*) FILTER (WHERE device_class <> 'lan_node') AS BIGINT) AS usb_count,
       CAST(count(*) FILTER (WHERE device_class = 'lan_node') AS BIGINT) AS lan_count,
       CAST(count(*) FILTER (WHERE is_new) AS BIGINT) AS new_devices,
       CAST(count(*) FILTER (WHERE risk_level IN ('HIGH', 'CRITICAL')) AS BIGINT) AS risky_devices
FROM dv
""")(lambda t: DV.scan_summary(_devices(t)))

query("a33_devices_by_class", _DEVICES_SQL + """
SELECT device_class, CAST(count(*) AS BIGINT) AS count FROM dv GROUP BY 1
""")(lambda t: DV.devices_by_class(_devices(t)))

query("f17_device_alerts", _DEVICES_SQL + """
SELECT device_id, risk_level, is_new FROM dv WHERE risk_level IN ('HIGH', 'CRITICAL') OR is_new
""")(lambda t: FL.device_alerts(_devices(t)).select("device_id", "risk_level", "is_new"))

query("g09_g11_vendor_and_class", """
, p AS (SELECT DISTINCT vendor_id, seq % 16 AS k,
               'USB\\VID_' || upper(vendor_id) || '&PID_' || lpad(CAST(seq % 16 AS VARCHAR), 4, '0') || '\\S' AS pnp
        FROM device_events)
SELECT pnp, lower(regexp_extract(upper(pnp), 'VID_([0-9A-F]{4})', 1)) AS vid,
       lower(regexp_extract(upper(pnp), 'PID_([0-9A-F]{4})', 1)) AS pid,
       CASE lower(regexp_extract(upper(pnp), 'VID_([0-9A-F]{4})', 1))
         WHEN '0781' THEN 'SanDisk' WHEN '046d' THEN 'Logitech' WHEN '0d8c' THEN 'C-Media (USB Audio)'
         WHEN '0bda' THEN 'Realtek (USB Network)' WHEN '18d1' THEN 'Google (Android)' WHEN '05ac' THEN 'Apple'
         WHEN '0951' THEN 'Kingston DataTraveler' END AS vendor,
       CASE lpad(CAST(k AS VARCHAR), 2, '0') WHEN '00' THEN 'unknown' WHEN '01' THEN 'audio' WHEN '02' THEN 'network'
         WHEN '03' THEN 'hid' WHEN '06' THEN 'camera' WHEN '07' THEN 'printer' WHEN '08' THEN 'storage'
         ELSE 'unknown' END AS usb_class
FROM p
""")(lambda t: _g09(t))


def _g09(t):
    p = t.device_events.select(
        "vendor_id", (F.col("seq") % 16).alias("k"),
        F.concat(F.lit("USB\\VID_"), F.upper("vendor_id"), F.lit("&PID_"),
                 F.lpad((F.col("seq") % 16).cast("string"), 4, "0"), F.lit("\\S")).alias("pnp")).distinct()
    vid, pid = DV.ids_from_pnp("pnp")
    return p.select("pnp", vid.alias("vid"), pid.alias("pid"), DV.vendor_name(vid).alias("vendor"),
                    DV.class_by_usb_code(F.lpad(F.col("k").cast("string"), 2, "0")).alias("usb_class"))


_PAIRS_SQL = """
, w AS (
  SELECT device_id, seq, event_time, event,
         max(CASE WHEN event = 'connected' THEN event_time END)
           OVER (PARTITION BY device_id ORDER BY event_time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS connected_at
  FROM device_events)
, dl AS (SELECT device_id, seq, connected_at, CASE WHEN event = 'disconnected' THEN event_time END AS removed_at
         FROM w)
"""


def _device_log(t):
    j = J.latest_connect_asof(t.device_events).select("device_id", "seq", "connected_at", "removed_at")
    conn = t.device_events.filter(F.col("event") == "connected").select(
        "device_id", "seq", F.col("event_time").alias("connected_at"), F.lit(None).cast("timestamp_ntz").alias("removed_at"))
    return j.unionByName(conn)


_DL_SQL = _PAIRS_SQL + """
, dlog AS (SELECT device_id, seq, connected_at, removed_at FROM dl WHERE removed_at IS NOT NULL
           UNION ALL SELECT device_id, seq, event_time, NULL FROM device_events WHERE event = 'connected')
"""

query("l04_device_history", _DL_SQL + """
SELECT device_id, seq, connected_at, removed_at FROM dlog
ORDER BY connected_at DESC NULLS LAST, device_id, seq DESC LIMIT 50
""")(lambda t: DV.device_history(_device_log(t), 50))

query("l05_device_events", _DL_SQL + """
SELECT device_id, seq, connected_at, removed_at FROM dlog
ORDER BY coalesce(removed_at, connected_at) DESC NULLS LAST, device_id, seq DESC LIMIT 50
""")(lambda t: DV.device_events(_device_log(t), 50))

query("w02_rank_spread", """
SELECT event_id, round(0.1 + (row_number() OVER (ORDER BY value, event_id) - 1) * (0.8 / (count(*) OVER () - 1)), 6) AS spread
FROM events
""")(lambda t: WN.rank_spread(t.events.select("event_id", "value"), [F.col("value"), F.col("event_id")])
     .select("event_id", X.round6("spread").alias("spread")))

query("p21_p22_parse_stats", """
, parts AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS p FROM documents)
, raw AS (SELECT doc_id, unnest(p) AS raw FROM parts)
, ln AS (SELECT doc_id, regexp_replace(raw, '^[\\s\\x{1c}-\\x{1f}\\p{Zs}\\x{85}\\x{2028}\\x{2029}]+|[\\s\\x{1c}-\\x{1f}\\p{Zs}\\x{85}\\x{2028}\\x{2029}]+$', '', 'g') AS line FROM raw)
, cls AS (SELECT doc_id,
    NOT (NOT (starts_with(line, '{') AND ends_with(line, '}') AND CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' AND len(json_keys(line)) > 0 ELSE false END)
         AND contains(line, '=')
         AND len(regexp_extract_all(line, '([A-Za-z0-9_.-]+)=("[^"]*?"|''[^'']*?''|\\S+)', 1)) > 0
         AND len(list_filter(list_transform(regexp_extract_all(line, '([A-Za-z0-9_.-]+)=("[^"]*?"|''[^'']*?''|\\S+)', 1),
                                            lambda k: lower(k)),
                             lambda k: k NOT IN ('timestamp', 'time', 'ts', '@timestamp', 'datetime', 'date', 'severity',
                                                 'level', 'log_level', 'priority', 'source', 'service', 'app',
                                                 'application', 'logger'))) = 0) AS ok
  FROM ln WHERE line <> '')
, st AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS file_path, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS parsed,
                CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS errors FROM cls GROUP BY 1)
SELECT CAST(count(*) FILTER (WHERE parsed > 0) AS BIGINT) AS files_ingested, CAST(sum(parsed) AS BIGINT) AS total_entries,
       CAST(count(*) FILTER (WHERE parsed = 0) AS BIGINT) AS failures,
       round(avg(parsed / greatest(parsed + errors, 1)), 6) AS mean_success_rate
FROM st
""")(lambda t: _p21(t))


def _p21(t):
    lines = TD.document_lines(t.raw("documents"))
    parsed = P.parse_plaintext(lines, AS_OF, keep_unparsed=True).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_path"), F.col("parsed").alias("ok"))
    stats = P.parse_stats(parsed)
    roll = P.ingest_rollup(stats)
    return roll.crossJoin(stats.agg(X.round6(F.avg("success_rate")).alias("mean_success_rate")))


query("j14_j15_session_update", f"""
, c AS (SELECT s.session_id, count(a.id) AS n FROM analysis_sessions s LEFT JOIN anomalies a
          ON a.detected_at >= s.start_time AND a.detected_at <= coalesce(s.end_time, TIMESTAMP '2024-01-31 00:00:00')
        GROUP BY 1)
SELECT s.session_id, 'completed' AS status, CAST(c.n AS BIGINT) AS anomalies_detected,
       coalesce(s.end_time, TIMESTAMP '2024-01-31 00:00:00') AS end_time
FROM analysis_sessions s JOIN c USING (session_id)
""")(lambda t: _j14(t))


def _j14(t):
    s = t.sessions.select("session_id", "start_time", "end_time", "status",
                          F.lit(None).cast("bigint").alias("anomalies_detected"))
    counts = J.assign_sessions(t.anomalies, t.sessions, AS_OF).groupBy("session_id") \
        .agg(F.count(F.lit(1)).cast("bigint").alias("anomalies_detected"))
    upd = (t.sessions.select("session_id", F.coalesce("end_time", X.ntz(AS_OF)).alias("end_time"))
           .join(counts, "session_id", "left")
           .select("session_id", F.lit("completed").alias("status"),
                   F.coalesce("anomalies_detected", F.lit(0)).cast("bigint").alias("anomalies_detected"), "end_time"))
    return J.upsert(s, upd, "session_id", ["status", "anomalies_detected", "end_time"]) \
        .select("session_id", "status", "anomalies_detected", "end_time")


query("f20_node_lists", f"""
, {HUB_SQL}
, c AS (SELECT mitre_technique_id, mitre_tactic, string_agg(DISTINCT source_node, ',' ORDER BY source_node) AS nodes
        FROM hub WHERE mitre_technique_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT source_node) >= 2)
SELECT mitre_technique_id, mitre_tactic, CAST(len(list_filter(string_split(nodes, ','), lambda x: x <> '')) AS INTEGER) AS n_nodes,
       list_filter(string_split(nodes, ','), lambda x: x <> '')[1] AS first_node
FROM c
""")(lambda t: H.cross_node_correlations(H.hub_state(t.hub_anomalies))
     .select("mitre_technique_id", "mitre_tactic", F.size(FL.node_list("affected_nodes")).alias("n_nodes"),
             F.try_element_at(FL.node_list("affected_nodes"), F.lit(1)).alias("first_node")))

query("u03_catalogue_merge", """
, l AS (SELECT source AS name, count(*) AS n, 0 AS side FROM logs WHERE "timestamp" < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1)
, r AS (SELECT source AS name, count(*) AS n, 1 AS side FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-10 00:00:00'
          AND source IN ('sshd', 'sudo', 'kernel', 'nginx') GROUP BY 1)
, u AS (SELECT * FROM l UNION ALL SELECT * FROM r)
SELECT name, CAST(n AS BIGINT) AS n, side FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY side DESC) AS rn FROM u) WHERE rn = 1
""")(lambda t: _u03(t))


def _u03(t):
    from ..operators import sets as S
    l = (t.logs.filter(F.col("timestamp") < X.ntz(_dt.datetime(2024, 1, 15))).groupBy(F.col("source").alias("name"))
         .agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    r = (t.logs.filter((F.col("timestamp") >= X.ntz(_dt.datetime(2024, 1, 10)))
                       & F.col("source").isin("sshd", "sudo", "kernel", "nginx"))
         .groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).cast("bigint").alias("n")))
    return S.merge_catalogues(l, r, "name")


query("a39_threat_summary", """
, th AS (SELECT a.anomaly_score, l."timestamp",
                CASE WHEN a.anomaly_score >= 0.95 THEN 'CRITICAL' WHEN a.anomaly_score >= 0.85 THEN 'HIGH'
                     WHEN a.anomaly_score >= 0.70 THEN 'MEDIUM' ELSE 'LOW' END AS severity
         FROM anomalies a JOIN logs l ON a.log_id = l.id)
SELECT CAST(count(*) AS BIGINT) AS total_threats, round(avg(anomaly_score), 6) AS average_confidence,
       min("timestamp") AS first_seen, max("timestamp") AS last_seen,
       CAST(count(*) FILTER (WHERE severity = 'CRITICAL') AS BIGINT) AS n_critical,
       CAST(count(*) FILTER (WHERE severity = 'MEDIUM') AS BIGINT) AS n_medium
FROM th
""")(lambda t: _a39(t))


def _a39(t):
    a = t.anomalies.select(F.col("log_id").alias("_aid"), "anomaly_score")
    th = C.classify_threats(t.logs.join(a, t.logs["id"] == a["_aid"]))
    s = A.threat_summary(th)
    return s.select("total_threats", "average_confidence", "first_seen", "last_seen",
                    F.coalesce(F.try_element_at("by_severity", F.lit("CRITICAL")), F.lit(0)).cast("bigint").alias("n_critical"),
                    F.coalesce(F.try_element_at("by_severity", F.lit("MEDIUM")), F.lit(0)).cast("bigint").alias("n_medium"))


query("a39_top_systems", """
SELECT l.hostname AS system, CAST(count(*) AS BIGINT) AS threats FROM anomalies a JOIN logs l ON a.log_id = l.id
WHERE l.hostname IS NOT NULL AND l.hostname <> '' GROUP BY 1 ORDER BY threats DESC, system LIMIT 5
""")(lambda t: A.top_affected_systems(C.classify_threats(
    t.logs.join(t.anomalies.select(F.col("log_id").alias("_aid"), "anomaly_score"), t.logs["id"] == F.col("_aid")))))


query("l06_recent_sessions", """
, cnt AS (SELECT s.session_id, count(a.id) AS n FROM analysis_sessions s LEFT JOIN anomalies a
            ON a.detected_at >= s.start_time AND a.detected_at <= coalesce(s.end_time, TIMESTAMP '2024-01-31 00:00:00')
          GROUP BY 1)
SELECT s.session_id, s.start_time, CAST(cnt.n AS BIGINT) AS anomalies_found
FROM analysis_sessions s JOIN cnt USING (session_id) ORDER BY s.start_time DESC, s.session_id DESC LIMIT 2
""")(lambda t: _l06(t))


def _l06(t):
    from ..operators import reports as RP
    return RP.recent_sessions(RP.session_listing(t.sessions, t.logs, t.anomalies, AS_OF), 2) \
        .select("session_id", "start_time", "anomalies_found")


query("l07_nodes_by_last_seen", f"""
, {HUB_SQL}
, per AS (SELECT source_node AS node_id, count(*) AS total_anomalies, max(imported_at) AS last_seen FROM hub GROUP BY 1)
SELECT node_id, CAST(total_anomalies AS BIGINT) AS total_anomalies, last_seen FROM per
ORDER BY last_seen DESC NULLS LAST, node_id LIMIT 3
""")(lambda t: _l07(t))


def _l07(t):
    from ..operators import reports as RP
    hub = H.hub_state(t.hub_anomalies)
    nodes = hub.groupBy(F.col("source_node").alias("node_id")).agg(
        F.count(F.lit(1)).cast("bigint").alias("total_anomalies"), F.max("imported_at").alias("last_seen"))
    return RP.nodes_by_last_seen(nodes, 3)
