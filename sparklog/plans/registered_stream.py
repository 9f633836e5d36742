"""Registered streaming queries (§2.12).

Every query here starts a stream: it reads the driver's ``events`` table as a file
stream (``availableNow``), runs the live operators into parquet in the shared
folder, and returns that table; its oracle is the SQL of the equivalent batch
result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R
from ..session import ensure_checkpoint_dir
from ..sources import testdata as TD
from ..sources.testdata import AS_OF
from ..streaming import live as L
from .catalog import query


def _quick_sql(msg: str, hour_expr: str) -> str:
    parts = []
    for value, words in R.QUICK_TIERS:
        cond = " OR ".join(f"contains(lower(coalesce({msg}, '')), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN {max(value, R.QUICK_BASE)!r}::DOUBLE")
    base = "CASE " + " ".join(parts) + f" ELSE {R.QUICK_BASE!r}::DOUBLE END"
    bonus = f"CASE WHEN {hour_expr} < 6 OR {hour_expr} > 22 THEN {R.QUICK_AFTER_HOURS_BONUS!r}::DOUBLE ELSE 0.0::DOUBLE END"
    return f"least({base} + {bonus}, 1.0::DOUBLE)"


_Q = _quick_sql("message", "0")  # AS_OF is midnight: processing hour 0
_SEV = ("CASE WHEN s >= 0.90 THEN 'CRITICAL' WHEN s >= 0.72 THEN 'HIGH' WHEN s >= 0.55 THEN 'MEDIUM' "
        "WHEN s >= 0.35 THEN 'LOW' ELSE 'INFO' END")


def _events_stream(t):
    spark = t.spark
    schema = spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    return L.table_stream(spark, t.sf_dir, "events.parquet", schema)


def _scratch(t, tag: str) -> tuple[str, str]:
    """(result folder, streaming checkpoint) in the shared folder."""
    base = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/stream-{tag}-{uuid.uuid4().hex[:10]}"
    return f"{base}/out", f"{base}/ck"


def _scored(t):
    logs = TD.derive_logs(_events_stream(t))
    return L.score_lines(TD.render_syslog_lines(logs).withColumn("source_file", F.lit("syslog")), AS_OF)


query("t01_t03_stream_scoring", f"""
, sc AS (SELECT id, source, CASE WHEN id % 3 = 0 THEN coalesce(hostname, '-') ELSE coalesce(hostname, 'localhost') END AS hostname,
                {_Q} AS s FROM logs)
SELECT id, source, hostname, round(s, 6) AS anomaly_score, {_SEV} AS severity,
       CASE WHEN s >= 0.70 THEN 'anomaly' ELSE 'new_log' END AS event
FROM sc
""")(lambda t: L.run_to_completion(
    _scored(t).select("id", "source", "hostname", X.round6("anomaly_score").alias("anomaly_score"), "severity", "event"),
    *_scratch(t, "t01")))

query("t04_stream_counters", f"""
, sc AS (SELECT {_Q} AS s FROM logs)
SELECT CAST(count(*) AS BIGINT) AS lines_processed, CAST(count(*) FILTER (WHERE s >= 0.70) AS BIGINT) AS anomalies_found FROM sc
""")(lambda t: _t04(t))


def _t04(t):
    counted = L.running_counters(_scored(t)).withColumn("k", F.lit(1))
    return L.run_updates(counted, ["k"], *_scratch(t, "t04")) \
        .select(F.col("lines_processed").cast("bigint"), F.col("anomalies_found").cast("bigint"))


query("t05_stream_subscriber_filter", f"""
, sc AS (SELECT id, {_Q} AS s FROM logs)
SELECT id, {_SEV} AS severity FROM sc
WHERE CASE {_SEV} WHEN 'INFO' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END >= 3
  AND s >= 0.8
""")(lambda t: L.run_to_completion(L.subscriber_filter(_scored(t), "HIGH", 0.8).select("id", "severity"), *_scratch(t, "t05")))

query("t07_stream_device_pairing", """
, w AS (
  SELECT device_id, seq, event_time, event,
         max(CASE WHEN event = 'connected' THEN event_time END)
           OVER (PARTITION BY device_id ORDER BY event_time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS connected_at
  FROM device_events)
SELECT device_id, seq, connected_at, event_time AS removed_at,
       round((epoch_us(event_time) - epoch_us(connected_at)) / 1e6, 2) AS duration_seconds
FROM w WHERE event = 'disconnected'
""")(lambda t: _t07(t))


def _t07(t):
    out, ck = _scratch(t, "t07")
    return L.run_pairing(TD.derive_device_log(_events_stream(t)), L.DevicePairing(out), ck)


query("t09_stream_logs_per_hour", """
SELECT strftime("timestamp", '%Y-%m-%d %H:00') AS hour, CAST(count(*) AS BIGINT) AS count FROM logs GROUP BY 1
""")(lambda t: L.run_updates(L.logs_per_hour_stream(TD.derive_logs(_events_stream(t))), ["hour"], *_scratch(t, "t09")))

query("t09_stream_timeline", """
SELECT time_bucket(INTERVAL '2 hours', "timestamp") AS bucket_start, CAST(count(*) AS BIGINT) AS anomalies,
       CAST(count(*) FILTER (WHERE upper(coalesce(severity, '')) = 'CRITICAL') AS BIGINT) AS critical
FROM logs WHERE "timestamp" IS NOT NULL GROUP BY 1
""")(lambda t: L.run_updates(
    L.timeline_stream(TD.derive_logs(_events_stream(t)).withColumnRenamed("timestamp", "detected_at")), ["bucket_start"],
    *_scratch(t, "t09b")))
