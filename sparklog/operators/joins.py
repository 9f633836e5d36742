"""Joins of the reference re-expressed as DataFrame joins.

Sizes: ``logs`` and ``anomalies`` are the big sides (equi-joins on the log id, left
to AQE: sort-merge, or broadcast when a side is small at runtime).  Sessions,
techniques and node registries are dimension tables; they are broadcast only after
their row count is checked against ``BROADCAST_ROWS``; above it the plain join is
used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import expr as X
from . import stats

def anomalies_with_logs(anomalies: DataFrame, logs: DataFrame, log_cols=None) -> DataFrame:
    """Inner equi-join anomalies.log_id = logs.id."""
    log_cols = log_cols or ["timestamp", "source", "event_id", "event_type", "hostname", "username", "message"]
    right = logs.select(F.col("id").alias("_lid"), *[F.col(c).alias(f"log_{c}" if c == "timestamp" else c)
                                                     for c in log_cols])
    return anomalies.join(right, anomalies["log_id"] == right["_lid"]).drop("_lid")


def logs_with_anomalies(logs: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Left join logs -> anomalies; severity coalesce(anomaly, log, 'LOW'), default algorithm."""
    a = anomalies.select(F.col("log_id"), F.col("anomaly_score"),
                         F.col("severity").alias("a_severity"), F.col("algorithm"))
    j = logs.join(a, logs["id"] == a["log_id"], "left")
    return j.select("id", "timestamp", "source", "event_type", "message",
                    F.coalesce("a_severity", "severity", F.lit("LOW")).alias("severity"),
                    "anomaly_score",
                    F.coalesce("algorithm", F.lit("none")).alias("algorithm"))


def session_bounds(sessions: DataFrame, as_of) -> DataFrame:
    """Sessions as closed intervals [start_time, coalesce(end_time, as_of)]."""
    return sessions.select("session_id", "start_time", F.coalesce("end_time", X.ntz(as_of)).alias("end_bound"))


def within_session(df: DataFrame, sessions: DataFrame, session_id: str, as_of,
                   ts_col: str = "detected_at", open_ended: bool = False) -> DataFrame:
    """Rows whose ``ts_col`` falls in the session's interval.

    The session's two bounds are looked up first and compared as literals, so the range
    reaches the scan.  ``open_ended`` is the lower-bound-only variant (later rows leak in,
    as in the reference's results listing).  An unknown session has no rows.
    """
    s = session_bounds(sessions.filter(F.col("session_id") == session_id), as_of).agg(
        F.min("start_time").alias("s"), F.max("end_bound").alias("e")).first()
    if s["s"] is None:
        return df.filter(F.lit(False))
    cond = F.col(ts_col) >= X.ntz(s["s"])
    return df.filter(cond if open_ended else cond & (F.col(ts_col) <= X.ntz(s["e"])))


def assign_sessions(df: DataFrame, sessions: DataFrame, as_of, ts_col: str = "detected_at") -> DataFrame:
    """J06 for all sessions at once: (row, session) pairs with start <= ts <= end.

    The interval join is bucketed by day: sessions are exploded to the days they cover and
    equi-joined on the row's day, then range-filtered, so the work per row is the number
    of sessions touching its day, not the number of sessions.
    """
    b = session_bounds(sessions, as_of)
    days = b.withColumn("_day", F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_bound"))))
    cond = (F.col(ts_col) >= F.col("start_time")) & (F.col(ts_col) <= F.col("end_bound"))
    return (df.withColumn("_day", F.to_date(F.col(ts_col)))
            .join(days, ["_day"], "inner").filter(cond).drop("_day"))


def latest_connect_asof(device_events: DataFrame) -> DataFrame:
    """Each disconnect takes the latest earlier connect of the same device.

    Skew-safe two-level form: a device may hold a third of all rows, so events are
    range-partitioned by (device, time) and the window is per (device, range).

    1. inside each (device, range): ``last(connect_time, ignorenulls)`` over the
       preceding rows;
    2. per (device, range): the range's last connect (a partial/final aggregate,
       combined map-side);
    3. per device, over its ranges only (a small table): the last connect of the
       earlier ranges, carried forward;
    4. connected_at = in-range value, else the carried value.

    Duration = seconds between them, rounded to 2.
    """
    ev = stats.in_ranges(device_events, ["device_id", "event_time", "seq"])
    conn_ts = F.when(F.col("event") == "connected", F.col("event_time"))
    w_in = W.partitionBy("device_id", "_p").orderBy("event_time", "seq").rowsBetween(W.unboundedPreceding, -1)
    ev = ev.withColumn("_in", F.last(conn_ts, ignorenulls=True).over(w_in))
    parts = ev.groupBy("device_id", "_p").agg(F.max(conn_ts).alias("_last"))
    w_dev = W.partitionBy("device_id").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carry = parts.select("device_id", "_p", F.last("_last", ignorenulls=True).over(w_dev).alias("_carry"))
    d = ev.filter(F.col("event") == "disconnected").join(carry, ["device_id", "_p"], "left")
    connected = F.coalesce("_in", "_carry")
    secs = (F.unix_micros(F.col("event_time").cast("timestamp")) -
            F.unix_micros(connected.cast("timestamp"))) / 1e6
    return d.select("device_id", "seq", connected.alias("connected_at"), F.col("event_time").alias("removed_at"),
                    X.round_to(secs, 2).alias("duration_seconds"))


def node_names(per_node: DataFrame, nodes: DataFrame, key: str = "source_node") -> DataFrame:
    """Enrich per-node totals with the node's hostname, fallback first 12 chars of the id."""
    n = nodes.select(F.col("node_id").alias("_nid"), F.col("hostname").alias("_host"))
    j = per_node.join(n, per_node[key] == n["_nid"], "left")
    return j.withColumn("node_name", F.coalesce("_host", F.substring(F.col(key), 1, 12))).drop("_nid", "_host")


def dominant_source(anomalies: DataFrame, logs: DataFrame, sessions: DataFrame, as_of=None) -> DataFrame:
    """Per session the most frequent log source among its anomalies (ties -> smallest name).

    A session without an end is open (the reference's ``? IS NULL OR ...``): its
    bound is the latest anomaly time, which admits every row, so the session join
    can use the bucketed interval join.  The count is keyed by (session, source);
    the top-1 is a window partitioned by session over that small result.
    """
    a = anomalies.select("log_id", "detected_at").join(
        logs.select(F.col("id").alias("_lid"), "source"), F.col("log_id") == F.col("_lid"))
    hi = anomalies.agg(F.max("detected_at")).first()[0]
    if hi is None:
        hi = as_of
    paired = assign_sessions(a, sessions.select("session_id", "start_time", "end_time"), hi)
    counts = paired.groupBy("session_id", "source").agg(F.count(F.lit(1)).alias("cnt"))
    w = W.partitionBy("session_id").orderBy(F.desc("cnt"), F.asc_nulls_last("source"))
    return (counts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select("session_id", F.col("source").alias("dominant_source"), F.col("cnt").cast("bigint").alias("dominant_count")))


def upsert(current: DataFrame, updates: DataFrame, key: str, update_cols: list[str],
           insert_defaults: dict | None = None) -> DataFrame:
    """Rows of ``updates`` replace ``update_cols`` of matching keys; new keys are inserted.

    A full outer join on the key: coalesce(new, old) for updated columns, old value
    for the others.  (On a table format with MERGE this is a MERGE INTO.)
    """
    insert_defaults = insert_defaults or {}
    cols = current.columns
    u = updates.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_u_{c}") for c in updates.columns if c != key])
    j = current.join(u, current[key] == u["_k"], "full_outer")
    out = []
    for c in cols:
        if c == key:
            out.append(F.coalesce(F.col(key), F.col("_k")).alias(key))
        elif c in update_cols and f"_u_{c}" in u.columns:
            out.append(F.when(F.col("_k").isNotNull(), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c))
        elif f"_u_{c}" in u.columns:
            # not updated for existing keys, but inserted for new ones
            out.append(F.when(F.col(key).isNull(), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c))
        elif c in insert_defaults:
            out.append(F.when(F.col(key).isNull(), F.lit(insert_defaults[c])).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def logs_by_technique(logs: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Logs joined with their mapped anomalies."""
    a = anomalies.filter(F.col("mitre_technique_id").isNotNull()).select(
        "log_id", "mitre_technique_id", "mitre_tactic", "anomaly_score")
    return logs.join(a, logs["id"] == a["log_id"]).drop("log_id")
