"""Session and node listings (A35, L06-L08) built from sessions, logs and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from . import joins as J

PARAMS = "algorithm string, threshold double, log_source string"


def session_listing(sessions: DataFrame, logs: DataFrame, anomalies: DataFrame, as_of) -> DataFrame:
    """Sessions with duration (round 2), algorithm/threshold from the JSON parameters
    (defaults statistical / 0.7), upper status, logs and anomalies inside the session
    window, and the source label (explicit source, 'all', else the dominant anomaly source)."""
    p = F.from_json("parameters", PARAMS)
    base = sessions.select("session_id", "start_time", "end_time", "status", p.alias("_p"))
    n_anom = J.assign_sessions(anomalies.select("id", "detected_at"), sessions, as_of) \
        .groupBy("session_id").agg(F.count(F.lit(1)).cast("bigint").alias("anomalies_found"))
    n_logs = J.assign_sessions(logs.select("id", "timestamp"), sessions, as_of, ts_col="timestamp") \
        .groupBy("session_id").agg(F.count(F.lit(1)).cast("bigint").alias("total_logs"))
    dom = J.dominant_source(anomalies, logs, sessions, as_of).select("session_id", "dominant_source")
    j = base.join(n_anom, "session_id", "left").join(n_logs, "session_id", "left").join(dom, "session_id", "left")
    dur = F.when(F.col("end_time").isNull(), F.lit(0.0)).otherwise(
        (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6)
    src = F.lower(F.coalesce(F.col("_p.log_source"), F.lit("")))
    label = (F.when(~src.isin("", "all", "latest"), F.col("_p.log_source"))
             .when(src == "all", F.lit("all"))
             .otherwise(F.coalesce("dominant_source", F.lit("unknown"))))
    return j.select("session_id", "start_time", F.upper(F.coalesce("status", F.lit("completed"))).alias("status"),
                    X.round_to(dur, 2).alias("duration_seconds"),
                    F.coalesce(F.col("_p.algorithm"), F.lit("statistical")).alias("algorithm"),
                    F.coalesce(F.col("_p.threshold"), F.lit(0.7)).alias("threshold"),
                    F.coalesce("total_logs", F.lit(0)).cast("bigint").alias("total_logs"),
                    F.coalesce("anomalies_found", F.lit(0)).cast("bigint").alias("anomalies_found"),
                    label.alias("source_filename"))


def recent_sessions(listing: DataFrame, limit: int = 20) -> DataFrame:
    """Newest sessions first (the first row is the 'last session')."""
    return listing.orderBy(F.desc("start_time"), F.desc("session_id")).limit(limit)


def nodes_by_last_seen(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Node registry newest activity first."""
    out = nodes.orderBy(F.desc_nulls_last("last_seen"), "node_id")
    return out.limit(limit) if limit else out


def related_session(sessions: DataFrame, source_name: str, window: int = 50) -> DataFrame:
    """Among the newest ``window`` completed sessions, the latest one whose log
    source equals ``source_name``, else the latest completed one (one row at most)."""
    p = F.from_json("parameters", PARAMS)
    done = sessions.filter(F.lower("status") == "completed").orderBy(F.desc("start_time")).limit(window)
    match = (F.lower(F.coalesce(p["log_source"], F.lit(""))) == source_name.lower()).cast("int")
    return done.withColumn("_m", match).orderBy(F.desc("_m"), F.desc("start_time")).limit(1).drop("_m")


def recent_logs_search(logs: DataFrame, anomalies: DataFrame, q: str | None = None, limit: int = 50) -> DataFrame:
    """Newest logs (id breaks ties), optionally searched (F04), with anomaly severity."""
    from .filters import search_logs
    base = search_logs(logs, q) if q else logs
    return J.logs_with_anomalies(base, anomalies).orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def top_anomalies(anomalies_with_logs: DataFrame, limit: int = 15) -> DataFrame:
    """Highest-scoring anomalies (15 / 20 / 50 / 100 in the reports), id breaks ties."""
    return anomalies_with_logs.orderBy(F.desc("anomaly_score"), F.asc("id")).limit(limit)


def score_timeline(anomalies: DataFrame) -> DataFrame:
    """(detected_at, score, severity) ascending; no timeline when fewer than two points."""
    n = anomalies.agg(F.count(F.lit(1)).alias("_n"))
    return (anomalies.join(F.broadcast(n), F.lit(True)).filter(F.col("_n") >= 2).drop("_n")
            .orderBy("detected_at", "id"))


def recent_critical(anomalies: DataFrame, limit: int = 10) -> DataFrame:
    """Newest CRITICAL anomalies."""
    return anomalies.filter(F.col("severity") == "CRITICAL").orderBy(F.desc("detected_at"), F.desc("id")).limit(limit)
