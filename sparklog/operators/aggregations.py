"""Dashboard, statistics and report aggregates.

Every function takes DataFrames and returns a DataFrame.  Grouped aggregates run
as partial (map-side) + final aggregation, so only one row per group and
partition crosses the shuffle; "top" queries are ``orderBy().limit()`` which Spark
plans as TakeOrderedAndProject (a per-partition top-k, never a global sort).
Counts are BIGINT, floating results are rounded to 6 places.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R

SEVERITY_LEVELS4 = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def _n() -> Column:
    return F.count(F.lit(1)).cast("bigint")


# --------------------------------------------------------------- log statistics
def table_count(df: DataFrame, alias: str = "count") -> DataFrame:
    """A01."""
    return df.agg(_n().alias(alias))


def severity_distribution(logs: DataFrame) -> DataFrame:
    """Logs per non-NULL severity, most frequent first."""
    return (logs.filter(F.col("severity").isNotNull())
            .groupBy("severity").agg(_n().alias("count"))
            .orderBy(F.desc("count"), F.asc("severity")))


def top_sources(logs: DataFrame, limit: int = 10) -> DataFrame:
    """The most frequent sources (ties broken by name)."""
    return (logs.groupBy("source").agg(_n().alias("count"))
            .orderBy(F.desc("count"), F.asc_nulls_last("source")).limit(limit))


def event_type_summary(logs: DataFrame, non_null_top: int | None = None) -> DataFrame:
    """Count per event type; ``non_null_top`` gives the top-k non-NULL variant."""
    df = logs
    if non_null_top is not None:
        df = df.filter(F.col("event_type").isNotNull())
    out = df.groupBy("event_type").agg(_n().alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("event_type"))
    return out.limit(non_null_top) if non_null_top is not None else out


def time_range(logs: DataFrame) -> DataFrame:
    """A05."""
    return logs.agg(F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"))


def logs_by_hour(logs: DataFrame) -> DataFrame:
    """Logs per hour label ``yyyy-MM-dd HH:00``, newest first."""
    return (logs.groupBy(F.date_format("timestamp", "yyyy-MM-dd HH:00").alias("hour"))
            .agg(_n().alias("count")).orderBy(F.desc_nulls_last("hour")))


# ------------------------------------------------------------ anomaly summaries
def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Count and mean score per severity x algorithm."""
    return (anomalies.groupBy("severity", "algorithm")
            .agg(_n().alias("count"), X.round6(F.avg("anomaly_score")).alias("avg_score"))
            .orderBy(F.desc("count"), "severity", "algorithm"))


def severity_zero_filled(anomalies: DataFrame, levels=SEVERITY_LEVELS4) -> DataFrame:
    """Anomaly count of each of the four levels, zeros included (upper-cased severity)."""
    spark = anomalies.sparkSession
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(levels)], "severity string, level_order int")
    counts = anomalies.groupBy(F.upper(F.col("severity")).alias("severity")).agg(_n().alias("count"))
    return (F.broadcast(dim).join(counts, "severity", "left")
            .select("severity", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "level_order")
            .orderBy("level_order").drop("level_order"))


def timeline_24h(anomalies: DataFrame, as_of: _dt.datetime, hours: int = 24, step: int = 2) -> DataFrame:
    """12 two-hour buckets starting at trunc(as_of, hour) - 22h, zero-filled.

    The bucket of a row is computed arithmetically (no range join): rows are first
    filtered to the 24-hour window, then grouped by bucket index.
    """
    spark = anomalies.sparkSession
    now = as_of.replace(minute=0, second=0, microsecond=0)
    start = now - _dt.timedelta(hours=hours - step)
    n_buckets = hours // step
    spine = spark.range(n_buckets).select(
        F.col("id").cast("int").alias("bucket"),
        (X.ntz(start) + F.make_dt_interval(hours=(F.col("id") * step).cast("int"))).alias("bucket_start"))
    secs = (F.unix_timestamp(F.col("detected_at").cast("timestamp")) -
            F.unix_timestamp(X.instant(start)))
    hit = (anomalies.filter(F.col("detected_at").isNotNull() & (F.col("detected_at") >= X.ntz(start)))
           .select(F.floor(secs / (step * 3600)).cast("int").alias("bucket"),
                   (F.upper(F.coalesce("severity", F.lit(""))) == "CRITICAL").alias("crit"))
           .filter(F.col("bucket") < n_buckets)
           .groupBy("bucket").agg(_n().alias("anomalies"), F.count_if("crit").cast("bigint").alias("critical")))
    return (F.broadcast(spine).join(hit, "bucket", "left")
            .select("bucket", F.date_format("bucket_start", "HH:00").alias("time"),
                    F.coalesce("anomalies", F.lit(0)).cast("bigint").alias("anomalies"),
                    F.coalesce("critical", F.lit(0)).cast("bigint").alias("critical"))
            .orderBy("bucket"))


def technique_summary(anomalies: DataFrame, techniques: DataFrame) -> DataFrame:
    """A10 (+J03, G05): per technique name/tactic, detections and severity of the max score."""
    t = techniques.select("technique_id", "technique_name", F.col("tactic").alias("t_tactic"))
    a = anomalies.filter(F.col("mitre_technique_id").isNotNull())
    # counted first: what is joined is a row per technique and tactic
    per = a.groupBy("mitre_technique_id", "mitre_tactic").agg(_n().alias("n"), F.max("anomaly_score").alias("score"))
    j = per.join(t, per["mitre_technique_id"] == t["technique_id"], "left")
    g = (j.groupBy(F.col("mitre_technique_id").alias("id"),
                   F.coalesce("technique_name", "mitre_technique_id").alias("name"),
                   F.coalesce("mitre_tactic", "t_tactic", F.lit("Unknown")).alias("tactic"))
         .agg(F.sum("n").cast("bigint").alias("detections"), F.coalesce(F.max("score"), F.lit(0.0)).alias("max_score")))
    return (g.select("id", "name", "tactic", "detections",
                     X.stored_severity("max_score").alias("severity"))
            .orderBy(F.desc("detections"), "id"))


def technique_totals(summary: DataFrame) -> DataFrame:
    """A10 totals over ``technique_summary``: the sorted tactics and all detections (one row)."""
    return summary.agg(F.array_join(F.array_sort(F.collect_set("tactic")), ",").alias("tactics"),
                       F.coalesce(F.sum("detections"), F.lit(0)).cast("bigint").alias("total_detections"))


def matrix_techniques(matrix: DataFrame) -> DataFrame:
    """A11 nested list of ``attack_matrix`` as rows: tactic, technique, detected, detections."""
    return matrix.select("tactic", F.explode("techniques").alias("t")).select("tactic", "t.*")


def matrix_totals(matrix: DataFrame) -> DataFrame:
    """A11 grand totals (one row)."""
    return matrix.agg(F.coalesce(F.sum("total_techniques"), F.lit(0)).cast("bigint").alias("total_techniques"),
                      F.coalesce(F.sum("detected_techniques"), F.lit(0)).cast("bigint").alias("total_detected"))


def attack_matrix(techniques: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per tactic, total and detected techniques plus the nested technique list."""
    det = (anomalies.filter(F.col("mitre_technique_id").isNotNull())
           .groupBy(F.col("mitre_technique_id").alias("technique_id")).agg(_n().alias("detection_count")))
    j = techniques.join(det, "technique_id", "left")
    return (j.groupBy("tactic")
            .agg(_n().alias("total_techniques"),
                 F.count_if(F.col("detection_count").isNotNull()).cast("bigint").alias("detected_techniques"),
                 F.coalesce(F.sum("detection_count"), F.lit(0)).cast("bigint").alias("detections"),
                 F.array_sort(F.collect_list(F.struct(
                     "technique_name", "technique_id",
                     F.col("detection_count").isNotNull().alias("detected"),
                     F.coalesce("detection_count", F.lit(0)).cast("bigint").alias("detection_count"))))
                 .alias("techniques"))
            .orderBy("tactic"))


def attack_coverage(anomalies: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct techniques and tactics among mapped anomalies."""
    a = anomalies.filter(F.col("mitre_technique_id").isNotNull())
    cd = F.countDistinct if exact else F.approx_count_distinct
    return a.agg(cd("mitre_technique_id").cast("bigint").alias("unique_techniques"),
                 cd("mitre_tactic").cast("bigint").alias("unique_tactics"))


def score_stats(anomalies: DataFrame) -> DataFrame:
    """A14."""
    return anomalies.agg(X.round6(F.coalesce(F.avg("anomaly_score"), F.lit(0.0))).alias("avg_score"),
                         X.round6(F.coalesce(F.max("anomaly_score"), F.lit(0.0))).alias("max_score"),
                         X.round6(F.coalesce(F.min("anomaly_score"), F.lit(0.0))).alias("min_score"))


def algorithm_distribution(anomalies: DataFrame) -> DataFrame:
    """A15."""
    return anomalies.groupBy("algorithm").agg(_n().alias("count")).orderBy(F.desc("count"), "algorithm")


def top_techniques(anomalies: DataFrame, limit: int = 10) -> DataFrame:
    """A16."""
    return (anomalies.filter(F.col("mitre_technique_id").isNotNull())
            .groupBy("mitre_technique_id", "mitre_tactic").agg(_n().alias("count"))
            .orderBy(F.desc("count"), "mitre_technique_id", F.asc_nulls_last("mitre_tactic")).limit(limit))


def top_anomalous_sources(anomalies: DataFrame, logs: DataFrame, limit: int = 5) -> DataFrame:
    """A17 (+J01): sources of the most anomalies."""
    j = anomalies.select("log_id").join(logs.select("id", "source"), F.col("log_id") == F.col("id"))
    return (j.groupBy("source").agg(_n().alias("count"))
            .select(F.coalesce("source", F.lit("unknown")).alias("source"), "count")
            .orderBy(F.desc("count"), "source").limit(limit))


def tactic_distribution(anomalies: DataFrame) -> DataFrame:
    """Anomaly count per non-NULL tactic."""
    return (anomalies.filter(F.col("mitre_tactic").isNotNull())
            .groupBy("mitre_tactic").agg(_n().alias("count")).orderBy(F.desc("count"), "mitre_tactic"))


def severity_counts(anomalies: DataFrame) -> DataFrame:
    """Anomaly count per severity."""
    return anomalies.groupBy("severity").agg(_n().alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("severity"))


def share_of_total(counts: DataFrame, count_col: str = "count") -> DataFrame:
    """Percentage of each row in the total, count / max(total, 1) * 100.

    ``counts`` is an already aggregated (small) result; the total is a one-row
    aggregate cross-joined back, not an un-partitioned window.
    """
    total = counts.agg(F.coalesce(F.sum(count_col), F.lit(0)).alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
            .withColumn("percent", X.round6(F.col(count_col) / F.greatest(F.col("_total"), F.lit(1)) * 100.0))
            .drop("_total"))


def report_header(logs: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Total logs, total anomalies, anomaly rate in percent."""
    nl = logs.agg(_n().alias("total_logs"))
    na = anomalies.agg(_n().alias("total_anomalies"))
    return (nl.crossJoin(na)
            .withColumn("anomaly_rate", X.round6(F.when(F.col("total_logs") == 0, F.lit(0.0))
                                                 .otherwise(F.col("total_anomalies") / F.col("total_logs") * 100.0))))


def report_periods(sessions: DataFrame) -> DataFrame:
    """A21 analysis period of every session: 'start to end', or 'start to Present'."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return sessions.select("session_id", F.concat(text("start_time"), F.lit(" to "), F.coalesce(text("end_time"), F.lit("Present")))
                           .alias("analysis_period"))


def risk_index(anomalies: DataFrame) -> DataFrame:
    """Weighted severity index 0-100 (half-even rounding) and its label."""
    weight = X.lookup(R.RISK_INDEX_WEIGHTS, F.col("severity"), 0)
    agg = anomalies.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("weighted"),
                        _n().alias("n"))
    idx = F.bround(F.col("weighted") / F.greatest(F.col("n") * 10, F.lit(1)) * 100.0, 0).cast("bigint")
    out = agg.withColumn("risk_index", idx)
    return out.withColumn("risk_level", X.scale("risk_index", R.RISK_INDEX_LEVELS, R.RISK_INDEX_ELSE))


def recommendations(anomalies: DataFrame, logs: DataFrame) -> DataFrame:
    """Up to five recommendation lines built from counts, top source and top technique."""
    sev = anomalies.agg(F.count_if(F.col("severity") == "CRITICAL").alias("crit"),
                        F.count_if(F.col("severity") == "HIGH").alias("high"))
    src = top_anomalous_sources(anomalies, logs, 1).select(F.col("source").alias("top_source"),
                                                          F.col("count").alias("top_source_count"))
    tech = top_techniques(anomalies, 1).select(F.col("mitre_technique_id").alias("top_tech"),
                                               F.col("mitre_tactic").alias("top_tactic"))
    # one-row frames: a left join on TRUE keeps the counts row when a top list is empty
    one = sev.join(src, F.lit(True), "left").join(tech, F.lit(True), "left")
    recs = F.array_compact(F.array(
        F.when(F.col("crit") > 0, F.format_string(
            "Prioritize triage of %d CRITICAL anomaly/anomalies within 24 hours and isolate affected endpoints immediately.",
            F.col("crit"))),
        F.when(F.col("high") > 0, F.format_string(
            "Investigate %d HIGH-severity finding(s) and validate whether they indicate active lateral movement or privilege misuse.",
            F.col("high"))),
        F.when(F.col("top_source").isNotNull(), F.format_string(
            "Increase logging and detection coverage for top source '%s' which produced %d anomaly/anomalies.",
            F.col("top_source"), F.col("top_source_count"))),
        F.when(F.col("top_tech").isNotNull(), F.format_string(
            "Map incident-response playbooks to MITRE %s (%s) and run targeted containment drills for this pattern.",
            F.coalesce("top_tech", F.lit("N/A")),
            F.regexp_replace(F.coalesce("top_tactic", F.lit("unknown")), "_", " "))),
        F.lit("Schedule rule/model tuning to reduce false positives while preserving coverage on HIGH and CRITICAL detections."),
    ))
    return one.select(F.posexplode(F.slice(recs, 1, 5)).alias("pos", "recommendation")) \
        .select((F.col("pos") + 1).cast("bigint").alias("rank"), "recommendation")


def dataset_severity(logs: DataFrame) -> DataFrame:
    """upper(coalesce(severity,'LOW')) distribution with the total on every row."""
    g = logs.groupBy(F.upper(F.coalesce("severity", F.lit("LOW"))).alias("severity")).agg(_n().alias("count"))
    total = logs.agg(_n().alias("total"))
    return g.crossJoin(total).orderBy(F.desc("count"), "severity")


def dataset_risk(logs: DataFrame, high_risk: DataFrame) -> DataFrame:
    """Threat score and confidence from the count of all high-risk logs."""
    n = logs.agg(_n().alias("total"))
    hr = high_risk.agg(_n().cast("bigint").alias("high_risk"))
    j = n.crossJoin(hr)
    return j.select(
        "total", "high_risk",
        X.round_to(F.least(F.lit(1.0), F.col("high_risk") * 3.0 / F.greatest(F.col("total"), F.lit(1))), 4).alias("threat_score"),
        X.round6(F.least(F.lit(0.99), F.lit(0.65) + F.col("high_risk") / F.greatest(F.col("total"), F.lit(1)))).alias("confidence"),
        F.when(F.col("high_risk") > 0, F.lit("HIGH")).otherwise(F.lit("LOW")).alias("risk_level"))


def batch_summary(anomalies: DataFrame, logs: DataFrame) -> DataFrame:
    """Totals, anomaly rate, counts by the summary scale."""
    lvl = X.summary_severity("anomaly_score")
    a = anomalies.agg(_n().alias("total_anomalies"),
                      *[F.count_if(lvl == s).cast("bigint").alias(s.lower()) for s in SEVERITY_LEVELS4])
    n = logs.agg(_n().alias("total_logs_analyzed"))
    return (a.crossJoin(n)
            .withColumn("anomaly_rate", X.round6(F.col("total_anomalies") / F.greatest("total_logs_analyzed", F.lit(1)))))


def coverage_by_tactic(anomalies: DataFrame, techniques: DataFrame) -> DataFrame:
    """Per tactic, detections (sum) and covered techniques (detections > 0)."""
    det = (anomalies.filter(F.col("mitre_technique_id").isNotNull())
           .groupBy(F.col("mitre_technique_id").alias("technique_id")).agg(_n().alias("detections")))
    j = techniques.select("technique_id", "tactic").join(det, "technique_id", "left")
    return (j.groupBy("tactic")
            .agg(F.coalesce(F.sum("detections"), F.lit(0)).cast("bigint").alias("detections"),
                 F.count_if(F.col("detections") > 0).cast("bigint").alias("covered_techniques"),
                 _n().alias("total_techniques"))
            .orderBy("tactic"))


def system_overview(logs: DataFrame, anomalies: DataFrame, sessions: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Scalar totals in one row; nodes online by status *equality*."""
    parts = [logs.agg(_n().alias("total_logs")),
             anomalies.agg(_n().alias("total_anomalies")),
             sessions.agg(_n().alias("total_sessions"),
                          F.max_by("session_id", F.struct("start_time", "session_id")).alias("last_session"))]
    if nodes is not None:
        parts.append(nodes.agg(F.count_if(F.lower("status") == "active").cast("bigint").alias("nodes_online")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def listed_severity(anomalies: DataFrame, limit: int = 100) -> DataFrame:
    """Severity counts of the listed (top ``limit`` by score) anomalies."""
    listed = anomalies.orderBy(F.desc("anomaly_score"), F.asc("id")).limit(limit)
    return listed.groupBy("severity").agg(_n().alias("count")).orderBy(F.desc("count"), "severity")


def top_affected_systems(threats: DataFrame, top: int = 5) -> DataFrame:
    """The systems named by most threats (ties: name order), at most ``top``."""
    return (threats.select(F.explode("affected_systems").alias("system")).groupBy("system").agg(_n().alias("threats"))
            .orderBy(F.desc("threats"), "system").limit(top))


def threat_summary(threats: DataFrame) -> DataFrame:
    """Totals by severity and category, mean confidence, time range (one row)."""
    by_sev = threats.groupBy("severity").agg(_n().alias("n"))
    by_cat = threats.groupBy("category").agg(_n().alias("n"))
    tot = threats.agg(_n().alias("total_threats"),
                      X.round6(F.avg("confidence_score")).alias("average_confidence"),
                      F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    s = by_sev.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("by_severity"))
    c = by_cat.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    return tot.crossJoin(s).crossJoin(c)
