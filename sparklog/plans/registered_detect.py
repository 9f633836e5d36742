"""Registered feature and detection queries (§2.10) with their oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R
from ..operators import detect as D
from ..operators import features as FE
from ..operators import stats as ST
from ..sources.testdata import AS_OF
from . import analysis as AN
from .catalog import query
from .oracle_detect import FEATURE_SQL, KEYWORD_SQL, STAT_CHAIN_SQL, ZSCORE_SQL

_FEATS = ", ".join(f"round({f}, 6) AS {f}" for f in R.FEATURE_NAMES)

query("x01_features", FEATURE_SQL + f"""
SELECT id, {_FEATS} FROM features
""")(lambda t: FE.feature_frame(t.logs).select("id", *[X.round6(f).alias(f) for f in R.FEATURE_NAMES]))

query("d01_zscore", FEATURE_SQL + ZSCORE_SQL + """
SELECT id, round(max_z, 6) AS max_z, round(stat_score, 6) AS stat_score FROM stat
""")(lambda t: _d01(t))


def _d01(t):
    f = FE.feature_frame(t.logs)
    s = D.zscore_score(f, D.zscore_fit(f))
    return s.select("id", X.round6("max_z").alias("max_z"), X.round6("stat_score").alias("stat_score"))


def _iqr_sql() -> str:
    qs = ", ".join(f"quantile_cont({f}, 0.25) AS q1_{f}, quantile_cont({f}, 0.75) AS q3_{f}" for f in R.FEATURE_NAMES)
    bounds = []
    for f in R.FEATURE_NAMES:
        iqr = f"(CASE WHEN q3_{f} - q1_{f} = 0 THEN 1e-10 ELSE q3_{f} - q1_{f} END)"
        bounds.append(f"CASE WHEN f.{f} < q1_{f} - 3.0 * {iqr} OR f.{f} > q3_{f} + 3.0 * {iqr} THEN 1 ELSE 0 END")
    return (FEATURE_SQL + f", iq AS (SELECT {qs} FROM features)\n"
            + ", oc AS (SELECT f.id, (" + " + ".join(bounds) + ") AS n FROM features f CROSS JOIN iq)\n"
            + "SELECT id, CAST(n AS BIGINT) AS outlier_features, round(n / 20.0, 6) AS iqr_score FROM oc\n")


query("d02_iqr", _iqr_sql())(lambda t: _d02(t))


def _d02(t):
    f = FE.feature_frame(t.logs).persist()
    s = D.iqr_score(f, D.iqr_fit(f))
    return s.select("id", "outlier_features", X.round6("iqr_score").alias("iqr_score"))


query("d05_keyword_score", KEYWORD_SQL + """
SELECT id, round(keyword_score, 6) AS keyword_score FROM kw
""")(lambda t: D.keyword_scores(t.logs).select("id", X.round6("keyword_score").alias("keyword_score")))

query("d07_d09_statistical_scores", STAT_CHAIN_SQL + """
SELECT id, round(anomaly_score, 6) AS anomaly_score, prediction FROM scored
""")(lambda t: AN.score_logs(t.logs, "statistical")[0]
     .select("id", X.round6("anomaly_score").alias("anomaly_score"), "prediction"))

query("d09_percentile_threshold", STAT_CHAIN_SQL + """
SELECT round(t, 6) AS threshold, CAST((SELECT count(*) FROM scored WHERE prediction = -1) AS BIGINT) AS flagged FROM thr
""")(lambda t: _d09(t))


def _d09(t):
    scored, info, _ = AN.score_logs(t.logs, "statistical")
    flagged = scored.filter(F.col("prediction") == -1).agg(F.count(F.lit(1)).cast("bigint").alias("flagged"))
    return flagged.select(X.round6(F.lit(info["percentile_threshold"])).alias("threshold"), "flagged")


query("d16_analysis_statistical", STAT_CHAIN_SQL + """
SELECT s.id AS log_id, round(s.anomaly_score, 6) AS anomaly_score,
       CASE WHEN s.anomaly_score >= 0.90 THEN 'CRITICAL' WHEN s.anomaly_score >= 0.75 THEN 'HIGH'
            WHEN s.anomaly_score >= 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       'statistical' AS algorithm, lt.technique_id AS mitre_technique_id, lt.tactic AS mitre_tactic
FROM scored s LEFT JOIN log_technique lt ON lt.id = s.id
WHERE s.prediction = -1 AND s.anomaly_score >= 0.70
""")(lambda t: AN.analyze_logs(t.logs, t.techniques, "statistical", 0.70, as_of=AS_OF, session_id="run")[0]
     .select("log_id", X.round6("anomaly_score").alias("anomaly_score"), "severity", "algorithm",
             "mitre_technique_id", "mitre_tactic"))

query("d13_feature_contributions", FEATURE_SQL + ZSCORE_SQL + """
SELECT f.id, round(abs(f.keyword_risk - z.m_keyword_risk), 6) AS keyword_risk_dev,
       round(abs(f.hour_of_day - z.m_hour_of_day), 6) AS hour_of_day_dev,
       round(abs(f.message_length - z.m_message_length), 6) AS message_length_dev
FROM features f CROSS JOIN zstats z
""")(lambda t: _d13(t))


def _d13(t):
    f = FE.feature_frame(t.logs)
    c = D.feature_contributions(f, D.zscore_fit(f))
    return c.select("id", *[X.round6(F.col("contributions")[n]).alias(f"{n}_dev")
                            for n in ("keyword_risk", "hour_of_day", "message_length")])


query("d14_d15_explanations", FEATURE_SQL + """
, a AS (SELECT f.*, 0.5 + CAST(f.id % 50 AS DOUBLE) / 100.0 AS s FROM features f)
, r AS (
  SELECT id, s,
    list_filter([CASE WHEN after_hours = 1 THEN 'activity at unusual hour (' || lpad(CAST(CAST(hour_of_day AS INT) AS VARCHAR), 2, '0') || ':00)' END,
                 CASE WHEN keyword_risk >= 0.85 THEN 'high-risk keywords detected' WHEN keyword_risk >= 0.60 THEN 'suspicious keywords present' END,
                 CASE WHEN has_failure_signal = 1 THEN 'authentication/access failure' END,
                 CASE WHEN has_privilege_signal = 1 THEN 'privilege escalation activity' END,
                 CASE WHEN severity_level >= 4 THEN 'high severity event' END,
                 CASE WHEN message_length > 300 THEN 'unusually long message' END,
                 CASE WHEN source_risk >= 0.60 THEN 'high-risk source' END], lambda x: x IS NOT NULL) AS ra,
    list_filter([CASE WHEN hour_of_day < 6 OR hour_of_day > 22 THEN 'unusual activity time (' || lpad(CAST(CAST(hour_of_day AS INT) AS VARCHAR), 2, '0') || ':00)' END,
                 CASE WHEN CAST(severity_level AS INT) >= 4 THEN 'critical/high severity event' END,
                 CASE WHEN CAST(message_length AS INT) > 1000 THEN 'extremely long log message'
                      WHEN CAST(message_length AS INT) < 5 THEN 'suspiciously short message' END,
                 CASE WHEN has_process = 0 AND severity_level >= 3 THEN 'high-severity event with no process information' END],
                lambda x: x IS NOT NULL) AS rb
  FROM a)
SELECT id,
  CASE WHEN len(ra) > 0 THEN 'Anomaly (score ' || printf('%.3f', s) || '): ' || array_to_string(ra, '; ')
       ELSE 'Statistical anomaly detected (score ' || printf('%.3f', s) || ')' END AS explanation_a,
  CASE WHEN len(rb) > 0 THEN 'Anomaly (score: ' || printf('%.3f', s) || ') - ' || array_to_string(rb, '; ')
       ELSE 'Statistical anomaly detected (score: ' || printf('%.3f', s) || ')' END AS explanation_b
FROM r
""")(lambda t: FE.feature_frame(t.logs)
     .withColumn("anomaly_score", F.lit(0.5) + (F.col("id") % 50).cast("double") / F.lit(100.0))
     .select("id", D.explanation_a().alias("explanation_a"), D.explanation_b().alias("explanation_b")))

query("d12_exact_sample_sizes", """
SELECT CAST(least(count(*), 2000) AS BIGINT) AS sampled FROM events
""")(lambda t: ST.exact_sample(t.events, 2000, key="event_id").agg(F.count(F.lit(1)).cast("bigint").alias("sampled")))

query("d12_stratified_sample_sizes", """
, c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
, tot AS (SELECT sum(n) AS total FROM c)
, tg AS (SELECT event_type, n, floor(n / total * 1000) AS base, n / total * 1000 - floor(n / total * 1000) AS rem FROM c, tot)
, rk AS (SELECT *, row_number() OVER (ORDER BY rem DESC, event_type) AS r FROM tg)
SELECT event_type, CAST(base + CASE WHEN r <= 1000 - (SELECT sum(base) FROM tg) THEN 1 ELSE 0 END AS BIGINT) AS sampled FROM rk
""")(lambda t: ST.exact_sample(t.events, 1000, key="event_id", label="event_type")
     .groupBy("event_type").agg(F.count(F.lit(1)).cast("bigint").alias("sampled")))

# ---------------------------------------------------------------- no SQL form
query("d03_isolation_forest_scores")(lambda t: AN.score_logs(t.logs, "isolation_forest")[0]
                                     .select("id", "if_score", "anomaly_score", "prediction"))
query("d04_one_class_svm_scores")(lambda t: AN.score_logs(t.logs, "one_class_svm")[0]
                                  .select("id", "svm_score", "anomaly_score", "prediction"))
query("d06_ensemble_scores")(lambda t: AN.score_logs(t.logs, "ensemble")[0]
                             .select("id", "stat_score", "if_score", "svm_score", "keyword_score", "anomaly_score",
                                     "prediction"))
query("d16_analysis_ensemble")(lambda t: AN.analyze_logs(t.logs, t.techniques, "ensemble", 0.70, as_of=AS_OF,
                                                         session_id="run")[0]
                               .select("log_id", "anomaly_score", "severity", "algorithm", "mitre_technique_id",
                                       "mitre_tactic", "explanation"))
