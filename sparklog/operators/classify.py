"""Threat scoring and classification (G02, G03, G06, G07) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R


def threat_score(df: DataFrame, score: str = "anomaly_score", severity: str = "severity",
                 event_type: str = "event_type", hour: str | None = "hour_of_day") -> DataFrame:
    """score*100 times 1.2 (severe), 1.15 (event type tokens), 1.1 (after hours), capped at 100."""
    sev = F.upper(F.coalesce(F.col(severity), F.lit("")))
    et = F.lower(F.coalesce(F.col(event_type), F.lit("")))
    m = F.lit(1.0)
    m = m * F.when(sev.isin(*R.THREAT_SEVERITY_BOOST_LEVELS), F.lit(R.THREAT_SEVERITY_BOOST)).otherwise(F.lit(1.0))
    m = m * F.when(X.contains_any(et, R.THREAT_EVENT_TOKENS), F.lit(R.THREAT_EVENT_BOOST)).otherwise(F.lit(1.0))
    if hour is not None:
        h = F.col(hour)
        m = m * F.when(h.isNotNull() & ((h < 6) | (h > 22)), F.lit(R.THREAT_AFTER_HOURS_BOOST)).otherwise(F.lit(1.0))
    base = F.col(score) * 100.0
    final = F.least(base * m, F.lit(100.0))
    return (df.withColumn("_final", final)
            .withColumn("threat_score", X.round_to("_final", 2))
            .withColumn("threat_level", X.threat_level(F.col("_final") / 100.0))
            .withColumn("base_score", X.round_to(base, 2))
            .withColumn("multiplier", X.round_to(m, 2))
            .withColumn("confidence", F.col(score))
            .drop("_final"))


def threat_category(event_id: str = "event_id", message: str = "message") -> Column:
    """Category of the Windows event id, else the first keyword group contained in the message."""
    by_id = X.lookup(R.WINDOWS_THREAT_CATEGORIES, F.col(event_id))
    msg = F.lower(F.coalesce(F.col(message), F.lit("")))
    by_kw = None
    for cat, words in R.THREAT_KEYWORD_GROUPS:
        cond = X.contains_any(msg, words)
        by_kw = F.when(cond, F.lit(cat)) if by_kw is None else by_kw.when(cond, F.lit(cat))
    return F.coalesce(by_id, by_kw.otherwise(F.lit("unknown")))


def classify_threats(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """Threat rows (category, severity on the .95/.85/.70 scale, title, description,
    affected systems, indicators) for scored log rows."""
    cat = threat_category()
    title = F.concat(F.initcap(F.regexp_replace(cat, "_", " ")), F.lit(" Detected"))
    indicators = F.array_compact(F.array(
        F.when(X.is_present("username"), F.struct(F.lit("username").alias("indicator_type"), F.col("username").alias("value"),
                                                  F.col(score).alias("confidence"),
                                                  F.lit("User account involved in suspicious activity").alias("description"))),
        F.when(X.is_present("process_name"), F.struct(F.lit("process").alias("indicator_type"), F.col("process_name").alias("value"),
                                                      F.col(score).alias("confidence"),
                                                      F.lit("Process involved in suspicious activity").alias("description"))),
    ))
    return df.select(
        F.col("id").alias("log_id"),
        cat.alias("category"),
        X.summary_severity(score).alias("severity"),
        title.alias("title"),
        F.substring(F.coalesce("message", F.lit("")), 1, R.THREAT_DESCRIPTION_CHARS).alias("description"),
        F.col(score).alias("confidence_score"),
        F.col("timestamp"),
        F.when(X.is_present("hostname"), F.array("hostname")).otherwise(F.array().cast("array<string>")).alias("affected_systems"),
        indicators.alias("indicators"),
    )


def threat_risk_score(severity: str = "severity", confidence: str = "confidence_score",
                      systems: str = "affected_systems") -> Column:
    """weight(severity)*100*confidence*min(1 + .1*systems, 2), capped at 100, rounded to 2."""
    w = X.lookup(R.THREAT_RISK_WEIGHTS, F.col(severity), R.THREAT_RISK_DEFAULT_WEIGHT)
    scope = F.least(F.lit(1.0) + F.size(F.col(systems)) * 0.1, F.lit(2.0))
    return X.round_to(F.least(w * 100.0 * F.col(confidence) * scope, F.lit(100.0)), 2)
