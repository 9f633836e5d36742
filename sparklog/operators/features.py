"""The 20-feature frame (X01-X10) and ordinal encoding.

One ``select`` of built-in expressions over ``logs`` — no UDF, so the whole frame is
generated code.  ``lower(message)`` is computed once in a preceding projection
and reused by the 25-keyword ``greatest`` and the token tests.

The two encoded columns need the sorted distinct set of sources / event types: the
distinct set is a grouped aggregate (partial + final), ranked, and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R
from . import stats


def ordinal_encoding(values: DataFrame, value_col: str, code_col: str = "code") -> DataFrame:
    """(value, 0-based index of value in the sorted distinct set), numbered range by range."""
    d = values.select(F.col(value_col).alias("value")).distinct()
    return stats.row_positions(d, [F.col("value")], code_col).select("value", code_col)


def _unknown_if_blank(c: str) -> Column:
    return F.when(X.is_present(c), F.col(c)).otherwise(F.lit("unknown"))


def event_id_hash(c: str | Column) -> Column:
    """Stable replacement of Python's salted ``hash(str(event_id)) % 10000``.

    First 32 bits of md5 as an unsigned integer, mod 10000; 0 when the id is blank.
    (Any stable hash would do; md5 is chosen because DuckDB computes it too.)
    """
    c = X.col(c)
    h = F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.when(X.is_present(c), F.pmod(h, F.lit(10000))).otherwise(F.lit(0))


def feature_frame(logs: DataFrame, keep=("id",), encoders: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``keep`` columns plus the 20 DOUBLE features in the reference's order.

    ``encoders`` = (source_codes, event_type_codes) from a stored model (D11);
    without them they are built from ``logs`` itself, as the reference does per run.
    """
    return feature_frame_and_encoders(logs, keep, encoders)[0]


def feature_frame_and_encoders(logs: DataFrame, keep=("id",), encoders=None):
    """``feature_frame`` plus the (source, event type) code tables it used."""
    base = logs.select(
        *[F.col(k) for k in keep if k not in ("timestamp", "source", "event_type", "message", "severity")],
        F.col("timestamp").alias("_ts"),
        F.col("severity").alias("_sev"),
        _unknown_if_blank("source").alias("_src"),
        _unknown_if_blank("event_type").alias("_et"),
        F.coalesce(F.col("message"), F.lit("")).alias("_msg"),
        F.lower(F.coalesce(F.col("message"), F.lit(""))).alias("_lmsg"),
        X.is_present("username").cast("double").alias("has_username"),
        X.is_present("hostname").cast("double").alias("has_hostname"),
        X.is_present("process_name").cast("double").alias("has_process"),
        F.when(F.coalesce(F.col("process_id"), F.lit(0)) != 0,
               F.pmod(F.col("process_id"), F.lit(1000))).otherwise(F.lit(0)).cast("double").alias("process_id_norm"),
        event_id_hash("event_id").cast("double").alias("event_id_hash"),
        *[F.col(k) for k in keep if k in ("timestamp", "source", "event_type", "message", "severity")],
    )
    if encoders is None:
        encoders = (ordinal_encoding(base, "_src", "source_encoded"), ordinal_encoding(base, "_et", "event_type_encoded"))
    src_codes, et_codes = encoders
    base = (base.join(src_codes.withColumnRenamed("value", "_src"), "_src", "left")
                .join(et_codes.withColumnRenamed("value", "_et"), "_et", "left"))

    hour = F.coalesce(F.hour("_ts"), F.lit(12)).cast("double")
    lm = F.col("_lmsg")
    feats = {
        "hour_of_day": hour,
        "day_of_week": F.coalesce(F.weekday(F.col("_ts")), F.lit(0)).cast("double"),
        "after_hours": ((hour < 6) | (hour > 22)).cast("double"),
        "severity_level": X.lookup(R.FEATURE_SEVERITY_LEVEL, F.col("_sev"), R.FEATURE_SEVERITY_DEFAULT).cast("double"),
        "source_encoded": F.coalesce(F.col("source_encoded"), F.lit(0)).cast("double"),
        "source_risk": X.lookup(R.FEATURE_SOURCE_RISK, F.lower(F.col("_src")), R.FEATURE_SOURCE_RISK_DEFAULT).cast("double"),
        "event_type_encoded": F.coalesce(F.col("event_type_encoded"), F.lit(0)).cast("double"),
        "message_length": F.length(F.col("_msg")).cast("double"),
        "word_count": F.least(F.size(F.filter(F.split(F.col("_msg"), r"\s+"), lambda w: w != "")),
                              F.lit(50)).cast("double"),
        "keyword_risk": X.max_weight(lm, R.FEATURE_RISK_KEYWORDS, 0.0),
        "event_id_hash": F.col("event_id_hash"),
        "has_username": F.col("has_username"),
        "has_hostname": F.col("has_hostname"),
        "has_process": F.col("has_process"),
        "process_id_norm": F.col("process_id_norm"),
        "has_failure_signal": X.contains_any(lm, R.FAILURE_TOKENS).cast("double"),
        "has_privilege_signal": X.contains_any(lm, R.PRIVILEGE_TOKENS).cast("double"),
        "has_auth_signal": X.contains_any(lm, R.AUTH_TOKENS).cast("double"),
        "has_ip_address": F.col("_msg").rlike(R.IP_PATTERN).cast("double"),
        "has_port_number": lm.rlike(R.PORT_PATTERN).cast("double"),
    }
    kept = [k for k in keep]
    frame = base.select(*[F.col(k) for k in kept], *[feats[n].alias(n) for n in R.FEATURE_NAMES])
    return frame, (src_codes, et_codes)
