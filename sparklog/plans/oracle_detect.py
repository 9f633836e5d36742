"""DuckDB text of the feature frame and the SQL-expressible scoring chain.

Generated from the fixed-value tables in ``functions.rules`` but written as plain
SQL (CASE, contains, regexp_matches, window-free aggregates) — an independent
formulation of what the DataFrame code computes.
"""

from __future__ import annotations

from ..functions import rules as R


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _present(c: str) -> str:
    return f"({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '')"


def _any(text: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({text}, {_s(t)})" for t in tokens) + ")"


def _case_map(expr: str, pairs, default: str) -> str:
    last = {}
    for k, v in pairs:
        last.pop(k, None)
        last[k] = v
    whens = " ".join(f"WHEN {_s(k)} THEN {_d(float(v))}" for k, v in last.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def _max_weight(text: str, pairs, floor: str) -> str:
    parts = ", ".join(f"CASE WHEN contains({text}, {_s(k)}) THEN {_d(w)} ELSE 0.0 END" for k, w in pairs)
    return f"greatest({floor}, {parts})"


FEATURE_SQL = f"""
, feat_base AS (
  SELECT id, "timestamp" AS ts, severity AS sev,
         CASE WHEN {_present('source')} THEN source ELSE 'unknown' END AS src,
         CASE WHEN {_present('event_type')} THEN event_type ELSE 'unknown' END AS et,
         coalesce(message, '') AS msg, lower(coalesce(message, '')) AS lmsg,
         username, hostname, process_name, process_id, event_id, source, event_type, message, severity
  FROM logs
)
, src_codes AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS code FROM (SELECT DISTINCT src FROM feat_base))
, et_codes AS (SELECT et, row_number() OVER (ORDER BY et) - 1 AS code FROM (SELECT DISTINCT et FROM feat_base))
, features AS (
  SELECT b.id, b.source, b.event_id, b.event_type, b.severity, b.message, b.ts AS "timestamp",
         CAST(coalesce(hour(b.ts), 12) AS DOUBLE) AS hour_of_day,
         CAST(coalesce(isodow(b.ts) - 1, 0) AS DOUBLE) AS day_of_week,
         CASE WHEN coalesce(hour(b.ts), 12) < 6 OR coalesce(hour(b.ts), 12) > 22 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS after_hours,
         {_case_map('b.sev', R.FEATURE_SEVERITY_LEVEL, _d(float(R.FEATURE_SEVERITY_DEFAULT)))} AS severity_level,
         CAST(sc.code AS DOUBLE) AS source_encoded,
         {_case_map('lower(b.src)', R.FEATURE_SOURCE_RISK, _d(R.FEATURE_SOURCE_RISK_DEFAULT))} AS source_risk,
         CAST(ec.code AS DOUBLE) AS event_type_encoded,
         CAST(length(b.msg) AS DOUBLE) AS message_length,
         CAST(least(len(list_filter(string_split_regex(b.msg, '\\s+'), lambda x: x <> '')), 50) AS DOUBLE) AS word_count,
         {_max_weight('b.lmsg', R.FEATURE_RISK_KEYWORDS, '0.0')} AS keyword_risk,
         CASE WHEN {_present('b.event_id')} THEN CAST(CAST(('0x' || substr(md5(b.event_id), 1, 8)) AS BIGINT) % 10000 AS DOUBLE)
              ELSE 0.0::DOUBLE END AS event_id_hash,
         CASE WHEN {_present('b.username')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_username,
         CASE WHEN {_present('b.hostname')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_hostname,
         CASE WHEN {_present('b.process_name')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_process,
         CASE WHEN coalesce(b.process_id, 0) <> 0 THEN CAST(((b.process_id % 1000) + 1000) % 1000 AS DOUBLE)
              ELSE 0.0::DOUBLE END AS process_id_norm,
         CASE WHEN {_any('b.lmsg', R.FAILURE_TOKENS)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_failure_signal,
         CASE WHEN {_any('b.lmsg', R.PRIVILEGE_TOKENS)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_privilege_signal,
         CASE WHEN {_any('b.lmsg', R.AUTH_TOKENS)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_auth_signal,
         CASE WHEN regexp_matches(b.msg, {_s(R.IP_PATTERN)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_ip_address,
         CASE WHEN regexp_matches(b.lmsg, {_s(R.PORT_PATTERN)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_port_number
  FROM feat_base b JOIN src_codes sc ON sc.src = b.src JOIN et_codes ec ON ec.et = b.et
)
"""

_F = R.FEATURE_NAMES

ZSCORE_SQL = (
    ", zstats AS (SELECT " + ", ".join(
        f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1e-10 ELSE stddev_pop({f}) END AS s_{f}" for f in _F)
    + " FROM features)\n"
    ", zmax AS (SELECT f.id, greatest(" + ", ".join(f"abs((f.{f} - z.m_{f}) / z.s_{f})" for f in _F)
    + ") AS max_z FROM features f CROSS JOIN zstats z)\n"
    ", zmm AS (SELECT min(max_z) AS mn, max(max_z) AS mx FROM zmax)\n"
    ", stat AS (SELECT id, max_z, CASE WHEN mx - mn = 0 THEN 0.0 ELSE (max_z - mn) / (mx - mn) END AS stat_score"
    " FROM zmax CROSS JOIN zmm)\n")


def _keyword_sql() -> str:
    base = _case_map("upper(coalesce(severity, 'INFO'))", R.KEYWORD_SEVERITY_BASE, _d(R.KEYWORD_SEVERITY_DEFAULT))
    msg = "lower(coalesce(message, ''))"
    ctes = [f", kw0 AS (SELECT id, lower(coalesce(source, '')) AS lsrc, "
            f"{_max_weight(msg, R.SUSPICIOUS_KEYWORDS, base)} AS s FROM logs)"]
    for i, (src, w) in enumerate(R.SOURCE_SEVERITY_RULES, start=1):
        ctes.append(f", kw{i} AS (SELECT id, lsrc, CASE WHEN contains(lsrc, {_s(src)}) "
                    f"THEN greatest(s, {_d(w)}) * {_d(R.SOURCE_RULE_DAMPING)} ELSE s END AS s FROM kw{i - 1})")
    last = len(R.SOURCE_SEVERITY_RULES)
    ctes.append(f", kw AS (SELECT id, least(greatest(s, 0.0), 1.0) AS keyword_score FROM kw{last})")
    return "\n".join(ctes) + "\n"


KEYWORD_SQL = _keyword_sql()

STAT_CHAIN_SQL = FEATURE_SQL + ZSCORE_SQL + KEYWORD_SQL + f"""
, blended AS (SELECT s.id, {_d(R.SINGLE_MODEL_WEIGHT)} * s.stat_score + {_d(R.SINGLE_KEYWORD_WEIGHT)} * k.keyword_score AS combined
              FROM stat s JOIN kw k ON k.id = s.id)
, bmm AS (SELECT min(combined) AS mn, max(combined) AS mx FROM blended)
, final AS (SELECT b.id, {_d(R.REDISTRIBUTE_FLOOR)} + {_d(R.REDISTRIBUTE_SPAN)} * (1.0 / (1.0 + exp({_d(-R.REDISTRIBUTE_STEEPNESS)} * ((b.combined - m.mn) / (m.mx - m.mn) - 0.5)))) AS anomaly_score
            FROM blended b CROSS JOIN bmm m)
, thr AS (SELECT quantile_cont(anomaly_score, {R.PREDICTION_PERCENTILE!r}) AS t FROM final)
, scored AS (SELECT f.id, f.anomaly_score, CASE WHEN f.anomaly_score >= thr.t THEN -1 ELSE 1 END AS prediction
             FROM final f CROSS JOIN thr)
"""
