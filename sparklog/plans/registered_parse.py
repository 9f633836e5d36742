"""Registered parser queries (§2.1-2.2).

Lines are rendered from ``logs`` (syslog, JSON, key=value) or taken from every
line of every document; the Spark side parses them with the parser expressions,
the DuckDB side states the fields the reference's rules must produce.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import parse as P
from ..sources import testdata as TD
from ..sources.testdata import AS_OF
from .catalog import query


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _infer_sql(m: str) -> str:
    parts = []
    for level, tokens in R.INFERRED_SEVERITY:
        cond = " OR ".join(f"contains(lower(coalesce({m}, '')), '{t}')" for t in tokens)
        parts.append(f"WHEN {cond} THEN '{level}'")
    return "CASE " + " ".join(parts) + f" ELSE '{R.INFERRED_SEVERITY_ELSE}' END"


query("p04_syslog_parse", """
, sl AS (SELECT *, id % 3 AS k,
                coalesce(CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'ERROR' THEN 3 WHEN 'MEDIUM' THEN 4
                                       WHEN 'WARNING' THEN 4 WHEN 'LOW' THEN 5 WHEN 'INFO' THEN 6 END, 7) AS code FROM logs)
SELECT id, date_trunc('second', "timestamp") AS "timestamp", source,
       CASE WHEN k = 0 THEN event_id END AS event_id,
       CASE WHEN k = 2 THEN 'INFO' WHEN code <= 2 THEN 'CRITICAL' WHEN code = 3 THEN 'HIGH' WHEN code = 4 THEN 'MEDIUM'
            ELSE 'INFO' END AS severity,
       message,
       CASE WHEN k = 0 THEN hostname ELSE coalesce(hostname, 'localhost') END AS hostname,
       CASE WHEN k = 0 THEN NULL ELSE source END AS process_name,
       process_id,
       CASE k WHEN 0 THEN 'rfc5424' WHEN 1 THEN 'rfc3164' ELSE 'simple' END AS fmt,
       CASE WHEN k = 2 THEN NULL ELSE CAST(id % 24 AS INTEGER) END AS facility
FROM sl
""")(lambda t: P.parse_syslog(TD.render_syslog_lines(t.logs), AS_OF)
     .select("id", _ntz("timestamp"), "source", "event_id", "severity", "message", "hostname", "process_name",
             "process_id", "fmt", "facility"))

query("s04_p11_json_parse", f"""
SELECT id, epoch_ms(CAST(epoch_us("timestamp") // 1000 AS BIGINT)) AS "timestamp", source, 'json' AS event_type,
       CASE WHEN severity IS NOT NULL AND trim(severity) <> '' THEN upper(trim(severity)) ELSE {_infer_sql('message')} END AS severity,
       message, hostname, username, 'json' AS fmt
FROM logs
""")(lambda t: P.parse_plaintext(TD.render_json_lines(t.logs).withColumn("source_name", F.lit("json-feed")), AS_OF)
     .select("id", _ntz("timestamp"), "source", "event_type", "severity", "message", "hostname", "username", "fmt"))

query("s05_kv_parse", f"""
SELECT id, date_trunc('second', "timestamp") AS "timestamp", source, 'kv' AS event_type,
       CASE WHEN severity IS NOT NULL THEN upper(severity) ELSE {_infer_sql('message')} END AS severity,
       message, hostname, username, 'kv' AS fmt
FROM logs
""")(lambda t: P.parse_plaintext(TD.render_kv_lines(t.logs).withColumn("source_name", F.lit("kv-feed")), AS_OF)
     .select("id", _ntz("timestamp"), "source", "event_type", "severity", "message", "hostname", "username", "fmt"))

_WS = r"[\s\x{1c}-\x{1f}\p{Zs}\x{85}\x{2028}\x{2029}]"
_SKIP = ", ".join(f"'{k}'" for k in R.TS_KEYS + R.SEV_KEYS + R.SRC_KEYS)

query("p15_text_line_parse", f"""
, parts AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS p FROM documents)
, raw AS (SELECT doc_id, unnest(p) AS raw, unnest(range(1, len(p) + 1)) AS line_number FROM parts)
, ln AS (SELECT doc_id, CAST(line_number AS BIGINT) AS line_number,
                regexp_replace(raw, '^{_WS}+|{_WS}+$', '', 'g') AS line FROM raw)
, cls AS (
  SELECT *,
    CASE WHEN starts_with(line, '{{') AND ends_with(line, '}}') AND CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' AND len(json_keys(line)) > 0 ELSE false END THEN 'json'
         WHEN contains(line, '=') AND len(regexp_extract_all(line, '([A-Za-z0-9_.-]+)=("[^"]*?"|''[^'']*?''|\\S+)', 1)) > 0 THEN 'kv'
         ELSE 'plaintext' END AS fmt,
    list_filter(list_transform(regexp_extract_all(line, '([A-Za-z0-9_.-]+)=("[^"]*?"|''[^'']*?''|\\S+)', 1), lambda k: lower(k)),
                lambda k: k NOT IN ({_SKIP})) AS other_keys
  FROM ln WHERE line <> '')
, msg AS (
  SELECT *, CASE WHEN regexp_matches(line, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}[T ][0-9:.+-Z]+)\\s+(.*)$')
                 THEN coalesce(nullif(regexp_replace(regexp_extract(line, '^(\\d{{4}}-\\d{{2}}-\\d{{2}}[T ][0-9:.+-Z]+)\\s+(.*)$', 2),
                                                     '^{_WS}+|{_WS}+$', '', 'g'), ''), line)
                 ELSE line END AS text_msg
  FROM cls WHERE fmt = 'plaintext' OR (fmt = 'kv' AND len(other_keys) > 0) OR fmt = 'json')
SELECT doc_id, line_number, fmt,
       CASE WHEN fmt = 'plaintext' THEN {_infer_sql('text_msg')} END AS text_severity,
       CASE WHEN fmt = 'plaintext' THEN substr(text_msg, 1, 4000) END AS text_message
FROM msg
""")(lambda t: P.parse_plaintext(TD.document_lines(t.raw("documents")), AS_OF)
     .select("doc_id", "line_number", "fmt",
             F.when(F.col("fmt") == "plaintext", F.col("severity")).alias("text_severity"),
             F.when(F.col("fmt") == "plaintext", F.col("message")).alias("text_message")))


query("p16_p18_windows_event_parse", """
SELECT id, coalesce(event_id, 'Unknown') AS event_id,
       coalesce(CASE event_id WHEN '4624' THEN 'Account Logon' WHEN '4625' THEN 'Failed Logon'
                 WHEN '4634' THEN 'Account Logoff' WHEN '4672' THEN 'Special Privileges Assigned'
                 WHEN '4720' THEN 'User Account Created' WHEN '4732' THEN 'Member Added to Security Group'
                 WHEN '4688' THEN 'Process Created' WHEN '5140' THEN 'Network Share Accessed'
                 WHEN '7045' THEN 'Service Installed' END, 'Event-' || coalesce(event_id, 'Unknown')) AS event_type,
       CASE severity WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'HIGH' THEN 'HIGH' WHEN 'ERROR' THEN 'HIGH'
            WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'WARNING' THEN 'MEDIUM' ELSE 'INFO' END AS severity,
       source, hostname, coalesce(username, 'svc') AS username, process_name, process_id, message,
       date_trunc('second', "timestamp") AS "timestamp"
FROM logs
""")(lambda t: _p16(t))


def _p16(t):
    from ..sources.logfiles import EVENT_XML_SCHEMA
    x = TD.render_event_xml(t.logs)
    ev = x.select("id", F.from_xml("xml", EVENT_XML_SCHEMA, {"valueTag": "_VALUE"}).alias("e"))
    f = ev.select("id", P.windows_event_fields(F.col("e"), AS_OF).alias("w")).select("id", "w.*")
    return f.select("id", "event_id", "event_type", "severity", "source", "hostname", "username", "process_name",
                    "process_id", "message", _ntz("timestamp"))
