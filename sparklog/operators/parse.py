"""Log-line parsing as column expressions.

Every parser is an expression over a ``line`` column, so a whole file (or a whole
stream) is parsed inside one projection — whole-stage codegen for the regex and
string work, no Python per line.  A line runs through the cascades with
``coalesce`` of per-format structs; the first format that matches wins.

``as_of`` replaces "now" wherever the reference falls back to the current time.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R

# Java forms of the reference's line patterns (FIXED VALUES: same groups, same order)
RFC5424 = (r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)?\s*(.*)$")
RFC3164 = r"^<(\d+)>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[]+)(?:\[(\d+)\])?:\s*(.*)$"
SIMPLE = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[]+)(?:\[(\d+)\])?:\s*(.*)$"
ISO_LINE = r"^(\d{4}-\d{2}-\d{2}[T ][0-9:.+-Z]+)\s+(.*)$"
KV_PAIR = r"([A-Za-z0-9_.-]+)=(\".*?\"|'.*?'|\S+)"
STREAM_BSD = r"^(?:<\d+>)?(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)"
STREAM_5424 = r"^<(\d+)>1\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+\S+\s+-\s+(.*)"
WS = r"[\s\x{1c}-\x{1f}\p{Zs}\x{85}\x{2028}\x{2029}]"

LOG_FIELDS = ["timestamp", "source", "event_id", "event_type", "severity", "message", "hostname", "username",
              "process_name", "process_id", "raw_data", "fmt"]


def strip(c: str | Column) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace, Unicode spaces included."""
    return F.regexp_replace(X.col(c), f"^{WS}+|{WS}+$", "")


def clean_utf8(c: str | Column) -> Column:
    """Bad bytes dropped (the reader's replacement character removed), as errors='ignore' does."""
    return F.regexp_replace(X.col(c), "�", "")


def _g(pattern: str, idx: int, line: Column) -> Column:
    return F.regexp_extract(line, pattern, idx)


def priority_severity(pri: Column) -> Column:
    """P05 + P06: severity name of priority & 7."""
    return X.lookup([(k, v) for k, v in R.SYSLOG_SEVERITY], F.pmod(pri, F.lit(8)).cast("int"), "INFO")


def facility(pri: Column) -> Column:
    """Priority >> 3."""
    return F.shiftright(pri, 3)


def bsd_time(text: Column, as_of: _dt.datetime) -> Column:
    """P07: 'Mon dd HH:MM:SS' in the year of ``as_of``; unparsable -> as_of."""
    collapsed = F.regexp_replace(text, r"\s+", " ")
    ts = F.try_to_timestamp(F.concat(collapsed, F.lit(f" {as_of.year}")), F.lit("MMM d HH:mm:ss yyyy"))
    return F.coalesce(ts, X.instant(as_of))


def iso_time(text: Column) -> Column:
    """ISO 8601 with optional 'Z' or offset -> instant (NULL when not ISO)."""
    t = F.regexp_replace(strip(text), " ", "T")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))


SEP = "\u0001"


def _groups(line: Column, pattern: str, n: int) -> Column:
    """All ``n`` groups of an anchored pattern from ONE regex pass (NULL when it does not match).

    ``regexp_replace`` with '$1<SEP>$2...' rewrites the whole (anchored) line into its
    groups; a group that did not take part becomes ''.
    """
    repl = SEP.join(f"${i}" for i in range(1, n + 1))
    return F.when(line.rlike(pattern), F.split(F.regexp_replace(line, pattern, repl), SEP, -1))


def _gi(arr: str, i: int) -> Column:
    return F.col(arr).getItem(i - 1)


def parse_syslog(lines: DataFrame, as_of: _dt.datetime, line_col: str = "line") -> DataFrame:
    """RFC 5424, else RFC 3164, else priority-less BSD; lines matching none are dropped.

    Staged projections: the three patterns each run once per line, every field is
    then read from the group arrays.
    """
    line = F.col(line_col)
    keep = [c for c in lines.columns if c != line_col]
    g = (lines.select(*keep, line.alias("_line"))
         .filter(is_syslog_line(F.col("_line")))          # cheap tests on the raw line, before any group work
         .withColumn("_a5", _groups(F.col("_line"), RFC5424, 9))
         .withColumn("_a3", F.when(F.col("_a5").isNull(), _groups(F.col("_line"), RFC3164, 6)))
         .withColumn("_as", F.when(F.col("_a5").isNull() & F.col("_a3").isNull(), _groups(F.col("_line"), SIMPLE, 5))))
    k5, k3 = F.col("_a5").isNotNull(), F.col("_a3").isNotNull()
    na = F.lit(None).cast("string")

    def dash_null(c: Column) -> Column:
        return F.when(c == "-", na).otherwise(c)

    def pid(c: Column) -> Column:
        return F.when((c == "") | (c == "-"), F.lit(None).cast("bigint")).otherwise(c.try_cast("bigint"))

    pri = F.when(k5, _gi("_a5", 1)).when(k3, _gi("_a3", 1)).try_cast("int")
    bsd = F.when(k3, _gi("_a3", 2)).otherwise(_gi("_as", 1))
    tag = F.when(k3, _gi("_a3", 4)).otherwise(_gi("_as", 3))
    out = g.select(
        *keep,
        F.when(k5, F.coalesce(iso_time(_gi("_a5", 3)), X.instant(as_of)))
         .otherwise(bsd_time(bsd, as_of)).alias("timestamp"),
        F.when(k5, F.when(_gi("_a5", 5) == "-", F.lit("syslog")).otherwise(_gi("_a5", 5))).otherwise(tag).alias("source"),
        F.when(k5, dash_null(_gi("_a5", 7))).alias("event_id"),
        F.lit("syslog").alias("event_type"),
        F.when(k5 | k3, priority_severity(pri)).otherwise(F.lit("INFO")).alias("severity"),
        F.when(k5, _gi("_a5", 9)).when(k3, _gi("_a3", 6)).otherwise(_gi("_as", 5)).alias("message"),
        F.when(k5, dash_null(_gi("_a5", 4))).when(k3, _gi("_a3", 3)).otherwise(_gi("_as", 2)).alias("hostname"),
        na.alias("username"),
        F.when(k5, na).otherwise(tag).alias("process_name"),
        F.when(k5, pid(_gi("_a5", 6))).when(k3, pid(_gi("_a3", 5))).otherwise(pid(_gi("_as", 4))).alias("process_id"),
        F.col("_line").alias("raw_data"),
        F.when(k5, F.lit("rfc5424")).when(k3, F.lit("rfc3164")).otherwise(F.lit("simple")).alias("fmt"),
        pri.alias("priority"),
        facility(pri).alias("facility"),
    )
    return out


def is_syslog_line(line: Column) -> Column:
    return line.rlike(RFC5424) | line.rlike(RFC3164) | line.rlike(SIMPLE)


# ------------------------------------------------------------------ plaintext
def infer_severity(message: str | Column) -> Column:
    """Token groups critical/panic/fatal, error/failed/denied/exception, warn; else LOW."""
    m = F.lower(F.coalesce(X.col(message), F.lit("")))
    expr = None
    for level, tokens in R.INFERRED_SEVERITY:
        cond = X.contains_any(m, tokens)
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr.otherwise(F.lit(R.INFERRED_SEVERITY_ELSE))


def flexible_time(value: str | Column, as_of: _dt.datetime) -> Column:
    """P10: epoch seconds / milliseconds, ISO, 'yyyy-MM-dd HH:mm:ss,SSS', 'yyyy-MM-dd HH:mm:ss',
    'MMM d HH:mm:ss' (year of as_of); anything else -> as_of."""
    raw = strip(X.col(value))
    digits = raw.rlike(r"^[0-9]+$")
    iv = raw.try_cast("bigint")
    epoch = F.when(iv > F.lit(10_000_000_000), F.timestamp_millis(iv)).otherwise(F.timestamp_seconds(iv))
    bsd = F.try_to_timestamp(F.concat(F.regexp_replace(raw, r"\s+", " "), F.lit(f" {as_of.year}")),
                             F.lit("MMM d HH:mm:ss yyyy"))
    parsed = F.coalesce(
        F.when(digits, epoch),
        iso_time(raw),
        F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss,SSSSSS")),
        F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss,SSS")),
        F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss")),
        bsd,
    )
    return F.when(raw.isNull() | (raw == ""), X.instant(as_of)) \
        .otherwise(F.coalesce(parsed, X.instant(as_of)))


def lower_keys(m: Column) -> Column:
    """Record keys lower-cased and stripped (a later duplicate wins, as in a dict)."""
    return F.transform_keys(m, lambda k, v: F.lower(strip(k)))


def pick_first(m: Column, keys: list[str]) -> Column:
    """First value that is not NULL and not blank among ``keys``, stripped."""
    return F.coalesce(*[F.nullif(strip(F.try_element_at(m, F.lit(k))), F.lit("")) for k in keys])


def fallback_message(m: Column) -> Column:
    """Up to 8 'k=v' pairs of the other keys joined with ' | ' (NULL when none)."""
    skip = R.TS_KEYS + R.SEV_KEYS + R.SRC_KEYS
    others = F.map_filter(m, lambda k, v: (~k.isin(*skip)) & v.isNotNull())
    pairs = F.transform(F.map_entries(others), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    pairs = F.slice(pairs, 1, R.FALLBACK_MESSAGE_PAIRS)
    return F.when(F.size(pairs) > 0, F.array_join(pairs, " | "))


def json_map(line: Column) -> Column:
    """The line as a JSON object (values as text), NULL unless it is '{...}', parses and has a key."""
    obj = F.from_json(line, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.when(line.startswith("{") & line.endswith("}") & (F.size(obj) > 0), obj)


def kv_map(line: Column) -> Column:
    """key=value pairs (quoted values unquoted, keys lower-cased, a later key wins)."""
    keys = F.regexp_extract_all(line, F.lit(KV_PAIR), 1)
    vals = F.regexp_extract_all(line, F.lit(KV_PAIR), 2)
    vals = F.transform(vals, lambda v: F.regexp_replace(F.regexp_replace(strip(v), '^"+|"+$', ""), "^'+|'+$", ""))
    return F.when(line.contains("=") & (F.size(keys) > 0),
                  F.map_from_arrays(F.transform(keys, lambda k: F.lower(k)), vals))


def keep_rows(df: DataFrame, flag: str) -> DataFrame:
    """Drop rows whose boolean ``flag`` is not true.

    Implemented as an explode of a 0/1-element array: a generator is a barrier
    the optimizer does not push predicates through, so the (expensive) definition
    of ``flag`` is not copied into a filter below the projection that computes it.
    """
    return df.withColumn("_keep", F.explode(F.when(F.col(flag), F.array(F.lit(1))))).drop("_keep", flag)


def _record_picks(m: Column) -> list[Column]:
    return [pick_first(m, R.MSG_KEYS).alias("_m1"), fallback_message(m).alias("_m2"),
            pick_first(m, R.SEV_KEYS).alias("_sev"), pick_first(m, R.SRC_KEYS).alias("_s"),
            pick_first(m, R.EVENT_KEYS).alias("_e"), pick_first(m, R.HOST_KEYS).alias("_h"),
            pick_first(m, R.USER_KEYS).alias("_u"), pick_first(m, R.TS_KEYS).alias("_t")]


def parse_plaintext(lines: DataFrame, as_of: _dt.datetime, line_col: str = "line",
                    source_col: str = "source_name", keep_leading_ts: bool = False,
                    keep_unparsed: bool = False) -> DataFrame:
    """P15 + P09 + P11-P14: JSON object -> key=value -> leading ISO timestamp + message.

    One pass over the lines in staged projections (each regex / JSON parse runs
    once per line).  A JSON/KV record without any message is not parsed (it does
    not fall through to text), as in the reference; ``keep_unparsed`` keeps such
    rows with ``parsed = false`` for the P21 statistics.
    """
    keep = [c for c in lines.columns if c not in (line_col, source_col)]
    line = F.col(line_col)
    c = (lines.select(*keep, line.alias("_line"), F.col(source_col).alias("_src"), json_map(line).alias("_jm"))
         .withColumn("_km", F.when(F.col("_jm").isNull(), kv_map(F.col("_line"))))
         .withColumn("_fmt", F.when(F.col("_jm").isNotNull(), F.lit("json"))
                     .when(F.col("_km").isNotNull(), F.lit("kv")).otherwise(F.lit("plaintext")))
         .withColumn("_rec", F.coalesce(lower_keys(F.col("_jm")), F.col("_km"))))
    c = c.select(*keep, "_line", "_src", "_fmt",
                 F.when(F.col("_fmt") == "json", F.to_json("_jm")).when(F.col("_fmt") == "kv", F.to_json("_km"))
                 .otherwise(F.col("_line")).alias("_raw"),
                 F.when(F.col("_fmt") == "plaintext", _groups(F.col("_line"), ISO_LINE, 2)).alias("_iso"),
                 *_record_picks(F.col("_rec")))
    text_msg = F.when(F.col("_iso").isNotNull(),
                      F.coalesce(F.nullif(strip(F.col("_iso").getItem(1)), F.lit("")), F.col("_line"))) \
        .otherwise(F.col("_line"))
    is_text = F.col("_fmt") == "plaintext"
    c = c.withColumn("_msg", F.when(is_text, text_msg).otherwise(F.coalesce("_m1", "_m2")))
    text_ts = F.when(F.col("_iso").isNotNull(),
                     F.coalesce(iso_time(F.col("_iso").getItem(0)), X.instant(as_of))) \
        .otherwise(X.instant(as_of))
    rec_ts = flexible_time(F.col("_t"), as_of)
    if keep_leading_ts:
        lead = F.when(F.col("_line").rlike(ISO_LINE), iso_time(F.regexp_extract(F.col("_line"), ISO_LINE, 1)))
        rec_ts = F.when(F.col("_fmt") == "kv", F.coalesce(lead, rec_ts)).otherwise(rec_ts)
    out = c.select(
        *keep,
        F.when(is_text, text_ts).otherwise(rec_ts).alias("timestamp"),
        F.substring(F.when(is_text, F.col("_src")).otherwise(F.coalesce("_s", "_src")), 1, R.CAP_FIELD).alias("source"),
        F.lit(None).cast("string").alias("event_id"),
        F.substring(F.when(is_text, F.lit("plaintext")).otherwise(F.coalesce(F.col("_e"), F.col("_fmt"))),
                    1, R.CAP_FIELD).alias("event_type"),
        F.substring(F.when(is_text, infer_severity("_msg"))
                    .otherwise(F.upper(F.coalesce(F.col("_sev"), infer_severity("_msg")))), 1, R.CAP_SEVERITY).alias("severity"),
        F.substring("_msg", 1, R.CAP_MESSAGE).alias("message"),
        F.substring(F.when(~is_text, F.col("_h")), 1, R.CAP_FIELD).alias("hostname"),
        F.substring(F.when(~is_text, F.col("_u")), 1, R.CAP_FIELD).alias("username"),
        F.lit(None).cast("string").alias("process_name"),
        F.lit(None).cast("bigint").alias("process_id"),
        F.substring("_raw", 1, R.CAP_RAW).alias("raw_data"),
        F.col("_fmt").alias("fmt"),
        F.col("_msg").isNotNull().alias("parsed"))
    return out if keep_unparsed else keep_rows(out, "parsed")


def parse_records(records: DataFrame, as_of: _dt.datetime, fmt: str = "csv", source_name: str = "upload",
                  keep=("file_path", "line_number")) -> DataFrame:
    """S03 + P11: rows of any reader (CSV with header, JSON) -> log fields via the key aliases."""
    cols = [c for c in records.columns if c not in keep]
    k = [c for c in keep if c in records.columns]
    m = F.from_json(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols])), "map<string,string>")
    return parse_maps(records.select(*k, F.lit(source_name).alias("_src"), m.alias("_map")), as_of, fmt, k)


def parse_maps(records: DataFrame, as_of: _dt.datetime, fmt: str, k: list[str]) -> DataFrame:
    """S03 + P11: rows (kept columns ``k``, _src, _map of column name -> text) -> log fields."""
    st = (records.select(*k, "_src", F.to_json("_map").alias("_raw"), lower_keys(F.col("_map")).alias("_rec"))
          .select(*k, "_src", "_raw", *_record_picks(F.col("_rec")))
          .withColumn("_msg", F.coalesce("_m1", "_m2")))
    out = st.select(
        *k,
        flexible_time(F.col("_t"), as_of).alias("timestamp"),
        F.substring(F.coalesce("_s", "_src"), 1, R.CAP_FIELD).alias("source"),
        F.lit(None).cast("string").alias("event_id"),
        F.substring(F.coalesce(F.col("_e"), F.lit(fmt)), 1, R.CAP_FIELD).alias("event_type"),
        F.substring(F.upper(F.coalesce(F.col("_sev"), infer_severity("_msg"))), 1, R.CAP_SEVERITY).alias("severity"),
        F.substring("_msg", 1, R.CAP_MESSAGE).alias("message"),
        F.substring("_h", 1, R.CAP_FIELD).alias("hostname"),
        F.substring("_u", 1, R.CAP_FIELD).alias("username"),
        F.lit(None).cast("string").alias("process_name"),
        F.lit(None).cast("bigint").alias("process_id"),
        F.substring("_raw", 1, R.CAP_RAW).alias("raw_data"),
        F.lit(fmt).alias("fmt"),
        F.col("_msg").isNotNull().alias("parsed"))
    return keep_rows(out, "parsed")


def parse_stats(parsed_flags: DataFrame, group: str = "file_path") -> DataFrame:
    """Per file parsed / errors / success rate = parsed / max(parsed + errors, 1)."""
    g = parsed_flags.groupBy(group).agg(F.count_if(F.col("ok")).cast("bigint").alias("parsed"),
                                        F.count_if(~F.col("ok")).cast("bigint").alias("errors"))
    return g.withColumn("success_rate", X.round6(F.col("parsed") / F.greatest(F.col("parsed") + F.col("errors"), F.lit(1))))


def ingest_rollup(stats: DataFrame) -> DataFrame:
    """Files ingested, total entries, failures over per-file statistics."""
    return stats.agg(F.count_if(F.col("parsed") > 0).cast("bigint").alias("files_ingested"),
                     F.coalesce(F.sum("parsed"), F.lit(0)).cast("bigint").alias("total_entries"),
                     F.count_if(F.col("parsed") == 0).cast("bigint").alias("failures"))


# ------------------------------------------------------------------ Windows events
def windows_event_fields(event: Column, as_of: _dt.datetime) -> Column:
    """P16-P18 on a parsed Event struct (from_xml / spark.read.format('xml'), rowTag Event)."""
    system = event["System"]
    eid = system["EventID"].cast("string")
    level = system["Level"].cast("string")
    data = F.coalesce(event["EventData"]["Data"], F.array())
    users = F.filter(data, lambda d: d["_Name"].isin("TargetUserName", "SubjectUserName"))
    pname = F.filter(data, lambda d: d["_Name"] == "ProcessName")
    pid = F.filter(data, lambda d: d["_Name"] == "ProcessId")
    pid_txt = F.try_element_at(pid, F.lit(-1))["_VALUE"]
    pid_val = F.when(pid_txt.startswith("0x"), F.conv(F.substring(pid_txt, 3, 64), 16, 10).try_cast("bigint")) \
        .otherwise(pid_txt.try_cast("bigint"))
    msg = event["RenderingInfo"]["Message"]
    return F.struct(
        F.coalesce(iso_time(system["TimeCreated"]["_SystemTime"]), X.instant(as_of)).alias("timestamp"),
        F.coalesce(system["Provider"]["_Name"], F.lit("Unknown")).alias("source"),
        F.coalesce(eid, F.lit("Unknown")).alias("event_id"),
        F.coalesce(X.lookup(R.WINDOWS_EVENT_TYPES, eid), F.concat(F.lit("Event-"), F.coalesce(eid, F.lit("Unknown")))).alias("event_type"),
        X.lookup(R.WINDOWS_LEVELS, F.coalesce(level, F.lit("4")), "INFO").alias("severity"),
        F.coalesce(msg, F.concat(F.lit("Event ID "), F.coalesce(eid, F.lit("Unknown")))).alias("message"),
        system["Computer"].cast("string").alias("hostname"),
        F.try_element_at(users, F.lit(-1))["_VALUE"].alias("username"),
        F.try_element_at(pname, F.lit(-1))["_VALUE"].alias("process_name"),
        pid_val.alias("process_id"),
    )


# ------------------------------------------------------------------ stream parse
def stream_parse(lines: DataFrame, now: Column, line_col: str = "line", file_col: str = "source_file") -> DataFrame:
    """Optional-priority BSD, then the 5424 subset, else the whole line is the message.

    Staged like ``parse_syslog``: each pattern runs once per line; blank lines are
    dropped by a cheap test on the stripped line.
    """
    keep = [c for c in lines.columns if c != line_col]
    d = (lines.select(*keep, strip(F.col(line_col)).alias("_l"))
         .filter(F.col("_l") != "")
         .withColumn("_b", _groups(F.col("_l"), STREAM_BSD, 5))
         .withColumn("_r", F.when(F.col("_b").isNull(), _groups(F.col("_l"), STREAM_5424, 6))))
    b, r = F.col("_b").isNotNull(), F.col("_r").isNotNull()
    return d.select(
        *keep,
        F.col("_l").alias("raw"),
        F.col(file_col).alias("source_file") if file_col != "source_file" else F.lit(None).cast("string").alias("_unused"),
        F.when(b, _gi("_b", 1)).when(r, _gi("_r", 2))
         .otherwise(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.when(b, _gi("_b", 2)).when(r, _gi("_r", 3)).alias("hostname"),
        F.when(b, _gi("_b", 3)).when(r, _gi("_r", 4)).alias("source"),
        F.when(b, F.nullif(_gi("_b", 4), F.lit(""))).when(r, _gi("_r", 5)).alias("pid"),
        F.when(b, _gi("_b", 5)).when(r, _gi("_r", 6)).otherwise(F.col("_l")).alias("message"),
        F.when(r, _gi("_r", 1)).alias("priority"),
    ).drop("_unused")
