"""The library's tables derived from the driver's test tables (FIXTURES.md §2-3).

``logs`` is one narrow projection of ``events`` (no shuffle); the other tables are
derived from ``logs`` the same way the DuckDB oracle derives them, so every query
that reads them grows with the input.  All "now" logic uses ``AS_OF``.
"""

from __future__ import annotations

import datetime as _dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import mitre

AS_OF = _dt.datetime(2024, 1, 31, 0, 0, 0)

# FIXTURE VALUES (FIXTURES.md §2-3) — fixed, in natural order
FIXTURE_SOURCES = ["sshd", "sudo", "kernel", "auditd", "postfix", "nginx", "cron",
                   "systemd", "dockerd", "app-worker", "firewall"]
FIXTURE_EVENT_IDS = ["4624", "4625", "4672", "4720", "4732", "4688", "4698", "5140",
                     "7045", "4634", None, None]
FIXTURE_TEXTS = [
    "Failed password for invalid user",
    "Accepted publickey for",
    "session started for",
    "access denied for",
    "sudo: privilege escalation by",
    "powershell launched by",
    "error: connection refused for",
    "warning: disk usage high for",
    "user login succeeded for",
    "unauthorized request blocked for",
    "scheduled task created by",
    "registry key changed by",
    "heartbeat ok for",
]
# technique id, name, first tactic; T1098 is left out on purpose ("must exist" rule)
FIXTURE_TECHNIQUES = [
    ("T1078", "Valid Accounts", "defense_evasion"),
    ("T1078.002", "Domain Accounts", "defense_evasion"),
    ("T1110", "Brute Force", "credential_access"),
    ("T1136", "Create Account", "persistence"),
    ("T1059", "Command and Scripting Interpreter", "execution"),
    ("T1059.001", "PowerShell", "execution"),
    ("T1059.003", "Windows Command Shell", "execution"),
    ("T1053", "Scheduled Task/Job", "execution"),
    ("T1053.005", "Scheduled Task", "execution"),
    ("T1021", "Remote Services", "lateral_movement"),
    ("T1021.001", "Remote Desktop Protocol", "lateral_movement"),
    ("T1021.002", "SMB/Windows Admin Shares", "lateral_movement"),
    ("T1021.004", "SSH", "lateral_movement"),
    ("T1543", "Create or Modify System Process", "persistence"),
    ("T1543.003", "Windows Service", "persistence"),
    ("T1047", "Windows Management Instrumentation", "execution"),
    ("T1003", "OS Credential Dumping", "credential_access"),
    ("T1112", "Modify Registry", "defense_evasion"),
    ("T1068", "Exploitation for Privilege Escalation", "privilege_escalation"),
    ("T1546", "Event Triggered Execution", "privilege_escalation"),
]
# session id, start, end, algorithm, threshold, log_source
FIXTURE_SESSIONS = [
    ("s1", _dt.datetime(2024, 1, 1), _dt.datetime(2024, 1, 10), "ensemble", 0.7, "sshd"),
    ("s2", _dt.datetime(2024, 1, 10), _dt.datetime(2024, 1, 20), "statistical", 0.75, "latest"),
    ("s3", _dt.datetime(2024, 1, 20), None, "isolation_forest", 0.65, "all"),
]
FIXTURE_ALGORITHMS = ["ensemble", "statistical", "isolation_forest"]
FIXTURE_NODES = 5
FIXTURE_DEVICES = 40
# device name, vendor id by user_id % 9
FIXTURE_DEVICE_KINDS = [
    ("SanDisk Cruzer Flash Drive", "0781"),
    ("Logitech USB Keyboard", "046d"),
    ("USB Audio Headset", "0d8c"),
    ("Realtek USB Ethernet Adapter", "0bda"),
    ("Android Phone MTP", "18d1"),
    ("HD Webcam", "0c45"),
    ("Generic Device", "05ac"),
    ("Kingston Storage", "0951"),
    ("Laser Printer", "04b8"),
]


def _pick(values: list, index: Column) -> Column:
    """values[index] for a 0-based integer column (NULL entries stay NULL)."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (index + 1).cast("int"))


def derive_logs(events: DataFrame) -> DataFrame:
    """FIXTURES §2: one `logs` row per event (narrow projection, no shuffle)."""
    eid, uid, et, val = F.col("event_id"), F.col("user_id"), F.col("event_type"), F.col("value")
    message = F.concat(
        _pick(FIXTURE_TEXTS, eid % 13), F.lit(" user"), uid.cast("string"),
        F.when(eid % 3 == 0, F.concat(F.lit(" from 10.0.0."), (uid % 250).cast("string"))).otherwise(F.lit("")),
        F.when(eid % 5 == 0, F.concat(F.lit(" port "), (F.lit(1024) + eid % 60000).cast("string"))).otherwise(F.lit("")),
    )
    severity = (F.when(eid % 97 == 0, F.lit(None))
                .when((et == "error") & (val > 60), "CRITICAL")
                .when((et == "error") & (val > 20), "HIGH")
                .when(et == "error", "ERROR")
                .when((et == "purchase") & (val > 40), "MEDIUM")
                .when(et == "signup", "WARNING")
                .when(et == "click", "INFO")
                .otherwise("LOW"))
    return events.select(
        eid.alias("id"),
        F.col("ts").alias("timestamp"),
        _pick(FIXTURE_SOURCES, uid % 11).alias("source"),
        _pick(FIXTURE_EVENT_IDS, eid % 12).alias("event_id"),
        F.when(eid % 12 == 1, F.lit("Failed Logon")).otherwise(et).alias("event_type"),
        severity.cast("string").alias("severity"),
        message.alias("message"),
        F.when(uid % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("host-"), (uid % 20).cast("string"))).cast("string").alias("hostname"),
        F.when(eid % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("user"), uid.cast("string"))).cast("string").alias("username"),
        F.when(eid % 2 == 0, F.lit("proc")).cast("string").alias("process_name"),
        F.when(eid % 2 == 0, eid % 32768).cast("bigint").alias("process_id"),
        (F.col("ts") + F.make_dt_interval(secs=(eid % 600).cast("int"))).alias("ingestion_time"),
    )


def techniques_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE_TECHNIQUES, "technique_id string, technique_name string, tactic string") \
        .withColumn("description", F.concat(F.lit("ATT&CK technique "), F.col("technique_name")))


def sessions_df(spark: SparkSession) -> DataFrame:
    rows = [(sid, st, en, "completed", alg, thr, src) for sid, st, en, alg, thr, src in FIXTURE_SESSIONS]
    df = spark.createDataFrame(rows, "session_id string, start_time timestamp_ntz, end_time timestamp_ntz, "
                                     "status string, algorithm string, threshold double, log_source string")
    return df.select("session_id", "start_time", "end_time", "status",
                     F.to_json(F.struct("algorithm", "threshold", "log_source")).alias("parameters"))


def derive_anomalies(mapped_logs: DataFrame) -> DataFrame:
    """FIXTURES §3 anomalies: logs of severity CRITICAL/HIGH/ERROR/MEDIUM with a fixed score rule."""
    lid = F.col("id")
    score = F.lit(0.5) + (lid % 50).cast("double") / F.lit(100.0)
    return (mapped_logs.filter(F.col("severity").isin("CRITICAL", "HIGH", "ERROR", "MEDIUM"))
            .select(lid.alias("id"), lid.alias("log_id"), score.alias("anomaly_score"),
                    _pick(FIXTURE_ALGORITHMS, lid % 3).alias("algorithm"),
                    X.stored_severity(score).alias("severity"),
                    F.col("timestamp").alias("detected_at"),
                    "mitre_technique_id", "mitre_tactic"))


def derive_hub_anomalies(anomalies: DataFrame, logs: DataFrame, copies: int = 2) -> DataFrame:
    """FIXTURES §3: anomalies attributed to node-(id % 5), imported ``copies`` times."""
    a = anomalies.join(logs.select("id", "timestamp", "source", "event_type", "message", "hostname", "username"),
                       anomalies["log_id"] == logs["id"]).drop(logs["id"])
    one = a.select(F.col("log_id").alias("original_id"),
                   F.concat(F.lit("node-"), (F.col("log_id") % FIXTURE_NODES).cast("string")).alias("source_node"),
                   "anomaly_score", "severity", "algorithm", "mitre_technique_id", "mitre_tactic",
                   F.col("timestamp").alias("log_timestamp"), "source", "event_type",
                   F.substring(F.coalesce("message", F.lit("")), 1, 500).alias("message"),
                   "hostname", "username")
    batches = one.withColumn("import_batch", F.explode(F.array(*[F.lit(i) for i in range(copies)])))   # the join is done once
    imported_at = X.ntz(AS_OF) - F.make_dt_interval(hours=(F.lit(copies) - F.col("import_batch")) * 24)
    return batches.select(*one.columns, imported_at.alias("imported_at"), "import_batch")


def derive_device_log(logs: DataFrame) -> DataFrame:
    """FIXTURES §3 device events: device per user, connect on even event id, else disconnect."""
    uid = F.col("user_id")
    names = [n for n, _ in FIXTURE_DEVICE_KINDS]
    vids = [v for _, v in FIXTURE_DEVICE_KINDS]
    return logs.select(
        F.concat(F.lit("dev-"), (uid % FIXTURE_DEVICES).cast("string")).alias("device_id"),
        _pick(names, uid % 9).alias("name"),
        _pick(vids, uid % 9).alias("vendor_id"),
        F.col("ts").alias("event_time"),
        F.when(F.col("event_id") % 2 == 0, F.lit("connected")).otherwise(F.lit("disconnected")).alias("event"),
        F.col("event_id").alias("seq"),
    )


#: Rows of a task when a table is dealt out.
ROWS_PER_TASK = 250_000


def split_sizes(df: DataFrame) -> list[int]:
    """Rows of each split that has any (one number a split; no column is read, Parquet footers hold the counts)."""
    return [r["count"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]


def dealt_parts(sizes: list[int], cores: int) -> int | None:
    """Parts to deal the rows into, None where the largest split is at most half above an even part."""
    total = sum(sizes)
    parts = max(cores, -(-total // ROWS_PER_TASK))
    return parts if sizes and max(sizes) * parts > 1.5 * total else None


class Tables:
    """Lazily derived tables of one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """One driver table, read from its own path.

        A table with fewer splits than the session has cores is dealt out inside the
        plan; projections and filters are still pushed below that exchange.  So is one whose
        splits hold uneven or too many rows: a row group is read by one task whatever its size.
        """
        if name not in self._raw:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            cores = self.spark.sparkContext.defaultParallelism
            if df.rdd.getNumPartitions() < cores:
                df = df.repartition(cores)
            else:
                parts = dealt_parts(split_sizes(df), cores)
                df = df.repartition(parts) if parts else df
            self._raw[name] = df
        return self._raw[name]

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def logs(self) -> DataFrame:
        return derive_logs(self.events)

    @cached_property
    def techniques(self) -> DataFrame:
        return techniques_df(self.spark)

    @cached_property
    def mapped_logs(self) -> DataFrame:
        return mitre.map_techniques(self.logs, self.techniques)

    @cached_property
    def anomalies(self) -> DataFrame:
        return derive_anomalies(self.mapped_logs)

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions_df(self.spark)

    @cached_property
    def hub_anomalies(self) -> DataFrame:
        return derive_hub_anomalies(self.anomalies, self.logs)

    @cached_property
    def device_events(self) -> DataFrame:
        return derive_device_log(self.events)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


# ---------------------------------------------------------------- rendered lines
# Log lines rendered from `logs` so the parsers run over data that grows with the tables.
SYSLOG_CODE = [("CRITICAL", 2), ("HIGH", 3), ("ERROR", 3), ("MEDIUM", 4), ("WARNING", 4), ("LOW", 5), ("INFO", 6)]


def render_syslog_lines(logs: DataFrame) -> DataFrame:
    """(id, line): RFC 5424 for id % 3 = 0, RFC 3164 for 1, priority-less BSD for 2."""
    code = F.coalesce(X.lookup(SYSLOG_CODE, F.col("severity")), F.lit(7))
    pri = ((F.col("id") % 24) * 8 + code).cast("string")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bsd = F.concat(F.date_format("timestamp", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("timestamp").cast("string"), 2, " "),
                   F.lit(" "), F.date_format("timestamp", "HH:mm:ss"))
    host = F.coalesce(F.col("hostname"), F.lit("localhost"))
    tag = F.concat(F.col("source"), F.when(F.col("process_id").isNotNull(),
                                           F.concat(F.lit("["), F.col("process_id").cast("string"), F.lit("]")))
                   .otherwise(F.lit("")))
    r5424 = F.concat_ws(" ", F.concat(F.lit("<"), pri, F.lit(">1")), iso, F.coalesce("hostname", F.lit("-")),
                        F.col("source"), F.coalesce(F.col("process_id").cast("string"), F.lit("-")),
                        F.coalesce("event_id", F.lit("-")), F.lit("-"), F.col("message"))
    r3164 = F.concat(F.lit("<"), pri, F.lit(">"), bsd, F.lit(" "), host, F.lit(" "), tag, F.lit(": "), F.col("message"))
    simple = F.concat(bsd, F.lit(" "), host, F.lit(" "), tag, F.lit(": "), F.col("message"))
    m = F.col("id") % 3
    return logs.select("id", F.when(m == 0, r5424).when(m == 1, r3164).otherwise(simple).alias("line"))


def render_json_lines(logs: DataFrame) -> DataFrame:
    """(id, line): JSON objects with alias keys (@timestamp in epoch ms, msg, level, host, user, service)."""
    ms = (F.unix_micros(F.col("timestamp").cast("timestamp")) / 1000).cast("bigint").cast("string")
    obj = F.struct(ms.alias("@timestamp"), F.col("message").alias("msg"), F.col("severity").alias("level"),
                   F.col("hostname").alias("host"), F.col("username").alias("user"),
                   F.col("source").alias("service"), F.col("event_id").alias("event_code"))
    return logs.select("id", F.to_json(obj).alias("line"))


def render_kv_lines(logs: DataFrame) -> DataFrame:
    """(id, line): key=value records; the message is quoted, blank values are left out."""
    def kv(k, c, quote=False):
        v = F.concat(F.lit('"'), c, F.lit('"')) if quote else c
        return F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), v))
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return logs.select("id", F.concat_ws(" ", kv("time", ts), kv("severity", F.col("severity")),
                                         kv("source", F.col("source")), kv("message", F.col("message"), True),
                                         kv("host", F.col("hostname")), kv("account", F.col("username"))).alias("line"))


def document_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_number, line, source_name): every physical line of every document, stripped, non-blank."""
    from ..operators import parse as P
    parts = documents.select("doc_id", F.posexplode(F.split(F.col("text"), "\r\n|\r|\n")).alias("pos", "raw"))
    return (parts.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_number"),
                         P.strip(F.col("raw")).alias("line"),
                         F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_name"))
            .filter(F.col("line") != ""))


WINDOWS_LEVEL_OF = [("CRITICAL", "1"), ("HIGH", "2"), ("ERROR", "2"), ("MEDIUM", "3"), ("WARNING", "3"), ("INFO", "4")]


def render_event_xml(logs: DataFrame) -> DataFrame:
    """(id, xml): one exported Windows event per log (elements left out when the value is NULL)."""
    def el(tag, c):
        return F.when(c.isNotNull(), F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))).otherwise(F.lit(""))

    def data(name, c):
        return F.when(c.isNotNull(), F.concat(F.lit(f'<Data Name="{name}">'), c, F.lit("</Data>"))).otherwise(F.lit(""))
    level = F.coalesce(X.lookup(WINDOWS_LEVEL_OF, F.col("severity")), F.lit("0"))
    xml = F.concat(
        F.lit("<Event><System>"),
        F.concat(F.lit('<Provider Name="'), F.col("source"), F.lit('"/>')),
        el("EventID", F.col("event_id")), el("Level", level),
        F.concat(F.lit('<TimeCreated SystemTime="'), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"/>')),
        el("Computer", F.col("hostname")),
        F.lit("</System><EventData>"),
        data("SubjectUserName", F.lit("svc")), data("TargetUserName", F.col("username")),
        data("ProcessName", F.col("process_name")),
        data("ProcessId", F.when(F.col("process_id").isNotNull(),
                                 F.concat(F.lit("0x"), F.lower(F.hex(F.col("process_id")))))),
        F.lit("</EventData><RenderingInfo>"), el("Message", F.col("message")),
        F.lit("</RenderingInfo></Event>"))
    return logs.select("id", xml.alias("xml"))
