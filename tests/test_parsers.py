"""Parser goldens (FIXTURES §4) and file-source behaviour."""

from __future__ import annotations

import datetime as dt
import json
import os

from pyspark.sql import functions as F

from sparklog.operators import parse as P
from sparklog.sources import logfiles as LF
from sparklog.sources import sinks as SK

AS_OF = dt.datetime(2024, 1, 31)


def _one(spark, fn, line, **kw):
    df = spark.createDataFrame([(1, line, "sample.txt")], "n int, line string, source_name string")
    rows = fn(df, AS_OF, **kw).collect()
    return rows[0] if rows else None


def test_rfc5424(spark):
    r = _one(spark, lambda d, a: P.parse_syslog(d.drop("source_name"), a),
             "<34>1 2024-01-01T10:00:00Z host1 su - ID47 - 'su root' failed")
    assert (r.severity, r.facility, r.source, r.event_id, r.process_id) == ("CRITICAL", 4, "su", "ID47", None)
    assert r.message == "'su root' failed" and r.hostname == "host1" and r.fmt == "rfc5424"
    assert r.timestamp == dt.datetime(2024, 1, 1, 10, 0)


def test_rfc3164_two_space_day(spark):
    r = _one(spark, lambda d, a: P.parse_syslog(d.drop("source_name"), a),
             "<34>Jan  1 12:34:56 host1 sshd[12]: Failed password")
    assert (r.severity, r.source, r.process_name, r.process_id) == ("CRITICAL", "sshd", "sshd", 12)
    assert r.timestamp == dt.datetime(2024, 1, 1, 12, 34, 56)


def test_syslog_without_priority_and_no_match(spark):
    r = _one(spark, lambda d, a: P.parse_syslog(d.drop("source_name"), a), "Jan 11 12:34:56 host1 cron: job ok")
    assert (r.severity, r.fmt, r.source) == ("INFO", "simple", "cron")
    assert _one(spark, lambda d, a: P.parse_syslog(d.drop("source_name"), a), "hello") is None


def test_json_epoch_ms_and_aliases(spark):
    r = _one(spark, P.parse_plaintext,
             '{"@timestamp":"1767225600000","msg":"x failed","level":"warn","host":"h1"}')
    assert r.timestamp == dt.datetime(2026, 1, 1) and r.severity == "WARN" and r.hostname == "h1"
    assert r.message == "x failed" and r.fmt == "json" and r.source == "sample.txt"


def test_json_without_message_key(spark):
    r = _one(spark, P.parse_plaintext, '{"a":1,"b":2}')
    assert r.message == "a=1 | b=2" and r.severity == "LOW"


def test_kv_loses_leading_timestamp_unless_asked(spark):
    line = '2026-01-01T00:00:00 severity=HIGH source=n1 message="Unauthorized access (case=1)"'
    r = _one(spark, P.parse_plaintext, line)
    assert (r.severity, r.source, r.message, r.timestamp) == ("HIGH", "n1", "Unauthorized access (case=1)", AS_OF)
    r2 = _one(spark, P.parse_plaintext, line, keep_leading_ts=True)
    assert r2.timestamp == dt.datetime(2026, 1, 1)


def test_iso_text_line(spark):
    r = _one(spark, P.parse_plaintext, "2026-02-23 10:15:35 WARNING  disk          Disk usage at 82% on /dev/sda1")
    assert r.timestamp == dt.datetime(2026, 2, 23, 10, 15, 35) and r.severity == "MEDIUM" and r.fmt == "plaintext"


def test_text_with_equals_goes_kv(spark):
    r = _one(spark, P.parse_plaintext,
             "2026-02-23 10:16:45 ERROR    auth          Failed login attempt: username=admin ip=203.0.113.45")
    assert r.fmt == "kv" and r.username == "admin" and r.message == "username=admin | ip=203.0.113.45"
    assert r.severity == "LOW"


def test_duplicate_key_last_wins(spark):
    r = _one(spark, P.parse_plaintext, "a=1 msg=x a=2")
    assert r.message == "x"
    m = spark.createDataFrame([("a=1 msg=x a=2",)], "line string").select(P.kv_map(F.col("line")).alias("m")).first().m
    assert m["a"] == "2"


def test_flexible_times(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000123",), ("2024-01-02 03:04:05,123",),
                                ("Feb 3 04:05:06",), ("junk",), (None,)], "v string")
    got = [r.t for r in df.select(P.flexible_time(F.col("v"), AS_OF).alias("t")).collect()]
    assert got[0] == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert got[1] == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert got[2] == dt.datetime(2024, 1, 2, 3, 4, 5, 123000)
    assert got[3] == dt.datetime(2024, 2, 3, 4, 5, 6)
    assert got[4] == AS_OF and got[5] == AS_OF


def test_read_lines_numbers_are_exact_across_splits(spark, tmp_path):
    p = tmp_path / "big.log"
    lines = [f"line {i}" if i % 7 else "" for i in range(1, 20001)]
    p.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = LF.read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() >= 1
        rows = {r.line_number: r.line for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expect = {i: f"line {i}" for i in range(1, 20001) if i % 7}
    assert rows == expect


def test_format_detection_and_folder_ingest(spark, tmp_path):
    (tmp_path / "a.log").write_text("<13>Jan  5 10:00:00 h1 sshd[1]: Failed password\nnot syslog\n")
    (tmp_path / "b.txt").write_text("2026-02-23 10:15:35 ERROR disk broken\n\nplain words\n")
    lines = LF.read_lines(spark, str(tmp_path))
    fm = {os.path.basename(r.file_path): r.format for r in LF.detect_formats(lines).collect()}
    assert fm == {"a.log": "syslog", "b.txt": "text"}
    parsed = LF.parse_files(spark, str(tmp_path), AS_OF)
    assert parsed.filter(F.col("fmt") == "rfc3164").count() == 1      # unmatched syslog line dropped
    assert parsed.filter(F.col("fmt") == "plaintext").count() == 2


def test_csv_logs(spark, tmp_path):
    (tmp_path / "app.csv").write_text("timestamp,level,logger,message,module\n"
                                      "2026-01-01 10:00:00,ERROR,core,boom happened,x\n"
                                      "2026-01-01 10:00:01,,web,,y\n")
    rows = sorted(LF.read_csv_logs(spark, str(tmp_path), AS_OF).collect(), key=lambda r: r.timestamp)
    assert rows[0].severity == "ERROR" and rows[0].source == "core" and rows[0].message == "boom happened"
    assert rows[1].message == "module=y" and rows[1].source == "web"


def test_windows_event_xml(spark, tmp_path):
    xml = """<Events><Event><System><Provider Name="Microsoft-Windows-Security-Auditing"/><EventID>4625</EventID>
<Level>2</Level><TimeCreated SystemTime="2024-01-02T03:04:05Z"/><Computer>WS1</Computer></System>
<EventData><Data Name="SubjectUserName">alice</Data><Data Name="TargetUserName">bob</Data>
<Data Name="ProcessName">lsass.exe</Data><Data Name="ProcessId">0x1f4</Data></EventData></Event>
<Event><System><Provider Name="X"/><EventID>9999</EventID><Computer>WS2</Computer></System></Event></Events>"""
    (tmp_path / "ev.xml").write_text(xml)
    rows = {r.event_id: r for r in LF.read_windows_events(spark, str(tmp_path / "ev.xml"), AS_OF).collect()}
    r = rows["4625"]
    assert (r.event_type, r.severity, r.username, r.process_name, r.process_id) == \
        ("Failed Logon", "HIGH", "bob", "lsass.exe", 500)
    assert rows["9999"].event_type == "Event-9999" and rows["9999"].severity == "INFO"
    assert rows["9999"].message == "Event ID 9999"


def test_attack_bundle(spark, tmp_path):
    from sparklog.operators import mitre
    bundle = {"objects": [
        {"type": "attack-pattern", "name": "Brute Force", "description": "d",
         "external_references": [{"source_name": "x", "external_id": "no"},
                                 {"source_name": "mitre-attack", "external_id": "T1110"}],
         "kill_chain_phases": [{"phase_name": "credential-access"}], "x_mitre_platforms": ["Linux"]},
        {"type": "attack-pattern", "name": "No id", "external_references": []},
        {"type": "malware", "name": "m"}]}
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    rows = mitre.load_attack_bundle(spark, str(tmp_path / "b.json")).collect()
    assert [(r.technique_id, r.tactic, r.platforms) for r in rows] == [("T1110", "credential_access", ["Linux"])]


def test_dataset_registration_and_fingerprint(spark, tmp_path):
    d = tmp_path / "up"
    d.mkdir()
    (d / "My Log-File.txt").write_text("hello\n")
    reg = LF.register_datasets(spark, str(d)).first()
    assert reg.dataset_id.startswith("my_log_file_") and len(reg.dataset_id) == len("my_log_file_") + 12
    again = LF.register_datasets(spark, str(d), LF.register_datasets(spark, str(d)))
    assert again.count() == 0
    fp = SK.bundle_fingerprint(spark, str(d)).first()
    assert fp.files == 1 and len(fp.bundle_sha256) == 64


def test_append_logs_assigns_dense_ids(spark, tmp_path):
    lines = spark.createDataFrame([(f"/f{i % 2}", i, f"2026-01-01 00:00:0{i % 10} ERROR x{i}") for i in range(1, 21)],
                                  "file_path string, line_number long, line string")
    parsed = P.parse_plaintext(lines.withColumn("source_name", F.lit("f")), AS_OF)
    out = SK.append_logs(parsed, str(tmp_path / "logs"), current_max_id=100)
    ids = sorted(r.id for r in spark.read.parquet(str(tmp_path / "logs")).select("id").collect())
    assert ids == list(range(101, 121)) and out.count() == 20


def test_media_files_and_inventory(spark, tmp_path):
    (tmp_path / "big.log").write_text("x" * 200)
    (tmp_path / "small.txt").write_text("x")
    (tmp_path / "other.bin").write_text("x" * 500)
    got = [os.path.basename(r.path) for r in LF.media_files(spark, str(tmp_path)).collect()]
    assert got == ["big.log"]
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "modificationTime")
    ds = LF.register_datasets(spark, str(tmp_path))
    logs = ds.select("dataset_id").withColumn("n", F.lit(1))
    inv = LF.dataset_inventory(files, ds, logs).collect()
    assert len(inv) == 3 and all(r.records == 1 for r in inv)


def test_evtx_signature(spark, tmp_path):
    (tmp_path / "a.evtx").write_bytes(b"ElfFile\x00" + b"\x00" * 100)
    (tmp_path / "b.evtx").write_bytes(b"NotAnEvtx" + b"\x00" * 100)
    got = [os.path.basename(r.path) for r in LF.evtx_files(spark, str(tmp_path)).collect()]
    assert got == ["a.evtx"]


def _kv_brute(line: str) -> dict:
    """The key=value rules stated directly: keys [A-Za-z0-9_.-]+, values "..." | '...' | non-space run,
    quotes stripped, keys lower-cased, a later key wins (dict order kept)."""
    import re
    out = {}
    for k, v in re.findall(r'([A-Za-z0-9_.-]+)=(".*?"|\'.*?\'|\S+)', line):
        out[k.lower()] = v.strip().strip('"').strip("'")
    return out


def test_kv_parser_against_brute_force(spark):
    from hypothesis import given, settings, strategies as st
    key = st.text(alphabet="abcXYZ_.-1", min_size=1, max_size=4)
    val = st.one_of(st.text(alphabet="xyz09:/", min_size=1, max_size=5),
                    st.text(alphabet="ab cd", min_size=0, max_size=6).map(lambda v: '"' + v + '"'))
    pair = st.tuples(key, val).map(lambda kv: kv[0] + "=" + kv[1])
    lines = st.lists(st.lists(pair, min_size=1, max_size=5).map(" ".join), min_size=20, max_size=20)

    @settings(max_examples=5, deadline=None)
    @given(lines)
    def check(batch):
        df = spark.createDataFrame([(i, l) for i, l in enumerate(batch)], "i int, line string")
        got = {r.i: dict(r.m) for r in df.select("i", P.kv_map(F.col("line")).alias("m")).collect()}
        for i, l in enumerate(batch):
            assert got[i] == _kv_brute(l), l
    check()


def _syslog_brute(line: str):
    """The syslog cascade stated with Python's re: 5424, else 3164, else priority-less BSD."""
    import re
    sev = {0: "CRITICAL", 1: "CRITICAL", 2: "CRITICAL", 3: "HIGH", 4: "MEDIUM", 5: "INFO", 6: "INFO", 7: "INFO"}
    m = re.match(P.RFC5424, line)
    if m:
        g = m.groups()
        return ("rfc5424", None if g[3] == "-" else g[3], "syslog" if g[4] == "-" else g[4], g[8], sev[int(g[0]) & 7])
    m = re.match(P.RFC3164, line)
    if m:
        g = m.groups()
        return ("rfc3164", g[2], g[3], g[5], sev[int(g[0]) & 7])
    m = re.match(P.SIMPLE, line)
    if m:
        g = m.groups()
        return ("simple", g[1], g[2], g[4], "INFO")
    return None


def test_syslog_parser_against_brute_force(spark):
    from hypothesis import given, settings, strategies as st
    word = st.text(alphabet="abcxyz09-_.", min_size=1, max_size=6)
    msg = st.text(alphabet="abc XYZ:[]=-019", min_size=0, max_size=12)
    bsd = st.tuples(st.sampled_from(["Jan", "Feb", "Mar"]), st.integers(1, 28), st.sampled_from([" ", "  "])) \
        .map(lambda t: f"{t[0]}{t[2] if t[1] < 10 else ' '}{t[1]} 10:11:12")
    tag = st.tuples(word, st.one_of(st.none(), st.integers(1, 999))).map(lambda t: t[0] + (f"[{t[1]}]" if t[1] else ""))
    l3164 = st.tuples(st.integers(0, 191), bsd, word, tag, msg).map(lambda t: f"<{t[0]}>{t[1]} {t[2]} {t[3]}: {t[4]}")
    lsimple = st.tuples(bsd, word, tag, msg).map(lambda t: f"{t[0]} {t[1]} {t[2]}: {t[3]}")
    l5424 = st.tuples(st.integers(0, 191), word, word, st.sampled_from(["-", "12"]), word, msg) \
        .map(lambda t: f"<{t[0]}>1 2024-01-02T03:04:05Z {t[1]} {t[2]} {t[3]} {t[4]} - {t[5]}")
    junk = msg
    lines = st.lists(st.one_of(l3164, lsimple, l5424, junk), min_size=25, max_size=25)

    @settings(max_examples=4, deadline=None)
    @given(lines)
    def check(batch):
        batch = [b for b in batch if b.strip() == b]        # the parser sees stripped lines
        df = spark.createDataFrame([(i, l) for i, l in enumerate(batch)], "i int, line string")
        got = {r.i: (r.fmt, r.hostname, r.source, r.message, r.severity)
               for r in P.parse_syslog(df, AS_OF).collect()}
        for i, l in enumerate(batch):
            assert got.get(i) == _syslog_brute(l), l
    check()


def test_csv_files_by_their_own_header_and_ingest_report(spark, tmp_path):
    (tmp_path / "a.csv").write_text('timestamp,severity,message,source\n2024-01-01 10:00:00,HIGH,"disk, ""full""",db\n')
    (tmp_path / "b.csv").write_text("source,message,severity,timestamp\nweb,started,LOW,2024-01-02 10:00:00\nweb,no time\n")
    (tmp_path / "c.log").write_text("<13>Jan  5 10:00:00 h1 sshd[1]: hello\n")
    (tmp_path / "d.txt").write_text("{}\nplain error\n")
    (tmp_path / "e.evtx").write_bytes(b"ElfFile\x00")
    (tmp_path / "f.log").write_bytes(b"")
    rows = sorted((r.source, r.severity, r.message) for r in LF.parse_files(spark, str(tmp_path), AS_OF).collect())
    assert ("db", "HIGH", 'disk, "full"') in rows and ("web", "LOW", "started") in rows and len(rows) == 6
    assert {m for s, _, m in rows if s == "d.txt"} == {"plain error", "{}"}
    got = {r.file_path.rsplit("/", 1)[1]: (r.format, r.parsed, r.errors, r.status) for r in LF.ingest_report(spark, str(tmp_path), AS_OF).collect()}
    assert got == {"a.csv": ("csv", 1, 0, "ok"), "b.csv": ("csv", 2, 0, "ok"), "c.log": ("syslog", 1, 0, "ok"), "d.txt": ("text", 2, 0, "ok"),
                   "e.evtx": ("evtx", 0, 0, "unsupported")}
