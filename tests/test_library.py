"""Library operators not exposed as registered queries: hub packages, guarded SQL, look-ups, sinks."""

from __future__ import annotations

import datetime as dt
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sparklog.operators import filters as FL
from sparklog.operators import hub as H
from sparklog.operators import mitre as M
from sparklog.sources import sinks as SK
from sparklog.sources import testdata as TD
from sparklog.sources.testdata import tables


@pytest.fixture(scope="module")
def t(spark, sf_small):
    return tables(spark, sf_small)


def test_sync_package_round_trip_is_idempotent(spark, t, tmp_path):
    pkg = H.export_package(t.anomalies, t.logs, "node-7", "hub")
    pkg.withColumn("package_id", F.lit("p1")).coalesce(1).write.json(str(tmp_path / "pkg"))
    rows, nodes = H.read_sync_packages(spark, str(tmp_path / "pkg"))
    assert nodes.first().node_id == "node-7"
    incoming = rows.select(F.col("id").alias("original_id"), "source_node", "anomaly_score", "severity", "algorithm",
                           "mitre_technique_id", "mitre_tactic", F.col("timestamp").alias("log_timestamp"),
                           "source", "event_type", "message", "hostname", "username")
    first = H.merge_into_hub(None, incoming, dt.datetime(2024, 1, 31))
    n = first.count()
    assert n == min(500, t.anomalies.count())
    again = H.merge_into_hub(first, incoming, dt.datetime(2024, 2, 1))
    assert again.count() == 0


def test_import_of_packages_updates_hub_nodes_and_log(spark, tmp_path):
    import json
    at = dt.datetime(2024, 2, 1, 5)
    node = {"node_id": "n1", "hostname": "h1", "role": "terminal", "total_logs": 50, "total_anomalies": 3, "ip_address": "10.0.0.1"}
    packages = {
        "a": {"package_id": "p1", "source_node": "n1", "logs_summary": node, "anomalies": [
            {"id": 1, "anomaly_score": 0.9, "severity": "HIGH", "algorithm": "x", "message": "m" * 600, "timestamp": "2024-01-01"},
            {"id": 2}, {"id": 2, "severity": "LOW"}, {"id": 3, "severity": None, "message": None, "anomaly_score": None}]},
        "b": {"package_id": "p2", "source_node": "n1", "logs_summary": {**node, "total_logs": 60, "total_anomalies": 4}, "anomalies": [
            {"id": 1, "anomaly_score": 0.1}, {"id": 4, "anomaly_score": 1}]},
        "c": {"anomalies": [{"id": 1}], "logs_summary": {}},
        "d": {"package_id": "p4", "source_node": "n2", "logs_summary": {"node_id": "n2"}}}
    for name, p in packages.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(p, indent=1))
    nodes = spark.createDataFrame([("n1", "old", "hub", "active", dt.datetime(2024, 1, 1), 1, 1, "x", None, "kept"),
                                   ("n9", "h9", "hub", "active", dt.datetime(2024, 1, 1), 9, 9, "y", None, "kept")],
                                  "node_id string, hostname string, role string, status string, last_seen timestamp, total_logs long, "
                                  "total_anomalies long, ip_address string, last_sync timestamp, note string")
    held = spark.createDataFrame([(4, "n1")], "original_id long, source_node string")
    rows, after, log = H.import_packages(spark, str(tmp_path), held, nodes, at)
    got = {(r.source_node, r.original_id): r for r in rows.collect()}
    assert set(got) == {("n1", 1), ("n1", 2), ("n1", 3), ("unknown", 1)}
    assert (got["n1", 1].anomaly_score, len(got["n1", 1].message), got["n1", 1].log_timestamp) == (0.9, 500, "2024-01-01")
    assert (got["n1", 3].anomaly_score, got["n1", 3].severity, got["n1", 3].algorithm, got["n1", 3].message) == (None, None, "unknown", "")
    assert (got["unknown", 1].anomaly_score, got["unknown", 1].severity, got["unknown", 1].imported_at) == (0.0, "UNKNOWN", at)
    n = {r.node_id: r for r in after.collect()}
    assert (n["n1"].hostname, n["n1"].role, n["n1"].status, n["n1"].total_logs, n["n1"].total_anomalies, n["n1"].last_sync, n["n1"].note) == (
        "h1", "hub", "inactive", 60, 4, at, "kept")
    assert (n["n9"].status, n["n9"].last_sync) == ("active", None)
    assert (n["n2"].status, n["n2"].total_anomalies, n["n2"].last_seen) == ("inactive", 0, at)
    audit = {r.package_path[-6:]: r for r in log.collect()}
    assert {k: (r.source_node, r.anomalies_synced, r.total_in_package) for k, r in audit.items()} == {
        "a.json": ("n1", 3, 4), "b.json": ("n1", 0, 2), "c.json": ("unknown", 1, 1), "d.json": ("n2", 0, 0)}
    assert audit["a.json"].sync_id == "p1" and len(audit["c.json"].sync_id) == 32 and audit["d.json"].synced_at == at


def test_package_file_is_what_the_import_reads(spark, t, tmp_path):
    node = {"node_id": "n1", "hostname": "h", "role": "terminal", "ip_address": "1.2.3.4"}
    H.write_package(t.anomalies, t.logs, node, "hub", str(tmp_path / "p"), "pk", dt.datetime(2024, 2, 1))
    rows, nodes = H.read_sync_packages(spark, str(tmp_path / "p"))
    want = {(r.id, r.anomaly_score, r.severity, r.message) for r in H.package_rows(t.anomalies, t.logs).collect()}
    assert {(r.id, r.anomaly_score, r.severity, r.message) for r in rows.collect()} == {(*x[:3], x[3] or "") for x in want}
    n = nodes.first()
    assert (n.package_id, n.hostname, n.total_logs, n.total_anomalies) == ("pk", "h", t.logs.count(), t.anomalies.count())


def test_equal_files_of_a_batch_are_registered_once(spark, tmp_path):
    from sparklog.sources import logfiles as LF
    for name, text in (("A b.log", "same"), ("z.log", "same"), ("c.log", "other")):
        (tmp_path / name).write_text(text)
    got = LF.register_datasets(spark, str(tmp_path)).collect()
    assert sorted(r.filename.replace("%20", " ") for r in got) == ["A b.log", "c.log"]
    assert LF.register_datasets(spark, str(tmp_path), spark.createDataFrame([(got[0].sha256,)], "sha256 string")).count() == 1


def test_guard_looks_outside_literals_and_at_functions(spark):
    assert FL.validate_select("SELECT id FROM logs WHERE message = 'failed to SET; -- x'")
    for bad in ("SELECT reflect('java.lang.System','getProperty','user.dir')", "SELECT * FROM parquet.`/tmp/x`",
                "SELECT 1; SELECT 2", "SELECT * FROM logs -- x"):
        with pytest.raises(ValueError):
            FL.validate_select(bad)


def test_two_snapshots(spark):
    from sparklog.operators import devices as DV
    a, b = (spark.createDataFrame([(i,) for i in ids], "device_id string") for ids in ("xy", "yz"))
    assert sorted(map(tuple, DV.snapshot_diff(a, b).collect())) == [("x", "disconnected"), ("z", "connected")]


def test_append_raises_on_a_damaged_table(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "part-0.parquet").write_bytes(b"not parquet")
    rows = spark.range(3).select(F.lit(None).cast("timestamp").alias("timestamp"), F.col("id").alias("line_number"))
    with pytest.raises(Exception):
        SK.append_logs(rows, str(tmp_path / "logs"))


def test_tables_are_read_where_they_are(spark, tmp_path):
    from sparklog.sources.testdata import tables
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.limit(700).write.parquet(str(tmp_path / "events.parquet"))
    assert tables(spark, str(tmp_path)).events.count() == 700
    ev.limit(300).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    assert tables(spark, str(tmp_path)).events.count() == 300


@pytest.mark.parametrize("bad", [
    "SELECT 1 AS `a'`, reflect('java.lang.System','getProperty','user.dir') AS `b'`", "SELECT * FROM image.`/etc`", "SELECT * FROM `parquet`.`/tmp/x`",
    "SELECT * FROM libsvm.`/etc/passwd`", "SELECT (SELECT java_method('java.lang.System','getProperty','x'))", "SELECT * FROM (SELECT * FROM text.`/etc`) x",
    "SELECT 1 WHERE EXISTS (SELECT * FROM csv.`/etc/passwd`)", "SELECT id FROM logs WHERE id IN (SELECT value FROM text.`/etc`)",
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM logs", "SELECT * FROM IDENTIFIER('text.`/etc`')", "SELECT IDENTIFIER('reflect')('a','b')",
    "SELECT input_file_name() FROM logs", "SELECT system.builtin.reflect('a','b')", "SELECT nosuchfunction(1)", "SELECT * FROM nosuchtable(1)", "SELECT FROM WHERE (",
    "SELECT x FROM logs LATERAL VIEW reflect('a','b') v AS x", "SELECT 1 UNION SELECT * FROM avro.`/x`"])
def test_guard_reads_the_parsed_plan(spark, bad):
    with pytest.raises(ValueError):
        FL.validate_select(bad)


@pytest.mark.parametrize("good", [
    "SELECT 'reflect(1); -- DROP /* x */' AS a", "SELECT `a'b` FROM (SELECT 1 AS `a'b`) t", "SELECT \"SET parquet.`/x`\" AS s;",
    "SELECT source, count(*) n, rank() OVER (ORDER BY count(*)) r FROM logs GROUP BY source HAVING count(*) > 1 ORDER BY n DESC LIMIT 5",
    "SELECT l.id FROM logs l LEFT JOIN logs m ON l.id = m.id WHERE l.id IN (SELECT max(id) FROM logs) AND NOT EXISTS (SELECT 1 FROM logs WHERE id < 0)",
    "SELECT x FROM logs LATERAL VIEW explode(array(1, 2)) v AS x", "SELECT * FROM range(3)", "SELECT CASE WHEN id > 1 THEN CAST(id AS string) END FROM logs",
    "SELECT a FROM VALUES (1), (2) AS t(a) UNION ALL SELECT 3", "SELECT DISTINCT upper(source) FROM default.logs", "SELECT filter(array(1, 2), v -> v > 1)"])
def test_guard_lets_queries_pass(spark, good):
    assert FL.validate_select(good) == good.rstrip(";")


def test_guarded_sql(spark, t):
    t.logs.createOrReplaceTempView("logs")
    assert FL.guarded_sql(spark, "SELECT id FROM logs").count() <= 1000
    assert FL.guarded_sql(spark, "select count(*) AS n from logs LIMIT 1").first().n == t.logs.count()
    for bad in ["", "DROP TABLE logs", "SELECT 1; DELETE FROM logs", "SELECT * FROM logs -- x",
                "SELECT * FROM logs WHERE 1=1 UNION SELECT * FROM (INSERT INTO x VALUES (1))",
                "ATTACH 'x' AS y"]:
        with pytest.raises(ValueError):
            FL.validate_select(bad)


def test_technique_lookups(t):
    assert [r.tactic for r in M.all_tactics(t.techniques).collect()] == sorted(
        {r.tactic for r in t.techniques.collect()})
    names = [r.technique_name for r in M.techniques_by_tactic(t.techniques, "execution").collect()]
    assert names == sorted(names) and "PowerShell" in names
    assert [r.technique_id for r in M.search_techniques(t.techniques, "Account").collect()] == \
        ["T1136", "T1078.002", "T1078"]   # Create Account, Domain Accounts, Valid Accounts (name order)
    assert FL.lookup_key(t.techniques, "technique_id", "T1110").first().technique_name == "Brute Force"


def _mapped_by_loop(logs, rules, tactics):
    """id -> ordered (technique, tactic) list of the rules that a log meets."""
    live = sorted((o, k, kind, t) for o, kind, k, t in rules if t in tactics)
    out = {}
    for i, eid, message, event_type in logs:
        text = (message or "").lower() + " " + (event_type or "").lower()
        hits = [t for o, k, kind, t in live if (eid == k if kind == "event_id" else k in text)]
        out[i] = list(dict.fromkeys(hits))
    return out


def _check_mapping(spark, logs, rules, tactics):
    df = spark.createDataFrame(logs, "id long, event_id string, message string, event_type string")
    tech = spark.createDataFrame(list(tactics.items()), "technique_id string, tactic string")
    rdf = spark.createDataFrame(rules, M.RULE_SCHEMA)
    want = _mapped_by_loop(logs, rules, tactics)
    got = {r.id: r.techniques for r in M.technique_list(df, tech, rdf).collect()}
    assert got == want
    first = {r.id: (r.mitre_technique_id, r.mitre_tactic) for r in M.map_techniques(df, tech, rdf).collect()}
    assert first == {i: (x[0], tactics[x[0]]) if x else (None, None) for i, x in want.items()}


def test_technique_mapping_of_fifty_thousand_rules_equals_a_loop(spark):
    rnd = random.Random(5)
    word = lambda a, b, abc="abcdeé ": "".join(rnd.choice(abc) for _ in range(rnd.randint(a, b)))
    keys = sorted({word(3, 12) for _ in range(60_000)})[:50_000]
    rnd.shuffle(keys)
    rules = [(i, "keyword", k, f"T{i % 700}") for i, k in enumerate(keys, 1)] + [(0, "event_id", str(i), f"T{i}") for i in range(0, 900, 3)]
    logs = [(i, rnd.choice([None, "", str(rnd.randrange(1200))]), rnd.choice([None, "", word(0, 60, "ABcdeé xyz"), word(10, 120)]),
             rnd.choice([None, word(0, 9)])) for i in range(400)]
    _check_mapping(spark, logs, rules, {f"T{i}": f"tactic{i % 9}" for i in range(650)})


@pytest.mark.parametrize("keys", [[""], ["a", "é"], ["su", "\U0001f600x", "a.c", "%_"], [], ["error", "err", "rror", "ERROR"]])
def test_technique_mapping_of_short_empty_and_odd_keys(spark, keys):
    logs = [(1, None, None, None), (2, "7", "su \U0001f600X", "A.C"), (3, "8", "abc Error %_", ""), (4, "", "é" * 3000 + "tail", "x")]
    rules = [(i, "keyword", k, f"T{i}") for i, k in enumerate(keys, 1)] + [(0, "event_id", "8", "T99")] + [(9, "keyword", "tail", "T5")] * len(keys)
    _check_mapping(spark, logs, rules, {f"T{i}": "x" for i in (1, 2, 3, 4, 5, 99)})


def test_technique_mapping_plan_sends_only_candidates(t):
    """The default rules: no nested loop, and only grams of the index leave the scan."""
    plan = M.map_techniques(t.logs, t.techniques)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_few_rules_are_tested_in_the_scan_and_equal_the_joins(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda a, b: "".join(rnd.choice("abc é") for _ in range(rnd.randint(a, b)))
    # ids repeat (with other texts) or are null; rules share an order, a key or a technique
    logs = spark.createDataFrame([(rnd.choice([None, *range(150)]), rnd.choice([None, "1", "2"]), rnd.choice([None, word(0, 30)]), rnd.choice([None, word(0, 5)]))
                                  for _ in range(400)], "id long, event_id string, message string, event_type string")
    keywords = {(i % 9, word(0, 4)): f"T{i % 7}" for i in range(30)} | {(None, "a"): "T3"}
    rules = spark.createDataFrame([(o, "keyword", k, x) for (o, k), x in keywords.items()]
                                  + [(0, "event_id", "1", "T1"), (5, "event_id", "2", "T2"), (1, "other", "a", "T4")], M.RULE_SCHEMA)
    tech = spark.createDataFrame([(f"T{i}", f"x{i}") for i in range(6)], "technique_id string, tactic string")

    def found():
        mapped = M.map_techniques(logs, tech, rules)
        met = M.matching_rules(logs, M.resolved_rules(rules, tech))
        return mapped, sorted(map(str, mapped.collect())), sorted(map(str, met.collect()))
    plan, direct, met = found()
    assert "Generate" not in plan._jdf.queryExecution().toString()
    monkeypatch.setattr(M, "DIRECT_RULES", 0)
    assert found()[1:] == (direct, met)


def test_mapping_is_done_after_the_logs_are_dealt_out(t):
    """Nothing of the rules is pushed below the exchange that spreads a table's few splits."""
    plan = M.map_techniques(t.logs.repartition(3), t.techniques)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    tested = [i for i, x in enumerate(plan) if "Contains(" in x]
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    assert tested
    for i in tested:   # an exchange stands below each test, in the branch of that test
        under = [x for k, x in enumerate(plan[i + 1:], i + 1) if depth[k] > depth[i]]
        assert any("Repartition 3" in x for x in under), plan[i]


@pytest.mark.parametrize("sizes, cores, parts", [([], 4, None), ([10, 10, 10, 10], 4, None), ([100, 0, 0, 0], 4, 4), ([30, 10, 10, 10], 4, 4), ([14, 10, 10, 10], 4, None),
                                                 ([6_000_000], 12, 24), ([3_000_000] * 12, 12, 144), ([250_000] * 24, 12, None)])
def test_uneven_or_large_splits_are_dealt_out(sizes, cores, parts):
    assert TD.dealt_parts(sizes, cores) == parts


def test_a_table_of_one_row_group_is_spread_over_tasks(spark, tmp_path, monkeypatch):
    n = 40_000
    spark.range(n).selectExpr("id", "uuid() AS v").coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    monkeypatch.setattr(TD, "ROWS_PER_TASK", 5_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        plain = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert plain.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and max(TD.split_sizes(plain)) == n
        got = TD.tables(spark, str(tmp_path)).raw("one")
        sizes = TD.split_sizes(got)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == n and max(sizes) <= 10_000


def test_heatmap_replays_the_hub_once(t):
    plan = t.hub_anomalies._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Join Inner") == 1   # the batches are copies of one join
    heat = H.tactic_heatmap_long(H.hub_state(t.hub_anomalies))
    assert "event_id" not in heat._jdf.queryExecution().optimizedPlan().toString()   # reads the counts, not the events
    rows = {(r.source_node, r.mitre_tactic): r["count"] for r in heat.collect()}
    want = {(r.source_node, r.mitre_tactic): r["count"] for r in H.hub_state(t.hub_anomalies).filter("mitre_tactic IS NOT NULL")
            .groupBy("source_node", "mitre_tactic").count().collect()}
    assert {k: v for k, v in rows.items() if v} == want
    assert len(rows) == len({k[0] for k in want}) * len({k[1] for k in want})


def test_exports_and_idempotent_load(spark, t, tmp_path):
    SK.export_result(t.logs.select("id", "source"), str(tmp_path / "csv"), "csv", limit=10)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10
    SK.export_result(t.logs.select("id"), str(tmp_path / "js"), "json", limit=7)
    assert spark.read.json(str(tmp_path / "js")).count() == 7
    rows = t.logs.select("id", F.lit("ds1").alias("dataset_id"))
    assert SK.idempotent_load(rows, str(tmp_path / "ds")).count() == t.logs.count()
    assert SK.idempotent_load(rows, str(tmp_path / "ds")).count() == 0


def test_report_bundle_and_metadata(spark, t, tmp_path):
    summ = t.anomalies.agg(F.count(F.lit(1)).alias("n"))
    root = SK.write_report_bundle(summ, t.anomalies.select("id", "severity"), summ, str(tmp_path), "r1")
    fp = SK.bundle_fingerprint(spark, root).first()
    assert fp.files >= 3 and len(fp.bundle_sha256) == 64
    meta = spark.createDataFrame([("r1", dt.datetime(2024, 1, 2), '["a.csv","b.json"]'),
                                  ("r2", dt.datetime(2024, 1, 3), "[]")], "report_id string, created_at timestamp, files string")
    got = SK.report_metadata(meta).collect()
    assert [r.report_id for r in got] == ["r2", "r1"] and got[1].files == ["a.csv", "b.json"]


def test_retention_null_predicate_keeps_row(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, dt.datetime(2024, 1, 5), "a")],
                               "id int, timestamp timestamp, source string")
    keep, gone = FL.retention_split(df, start=dt.datetime(2024, 1, 1))
    assert [r.id for r in keep.collect()] == [1] and [r.id for r in gone.collect()] == [2]


def test_related_session(spark, t):
    from sparklog.operators import reports as RP
    assert RP.related_session(t.sessions, "sshd").first().session_id == "s1"      # same source wins
    assert RP.related_session(t.sessions, "nginx").first().session_id == "s3"     # else the latest completed


def test_bucketed_session_join_equals_a_loop(t):
    from sparklog.operators import joins as J
    from sparklog.sources.testdata import AS_OF
    a = t.anomalies.select("id", "detected_at")
    small = {(r.id, r.session_id) for r in J.assign_sessions(a, t.sessions, AS_OF).collect()}
    ends = [(s.session_id, s.start_time, s.end_time or AS_OF) for s in t.sessions.collect()]
    big = {(r.id, i) for r in a.collect() for i, lo, hi in ends if lo <= r.detected_at <= hi}
    assert small == big and len(small) > 0


def test_report_periods(spark):
    from sparklog.operators import aggregations as A
    s = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 3, 4, 5)), ("b", dt.datetime(2024, 1, 3), None)],
                              "session_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    assert {r.session_id: r.analysis_period for r in A.report_periods(s).collect()} == {
        "a": "2024-01-01 00:00:00 to 2024-01-02 03:04:05", "b": "2024-01-03 00:00:00 to Present"}


def test_entry_without_the_optional_packages():
    """Queries of the library stay when the optional subpackage can't be imported."""
    code = ("import sys; sys.modules['ahocorasick'] = sys.modules['zstandard'] = sys.modules['public_tokenizers'] = None; sys.modules['sparklog.llm'] = None\n"
            "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), len(e.oracle_sql()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) >= 129, out.stderr
