"""Streaming operators: stream vs batch parity, state across micro-batches, bounded buffers."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from sparklog.streaming import live as L

AS_OF = dt.datetime(2024, 1, 31, 12, 0)


def test_quick_score_tiers(spark):
    df = spark.createDataFrame([("Failed password for root",), ("connection refused",), ("sudo ok",),
                                ("session opened",), ("hello",)], "line string").withColumn("source_file", F.lit("f"))
    got = [round(r.anomaly_score, 6) for r in L.score_lines(df, AS_OF).collect()]
    assert got == [0.95, 0.72, 0.55, 0.25, 0.2]
    night = L.score_lines(df, dt.datetime(2024, 1, 31, 23, 0)).collect()
    assert [round(r.anomaly_score, 6) for r in night] == [1.0, 0.82, 0.65, 0.35, 0.3]
    assert [r.event for r in night] == ["anomaly", "anomaly", "new_log", "new_log", "new_log"]


def test_line_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("<13>Jan  5 10:00:00 h1 sshd[1]: Failed password\n\nplain error here\n")
    (src / "b.log").write_text("<34>1 2024-01-01T10:00:00Z host1 su - ID47 - 'su root' failed\n")
    stream = L.score_lines(L.line_stream(spark, str(src)), AS_OF)
    out = L.run_to_completion(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted((r.source_file, r.message, r.severity) for r in out.collect())
    assert got == [("a.log", "Failed password", "CRITICAL"), ("a.log", "plain error here", "HIGH"),
                   ("b.log", "'su root' failed", "HIGH")]


def test_device_pairing_state_spans_batches(spark, tmp_path):
    rows1 = [("d1", dt.datetime(2024, 1, 1, 10), "connected", 1), ("d2", dt.datetime(2024, 1, 1, 10), "disconnected", 2)]
    rows2 = [("d1", dt.datetime(2024, 1, 1, 10, 0, 1, 500000), "disconnected", 3)]
    schema = "device_id string, event_time timestamp_ntz, event string, seq long"
    d = tmp_path / "dev"
    spark.createDataFrame(rows1, schema).coalesce(1).write.parquet(str(d / "p1"))
    spark.createDataFrame(rows2, schema).coalesce(1).write.parquet(str(d / "p2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(str(d))
    out = L.run_pairing(stream, L.DevicePairing(str(tmp_path / "out")), str(tmp_path / "ck"))
    got = {r.seq: (r.device_id, r.connected_at, r.duration_seconds) for r in out.collect()}
    assert got[2] == ("d2", None, None)
    assert got[3] == ("d1", dt.datetime(2024, 1, 1, 10), 1.5)


def test_device_pairing_of_shuffled_events_equals_the_batch_join(spark, tmp_path):
    from sparklog.operators import joins as J
    rnd, rows, t0 = random.Random(4), [], dt.datetime(2024, 1, 1)
    for i in range(400):
        rows.append((f"d{rnd.randrange(3)}", t0 + dt.timedelta(seconds=30 * i), rnd.choice(["connected", "disconnected"]), i))
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.randint(0, 50)))  # out of order by less than the delay
    schema = "device_id string, event_time timestamp_ntz, event string, seq long"
    for k in range(8):  # eight files, one per micro-batch
        spark.createDataFrame(late[k * 50:(k + 1) * 50], schema).coalesce(1).write.parquet(str(tmp_path / f"dev/p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "dev"))
    out = L.run_pairing(stream, L.DevicePairing(str(tmp_path / "out")), str(tmp_path / "ck"))
    want = J.latest_connect_asof(spark.createDataFrame(rows, schema))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_recent_buffer_keeps_newest(spark, tmp_path):
    buf = L.RecentBuffer(str(tmp_path / "buf"), ["seq"], size=5)
    for epoch, lo in enumerate((0, 3, 10)):
        buf(spark.range(lo, lo + 4).withColumnRenamed("id", "seq"), epoch)
    assert [r.seq for r in buf.snapshot(spark).collect()] == [13, 12, 11, 10, 6]
    assert [r.seq for r in buf.snapshot(spark, 2).collect()] == [13, 12]
    ring = L.metric_ring(str(tmp_path / "ring"), ["seq"])
    for epoch in range(6):  # older versions go
        ring(spark.range(epoch * 1000, (epoch + 1) * 1000).withColumnRenamed("id", "seq"), epoch)
    assert ring.snapshot(spark).count() == 3600 and ring.snapshot(spark).agg(F.min("seq")).first()[0] == 2400
    assert len([p for p in (tmp_path / "ring").iterdir() if p.name.startswith("v=")]) == 3


def test_logs_per_hour_stream_equals_batch(spark, sf_small, tmp_path):
    from sparklog.operators import aggregations as A
    from sparklog.sources import testdata as TD
    schema = spark.read.parquet(f"{sf_small}/events.parquet").schema
    logs_s = TD.derive_logs(L.table_stream(spark, sf_small, "events.parquet", schema))
    s = L.run_updates(L.logs_per_hour_stream(logs_s), ["hour"], str(tmp_path / "out"), str(tmp_path / "ck"))
    b = A.logs_by_hour(TD.derive_logs(spark.read.parquet(f"{sf_small}/events.parquet")))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect()))


def test_timeline_stream_buckets(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 30, 2, 5), "CRITICAL"), (dt.datetime(2024, 1, 30, 3, 59), "HIGH"),
            (dt.datetime(2024, 1, 30, 4, 0), "critical")]
    src = tmp_path / "an"
    spark.createDataFrame(rows, "detected_at timestamp_ntz, severity string").write.parquet(str(src))
    stream = spark.readStream.schema("detected_at timestamp_ntz, severity string").parquet(str(src))
    out = L.run_updates(L.timeline_stream(stream), ["bucket_start"], str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.bucket_start: (r.anomalies, r.critical) for r in out.collect()}
    assert got == {dt.datetime(2024, 1, 30, 2): (2, 1), dt.datetime(2024, 1, 30, 4): (1, 1)}


def test_on_event_callback_and_persist(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("Failed password for root\nall good\n")
    scored = L.score_lines(L.line_stream(spark, str(src)), AS_OF)
    seen = []
    q = L.on_event(scored, lambda df, epoch: seen.append(df.count()), str(tmp_path / "ck1"),
                   trigger={"availableNow": True})
    q.awaitTermination()
    assert sum(seen) == 2
    q2 = L.persist_stream(scored, str(tmp_path / "logs"), str(tmp_path / "ck2"), trigger={"availableNow": True})
    q2.awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "logs")).collect()
    assert [r.event_type for r in kept] == ["realtime"] and kept[0].message == "Failed password for root"
