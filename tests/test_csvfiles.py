"""CSV records over lines and splits against Python's csv module."""
from __future__ import annotations

import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparklog.sources import csvfiles as CSV
from sparklog.sources import logfiles as LF


def expected(path):
    with open(path, encoding="utf-8", errors="ignore", newline="") as f:
        return [r for r in csv.reader(f) if r]


def got(spark, path):
    rows = CSV.csv_records(CSV.csv_lines(spark, path)).select("file_path", "line_number", "sub", CSV.csv_fields(F.col("record")).alias("v")).collect()
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.line_number, r.sub)):
        out.setdefault(r.file_path.rsplit("/", 1)[-1], []).append(r.v)
    return out


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_random_files_in_small_splits_equal_the_csv_module(spark, tmp_path, small_splits):
    rnd = random.Random(17)
    bits = ['"', '"', '""', ",", ",", "\n", "\n", "\r\n", "a", "b c", " ", "é漢", "x" * 30, "'", '","', '"\n', "\\"]
    for k in range(30):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 250)))
        # the csv module refuses text after a lone carriage return; unclosed fields keep the file's last line end there
        (tmp_path / f"f{k}.csv").write_bytes(text.rstrip("\r\n").encode() or b"x")
    for k in range(30, 45):   # well-formed files with many line ends in fields
        rows = [[rnd.choice(["", "a", 'q"q', "two\nlines", "cr\r\nlf", "1,2", "z" * 40, "\n\n"]) for _ in range(4)] for _ in range(60)]
        with open(tmp_path / f"f{k}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator=rnd.choice(["\n", "\r\n"])).writerows(rows)
    (tmp_path / "mac.csv").write_bytes(b'a,b\r1,"x\ry"\r2,z')
    found = got(spark, str(tmp_path))
    for p in sorted(tmp_path.glob("*.csv")):
        assert found.get(p.name, []) == expected(p), p.read_bytes()


def test_logs_with_messages_over_lines_and_the_report(spark, tmp_path):
    now = dt.datetime(2024, 1, 31)
    (tmp_path / "a.csv").write_text('timestamp,severity,message,source\n2024-01-01 10:00:00,HIGH,"Traceback:\n  line ""1""\n\n  line 2",db\n'
                                    '2024-01-01 10:00:01,LOW,plain,db\n')
    rows = LF.read_csv_logs(spark, str(tmp_path), now).orderBy("line_number").collect()
    assert [(r.line_number, r.severity, r.message, r.source) for r in rows] == [
        (2, "HIGH", 'Traceback:\n  line "1"\n\n  line 2', "db"), (6, "LOW", "plain", "db")]
    (report,) = LF.ingest_report(spark, str(tmp_path), now).collect()
    assert (report.format, report.parsed, report.errors, report.status) == ("csv", 2, 0, "ok")


def test_a_quote_that_never_closes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CSV, "RECORD_LIMIT", 500)
    (tmp_path / "a.csv").write_text("h,i\n1,2\n" + '3,"open\n' + "line,of,text\n" * 200)
    assert got(spark, str(tmp_path)) == {"a.csv": [["h", "i"], ["1", "2"]]}
