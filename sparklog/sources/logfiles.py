"""Log file sources (S01-S11): text, CSV, JSON lines, key=value, Windows event XML.

Files are read by Spark's file sources (splittable, distributed); nothing reads a
file on the driver.  Line numbers are exact per file even when a file is split
over many tasks: rows keep their order inside a split, so a line's number is its
position in its split plus the line count of the file's earlier splits (a table
with one row per split, joined back).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import parse as P
from . import csvfiles as CSV

MEDIA_SUFFIXES = (".evtx", ".log", ".syslog", ".txt")

# the parts of an exported Windows event the parser reads (missing parts are NULL)
EVENT_XML_SCHEMA = ("System struct<Provider: struct<_Name: string>, EventID: string, Level: string, "
                    "TimeCreated: struct<_SystemTime: string>, Computer: string>, "
                    "EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>, "
                    "RenderingInfo struct<Message: string>")


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = True, glob: str | None = None,
               ignore_corrupt: bool = True) -> DataFrame:
    """S01 + S02: (file_path, line_number, line) of every non-blank line, stripped.

    ``line_number`` counts every physical line of the file from 1, blank ones too,
    as the reference's enumerate does.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()) \
        .option("ignoreCorruptFiles", str(ignore_corrupt).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
        F.col("value").alias("_raw"))
    splits = raw.groupBy("file_path", "_blk").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    offs = splits.select("file_path", "_blk", "_m0", F.coalesce(F.sum("_n").over(
        W.partitionBy("file_path").orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = raw.join(offs, ["file_path", "_blk"])  # one row per file split: Spark broadcasts it while it is small
    line = P.strip(P.clean_utf8(F.col("_raw")))
    return (numbered.select("file_path",
                            (F.col("_o") + F.col("_mid") - F.col("_m0") + 1).cast("bigint").alias("line_number"),
                            line.alias("line"))
            .filter(F.col("line") != ""))


def media_files(spark: SparkSession, path: str, min_bytes: int = 100) -> DataFrame:
    """S02 media variant: .evtx/.log/.syslog/.txt files larger than ``min_bytes`` (metadata only)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path) \
        .select("path", "length", "modificationTime")
    cond = None
    for s in MEDIA_SUFFIXES:
        c = F.lower("path").endswith(s)
        cond = c if cond is None else cond | c
    return files.filter(cond & (F.col("length") > min_bytes))


# FIXED VALUE: signature of a Windows event log file
EVTX_MAGIC = b"ElfFile\x00"


def evtx_files(spark: SparkSession, path: str) -> DataFrame:
    """S08, EVTX branch: files named *.evtx whose first 8 bytes are the event-log signature.

    (Decoding the binary chunks is out of scope — see README; exported event XML is
    read by ``read_windows_events``.)
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.[eE][vV][tT][xX]").load(path)
    return files.filter(F.substring("content", 1, 8) == F.lit(bytearray(EVTX_MAGIC))) \
        .select("path", "length", "modificationTime")


def detect_formats(lines: DataFrame, explicit: str | None = None) -> DataFrame:
    """S08 + S09: per file 'evtx' | 'syslog' | 'csv' | 'text'.

    One aggregate over the first lines of each file: syslog when any of the
    first 10 lines matches a syslog pattern, CSV by suffix or header sniff, else
    text when the file has any non-blank line.  ``explicit`` overrides.
    """
    head = lines.filter(F.col("line_number") <= 25)
    first = F.min_by("line", "line_number")
    is_sys = (F.col("line_number") <= 10) & (F.col("line").rlike(P.RFC5424) | F.col("line").rlike(P.RFC3164)
                                             | F.col("line").rlike(P.SIMPLE))
    g = head.groupBy("file_path").agg(F.max(is_sys.cast("int")).alias("_sys"), first.alias("_first"),
                                      F.count(F.lit(1)).alias("_n"))
    fl = F.lower(F.col("_first"))
    csv_sniff = (~F.col("_first").startswith("{") & ~F.col("_first").startswith("[") & F.col("_first").contains(",")
                 & (fl.contains("timestamp") | fl.contains("time") | fl.contains("message") | fl.contains("level")
                    | fl.contains("severity")))
    suffix = F.lower(F.col("file_path"))
    fmt = (F.when(suffix.endswith(".evtx"), F.lit("evtx"))
           .when(F.col("_sys") == 1, F.lit("syslog"))
           .when(suffix.endswith(".csv") | suffix.endswith(".tsv") | csv_sniff, F.lit("csv"))
           .when(F.col("_n") > 0, F.lit("text")))
    if explicit:
        fmt = F.lit({"txt": "text", "plaintext": "text", "plain": "text", "generic": "text"}.get(explicit, explicit))
    return g.select("file_path", fmt.alias("format"))


def parse_files(spark: SparkSession, path: str, as_of: _dt.datetime, parser: str | None = None) -> DataFrame:
    """Ingest a folder of logs: detect each file's format and parse its lines.

    Syslog files go through P01-P04 (unmatched lines dropped), text files through P15, CSV files
    through their own header (S03).  Files without a row here are listed by ``ingest_report``.
    """
    lines = read_lines(spark, path)
    formats = detect_formats(lines, parser)
    j = lines.join(formats, "file_path")
    src = F.element_at(F.split(F.col("file_path"), "/"), -1)
    sys_rows = P.parse_syslog(j.filter(F.col("format") == "syslog").drop("format"), as_of)
    txt = j.filter(F.col("format") == "text").drop("format").withColumn("source_name", src)
    txt_rows = P.parse_plaintext(txt, as_of).drop("source_name")
    csv_files = formats.filter(F.col("format") == "csv").select("file_path")
    csv_rows = parse_csv_records(CSV.csv_records(CSV.csv_lines(spark, path).join(csv_files, "file_path", "left_semi")), as_of)
    return (sys_rows.drop("priority", "facility").unionByName(txt_rows, allowMissingColumns=True)
            .unionByName(csv_rows, allowMissingColumns=True))


def parse_csv_records(records: DataFrame, as_of: _dt.datetime) -> DataFrame:
    """S03 over (file_path, line_number, record, sub) of CSV files: every file by the names in its own first record.

    Fields beyond the header are dropped, missing ones are NULL; ``line_number`` is that of a record's first line.
    """
    place = F.struct("line_number", "sub")
    heads = records.groupBy("file_path").agg(F.min(place).alias("_first"), F.min_by("record", place).alias("_head"))
    j = records.join(heads, "file_path").filter(place > F.col("_first"))
    names = F.transform(CSV.csv_fields(F.col("_head")), lambda c: P.strip(c))
    rows = j.select("file_path", "line_number", F.element_at(F.split("file_path", "/"), -1).alias("_src"),
                    names.alias("_n"), CSV.csv_fields(F.col("record")).alias("_v"))
    cells = F.transform("_n", lambda n, i: F.struct(n.alias("k"), F.nullif(F.get("_v", i), F.lit("")).alias("v")))
    m = F.map_from_entries(F.filter(cells, lambda e: e["k"].isNotNull() & (e["k"] != "")))
    return P.parse_maps(rows.withColumn("_map", m), as_of, "csv", ["file_path", "line_number"])


def read_csv_logs(spark: SparkSession, path: str, as_of: _dt.datetime) -> DataFrame:
    """CSV files (each by its own header, quoted fields over any number of lines) -> log fields via key aliases;
    '.tsv' files are read comma-delimited too."""
    return parse_csv_records(CSV.csv_records(CSV.csv_lines(spark, path)), as_of)


def ingest_report(spark: SparkSession, path: str, as_of: _dt.datetime, parser: str | None = None) -> DataFrame:
    """Per file of a folder: file_path, bytes, format, lines, parsed, errors, status.

    ``status`` is 'ok', 'no rows' (lines, but none parsed), 'unsupported' (binary event logs) or
    'unreadable' (bytes, but no line came back).  Spark's file listing leaves out files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("file_path"), F.col("length").alias("bytes"))
    lines = read_lines(spark, path)
    formats = detect_formats(lines, parser)
    counted = lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines")).join(formats, "file_path")
    # a CSV file's records, which may span lines
    csv_files = formats.filter(F.col("format") == "csv").select("file_path")
    records = (CSV.csv_records(CSV.csv_lines(spark, path).join(csv_files, "file_path", "left_semi"))
               .groupBy("file_path").agg(F.count(F.lit(1)).alias("records")))
    parsed = parse_files(spark, path, as_of, parser).groupBy("file_path").agg(F.count(F.lit(1)).alias("parsed"))
    n, p = F.coalesce("lines", F.lit(0)), F.coalesce("parsed", F.lit(0))
    body = F.coalesce(F.col("records") - 1, n)  # a header is no record
    evtx = F.lower("file_path").endswith(".evtx")
    return files.join(counted, "file_path", "left").join(parsed, "file_path", "left").join(records, "file_path", "left").select(
        "file_path", "bytes", F.when(evtx, "evtx").otherwise(F.col("format")).alias("format"), n.cast("bigint").alias("lines"),
        p.cast("bigint").alias("parsed"), F.when(evtx, F.lit(0)).otherwise(F.coalesce(body, F.lit(0)) - p).cast("bigint").alias("errors"),
        F.when(evtx, "unsupported").when(p > 0, "ok").when(n > 0, "no rows").otherwise("unreadable").alias("status"))


def read_windows_events(spark: SparkSession, path: str, as_of: _dt.datetime) -> DataFrame:
    """Exported Windows event XML (rowTag Event) -> log fields."""
    ev = (spark.read.format("xml").option("rowTag", "Event").option("valueTag", "_VALUE")
          .schema(EVENT_XML_SCHEMA).load(path))
    s = P.windows_event_fields(F.struct(*[F.col(c) for c in ev.columns]), as_of)
    return ev.select(s.alias("_s")).select("_s.*")


def register_datasets(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Dataset id = safe stem (32) + '_' + sha256[:12]; a registered sha keeps its first entry.

    Of equal files of one batch the first by path is registered.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    safe = F.substring(F.regexp_replace(F.lower(stem), "[^a-z0-9]", "_"), 1, 32)
    sha = F.sha2(F.col("content"), 256)
    new = files.select(F.concat(safe, F.lit("_"), F.substring(sha, 1, 12)).alias("dataset_id"),
                       name.alias("filename"), F.col("path").alias("file_path"), sha.alias("sha256"),
                       F.col("length").alias("size_bytes"), F.col("modificationTime").alias("uploaded_at"))
    first = new.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in new.columns if c != "sha256"]), "file_path").alias("_f"))
    new = first.select("sha256", "_f.*").select(*new.columns)
    if manifest is not None:
        new = new.join(manifest.select("sha256"), "sha256", "left_anti")
    return new


def dataset_inventory(files: DataFrame, datasets: DataFrame, logs: DataFrame) -> DataFrame:
    """Files newest first, left-joined to their dataset id and record count."""
    counts = logs.groupBy("dataset_id").agg(F.count(F.lit(1)).cast("bigint").alias("records"))
    j = files.join(datasets.select("file_path", "dataset_id"), files["path"] == datasets["file_path"], "left") \
        .join(counts, "dataset_id", "left")
    return j.orderBy(F.desc("modificationTime"))
