"""Sinks (K01-K09): appends, idempotent loads, exports, reports, bundle fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R
from ..operators import stats
from ..session import path_exists


def append_logs(parsed: DataFrame, table_path: str, current_max_id: int | None = None,
                order_cols=("file_path", "line_number")) -> DataFrame:
    """Assign ids max(id)+1... in file/line order and append, partitioned by event_date.

    Ids come from distributed row positions (no single-task window); columns a
    record lacks become NULL through ``unionByName(allowMissingColumns=True)``.
    Returns the appended rows.
    """
    spark = parsed.sparkSession
    if current_max_id is None:
        # only a table that is not there starts at 1; a table that can't be read raises
        current_max_id = spark.read.parquet(table_path).agg(F.max("id")).first()[0] or 0 if path_exists(spark, table_path) else 0
    cols = [F.col(c) for c in order_cols if c in parsed.columns]
    pos = stats.row_positions(parsed, cols, "_pos")
    out = (pos.withColumn("id", (F.lit(current_max_id + 1) + F.col("_pos")).cast("bigint")).drop("_pos")
              .withColumn("ingestion_time", F.current_timestamp())
              .withColumn("event_date", F.to_date("timestamp")))
    out.write.mode("append").partitionBy("event_date").parquet(table_path)
    return out


def idempotent_load(rows: DataFrame, table_path: str, key: str = "dataset_id") -> DataFrame:
    """Append only datasets the table does not hold yet (anti join on the dataset id)."""
    spark = rows.sparkSession
    new = rows
    if path_exists(spark, table_path):
        new = rows.join(spark.read.parquet(table_path).select(key).distinct(), key, "left_anti")
    new.write.mode("append").partitionBy(key).parquet(table_path)
    return new


def export_result(df: DataFrame, path: str, fmt: str = "csv", limit: int | None = None) -> None:
    """Query result to CSV (header) or JSON; ``limit`` cuts it (the reference's export stops at 1,000,000)."""
    out = df if limit is None else df.limit(limit)
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        out.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unsupported export format {fmt}")


def anomaly_report_rows(joined: DataFrame) -> DataFrame:
    """Report columns — score rounded to 4, optional text NULL -> '', message cut to 200."""
    def opt(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    return joined.select(
        F.col("id").alias("ID"),
        F.col("log_timestamp").cast("string").alias("Timestamp"),
        opt("source").alias("Source"),
        opt("event_type").alias("Event Type"),
        opt("severity").alias("Severity"),
        X.round_to("anomaly_score", 4).alias("Score"),
        opt("algorithm").alias("Algorithm"),
        opt("mitre_technique_id").alias("MITRE Technique"),
        opt("mitre_tactic").alias("MITRE Tactic"),
        opt("hostname").alias("Hostname"),
        opt("username").alias("Username"),
        F.substring(opt("message"), 1, R.CAP_REPORT_MESSAGE).alias("Message"),
    )


def write_report_bundle(summary: DataFrame, anomalies: DataFrame, ai_analysis: DataFrame, base: str,
                        report_id: str) -> str:
    """Summary.json, anomalies.csv, ai_analysis.json and integrity.json (every member's sha256) under
    ``base/report_id=<id>``."""
    root = f"{base}/report_id={report_id}"
    summary.coalesce(1).write.mode("overwrite").json(f"{root}/summary.json")
    anomalies.write.mode("overwrite").option("header", True).csv(f"{root}/anomalies.csv")
    ai_analysis.coalesce(1).write.mode("overwrite").json(f"{root}/ai_analysis.json")
    member_hashes(summary.sparkSession, root).write.mode("overwrite").json(f"{root}/integrity.json")
    return root


def member_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(member, sha256, bytes) of a bundle's data files; a member is the file's folder (part names are random)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    member = F.element_at(F.split("path", "/"), -2)
    return files.select(member.alias("member"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")) \
        .where("member != 'integrity.json'")


def bundle_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """sha256 over the members' sha256 values in (member, sha256) order (one row): equal bundles are equal."""
    files = member_hashes(spark, root)
    return files.agg(F.sha2(F.concat_ws("", F.transform(
        F.array_sort(F.collect_list(F.struct("member", "sha256"))), lambda s: s["sha256"])), 256).alias("bundle_sha256"),
        F.count(F.lit(1)).alias("files"))


def append_report_metadata(reports: DataFrame, path: str) -> None:
    """Appends report rows (``files`` as an array is stored as JSON text)."""
    kind = dict(reports.dtypes)["files"]
    rows = reports if kind == "string" else reports.withColumn("files", F.to_json("files"))
    rows.write.mode("append").parquet(path)


def report_metadata(reports: DataFrame) -> DataFrame:
    """Reports newest first with the file list decoded to an array."""
    return reports.withColumn("files", F.from_json("files", "array<string>")).orderBy(F.desc("created_at"))


def stream_persist_rows(scored_stream: DataFrame) -> DataFrame:
    """Stream rows scoring >= .55 as 'realtime' log rows."""
    return (scored_stream.filter(F.col("anomaly_score") >= R.STREAM_PERSIST_SCORE)
            .select(F.current_timestamp().alias("timestamp"),
                    F.coalesce("source", "source_file").alias("source"),
                    F.coalesce("message", "raw").alias("message"),
                    F.lit("realtime").alias("event_type"), "severity", "hostname",
                    F.col("raw").alias("raw_data"),
                    F.to_json(F.struct(F.lit(True).alias("stream"), F.col("anomaly_score").alias("score"))).alias("metadata")))
