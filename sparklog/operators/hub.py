"""Multi-node hub: sync packages, idempotent merge, node registry, cross-node views.

(S12, K07, J08, J13, J15, A27-A32).  Merging is a key-level anti join against
what the hub already holds — the per-row existence check of the reference becomes
one shuffle on (original_id, source_node).  A node that contributes a third of
all rows is a hot key of that shuffle; AQE splits skewed partitions of the join,
and the aggregates below are partial/final, so the hot node is pre-aggregated on
the map side before anything is shuffled.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R
from ..session import materialized
from .joins import upsert

HUB_KEY = ["original_id", "source_node"]
ANOMALY_FIELDS = ["id", "anomaly_score", "severity", "algorithm", "mitre_technique_id", "mitre_tactic",
                  "timestamp", "source", "event_type", "message", "hostname", "username"]


def _n() -> Column:
    return F.count(F.lit(1)).cast("bigint")


PACKAGE_SCHEMA = "package_id string, source_node string, anomalies array<map<string,string>>, logs_summary map<string,string>"
#: Columns of the node registry that a package of a known node updates; a new node's row is inserted whole.
NODE_UPDATES = ["hostname", "status", "last_seen", "total_logs", "total_anomalies", "ip_address", "last_sync"]
NODE_FIELDS = ["node_id", "hostname", "role", "status", "last_seen", "total_logs", "total_anomalies", "ip_address", "last_sync"]


def _packages(spark: SparkSession, path: str) -> DataFrame:
    """One row per package file: its path, id (a file without one: the digest of its path), node, anomalies, summary."""
    pk = spark.read.schema(PACKAGE_SCHEMA).option("multiLine", True).json(path)
    return pk.select(F.col("_metadata.file_path").alias("package_path"), "package_id",
                     F.coalesce("source_node", F.lit("unknown")).alias("source_node"), "anomalies", "logs_summary") \
        .withColumn("package_id", F.coalesce("package_id", F.md5("package_path")))


def _package_nodes(packages: DataFrame) -> DataFrame:
    summary = F.col("logs_summary")
    return packages.filter(F.size(summary) > 0).select(
        "package_id", "package_path", "source_node", *[summary[c].alias(c) for c in ("node_id", "hostname", "role", "ip_address")],
        *[F.coalesce(summary[c].try_cast("bigint"), F.lit(0).cast("bigint")).alias(c) for c in ("total_logs", "total_anomalies")])


def read_sync_packages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sync-package JSON files -> (anomaly rows with package and source_node, node summaries).

    A field that an anomaly lacks gets its default (score 0, severity 'UNKNOWN', algorithm 'unknown', no
    node: 'unknown'); one that is there and null stays null.  A message is never null.
    """
    packages = _packages(spark, path)
    rows = packages.select("package_id", "package_path", "source_node", F.explode("anomalies").alias("_a"))
    a = F.col("_a")

    def field(name: str, default: str) -> Column:
        return F.when(F.map_contains_key(a, name), a[name]).otherwise(F.lit(default))

    fields = {"id": a["id"].try_cast("bigint"), "anomaly_score": field("anomaly_score", "0").try_cast("double"),
              "severity": field("severity", "UNKNOWN"), "algorithm": field("algorithm", "unknown"),
              "message": F.coalesce(a["message"], F.lit(""))}
    rows = rows.filter(a.isNotNull()).select(
        "package_id", "package_path", "source_node", *[fields.get(c, a[c]).alias(c) for c in ANOMALY_FIELDS])
    return rows, _package_nodes(packages)


def import_packages(spark: SparkSession, path: str, hub: DataFrame | None, nodes: DataFrame, imported_at: _dt.datetime,
                    this_node: str = "hub") -> tuple[DataFrame, DataFrame, DataFrame]:
    """S12 + J08 + J13 + J15: all package files under ``path`` -> (hub rows to append, nodes afterwards, sync log rows).

    Files count in path order: of an anomaly that several hold, the first keeps it; a node's last summary
    is its state.  A known node's row is updated (status 'inactive'), a new one inserted; ``last_sync`` and
    ``total_anomalies`` are those of the import.  The log has a row per file, with no anomalies too.
    """
    rows, summaries = read_sync_packages(spark, path)
    incoming = rows.select(F.col("package_path").alias("import_batch"), F.col("id").alias("original_id"), "source_node", "anomaly_score", "severity",
                           "algorithm", "mitre_technique_id", "mitre_tactic", F.col("timestamp").alias("log_timestamp"), "source", "event_type",
                           "message", "hostname", "username")
    # both results read the merge: written once
    merged = materialized(merge_into_hub(hub, incoming, imported_at), "hub-import")

    kept = merged.groupBy(F.col("import_batch").alias("package_path")).agg(_n().alias("anomalies_synced"))
    log = (_packages(spark, path).select(F.col("package_id").alias("sync_id"), "source_node", "package_path",
                                         F.coalesce(F.array_size("anomalies"), F.lit(0)).cast("bigint").alias("total_in_package"))
           .join(kept, "package_path", "left")
           .select("sync_id", "source_node", F.lit(this_node).alias("target_node"), F.lit("usb").alias("sync_method"),
                   F.coalesce("anomalies_synced", F.lit(0)).cast("bigint").alias("anomalies_synced"), "total_in_package",
                   F.lit(imported_at).alias("synced_at"), "package_path"))

    fields = [c for c in NODE_FIELDS if c in summaries.columns and c != "node_id"]
    latest = (summaries.filter(F.col("node_id").isNotNull()).groupBy("node_id")
              .agg(F.max(F.struct("package_path", *fields)).alias("_n")).select("node_id", *[F.col(f"_n.{c}").alias(c) for c in fields])
              .withColumn("status", F.lit("inactive")).withColumn("last_seen", F.lit(imported_at)).withColumn("last_sync", F.lit(imported_at)))
    return merged.drop("import_batch"), upsert(nodes, latest, "node_id", NODE_UPDATES), log


def write_package(anomalies: DataFrame, logs: DataFrame, node: dict, target: str, path: str, package_id: str,
                  created_at: _dt.datetime, top: int = 500) -> None:
    """The package as a JSON file in folder ``path``, with ``node``'s fields in the summary; ``import_packages`` reads it."""
    package = export_package(anomalies, logs, node["node_id"], target, top)
    extra = [F.lit(v).alias(k) for k, v in node.items() if k != "node_id"]
    (package.withColumn("package_id", F.lit(package_id)).withColumn("created_at", F.lit(created_at))
     .withColumn("logs_summary", F.struct("logs_summary.*", *extra)).coalesce(1)
     .write.mode("overwrite").option("ignoreNullFields", "false").json(path))


def export_package(anomalies: DataFrame, logs: DataFrame, node_id: str, target: str, top: int = 500) -> DataFrame:
    """Top ``top`` anomalies by score joined to their logs, as one package row.

    The top-k is TakeOrderedAndProject (per-partition top-k, then a merge of at
    most partitions x k rows), so only ``top`` rows reach the single package row.
    """
    l = logs.select(F.col("id").alias("_lid"), "timestamp", "source", "event_type", "message", "hostname", "username")
    j = anomalies.join(l, anomalies["log_id"] == l["_lid"])
    top_rows = j.orderBy(F.desc("anomaly_score"), F.asc("id")).limit(top)
    packed = top_rows.agg(F.collect_list(F.struct(*[F.col(c) for c in ANOMALY_FIELDS])).alias("anomalies"))
    totals = logs.agg(_n().alias("total_logs")).crossJoin(anomalies.agg(_n().alias("total_anomalies")))
    return (packed.crossJoin(totals)
            .select(F.lit(node_id).alias("source_node"), F.lit(target).alias("target_node"),
                    F.lit("usb").alias("sync_method"), "anomalies",
                    F.struct(F.lit(node_id).alias("node_id"), "total_logs", "total_anomalies").alias("logs_summary")))


def package_rows(anomalies: DataFrame, logs: DataFrame, top: int = 500) -> DataFrame:
    """K07 flat form: the exported anomaly rows (score desc, id tie-break)."""
    l = logs.select(F.col("id").alias("_lid"), "timestamp", "source", "event_type", "message", "hostname", "username")
    j = anomalies.join(l, anomalies["log_id"] == l["_lid"]).drop("_lid")
    return j.orderBy(F.desc("anomaly_score"), F.asc("id")).limit(top).select(*ANOMALY_FIELDS)


def merge_into_hub(existing: DataFrame | None, incoming: DataFrame, imported_at=None) -> DataFrame:
    """Rows of ``incoming`` whose (original_id, source_node) the hub does not hold yet.

    Of incoming duplicates the earliest import batch stays (ties and no batch: the smallest row), chosen
    by a partial aggregation; message cut to 500.  Returns the rows to append.
    """
    rest = [c for c in incoming.columns if c not in HUB_KEY and c != "import_batch"]
    first = [c for c in ("import_batch",) if c in incoming.columns]
    inc = incoming.groupBy(*HUB_KEY).agg(F.min(F.struct(*first, *rest)).alias("_r")).select(*HUB_KEY, "_r.*").select(*incoming.columns)
    if existing is not None:
        inc = inc.join(existing.select(*HUB_KEY), HUB_KEY, "left_anti")
    inc = inc.withColumn("message", F.substring(F.coalesce("message", F.lit("")), 1, R.CAP_HUB_MESSAGE))
    if imported_at is not None:
        inc = inc.withColumn("imported_at", F.lit(imported_at))
    return inc


def hub_state(hub_rows: DataFrame) -> DataFrame:
    """The hub table after replaying every import batch idempotently (first import wins)."""
    return merge_into_hub(None, hub_rows)


def node_totals(hub: DataFrame) -> DataFrame:
    """Per node totals, CRITICAL/HIGH counts, mean score, last import."""
    return hub.groupBy("source_node").agg(
        _n().alias("total_anomalies"),
        F.count_if(F.col("severity") == "CRITICAL").cast("bigint").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").cast("bigint").alias("high"),
        X.round6(F.avg("anomaly_score")).alias("avg_score"),
        F.max("imported_at").alias("last_sync"))


def hub_totals(hub: DataFrame) -> DataFrame:
    """A29 totals over ``node_totals`` rows: nodes and anomalies (one row)."""
    return node_totals(hub).agg(_n().alias("total_nodes"), F.coalesce(F.sum("total_anomalies"), F.lit(0)).cast("bigint").alias("total_anomalies"))


def cross_node_correlations(hub: DataFrame, min_nodes: int = 2) -> DataFrame:
    """Techniques seen on >= ``min_nodes`` nodes with hits, node list, score, first/last seen."""
    g = (hub.filter(F.col("mitre_technique_id").isNotNull())
         .groupBy("mitre_technique_id", "mitre_tactic")
         .agg(F.countDistinct("source_node").cast("bigint").alias("node_count"),
              _n().alias("total_hits"),
              F.array_join(F.array_sort(F.collect_set("source_node")), ",").alias("affected_nodes"),
              X.round6(F.avg("anomaly_score")).alias("avg_score"),
              F.min("log_timestamp").alias("first_seen"), F.max("log_timestamp").alias("last_seen")))
    return (g.filter(F.col("node_count") >= min_nodes)
            .withColumn("threat_level", F.when(F.col("node_count") >= 3, F.lit("CRITICAL")).otherwise(F.lit("HIGH")))
            .withColumn("is_coordinated", F.col("node_count") >= 2)
            .orderBy(F.desc("node_count"), F.desc("total_hits"), "mitre_technique_id"))


def tactic_heatmap_long(hub: DataFrame) -> DataFrame:
    """A31 long form: every (node, tactic) pair of the observed sets, zero-filled.

    The spine is nodes x tactics of the *observed* distinct sets (the zero-filled matrix is the feature),
    joined with the per-pair counts.  All three come from the counts, written once: the hub is replayed once.
    """
    h = hub.filter(F.col("mitre_tactic").isNotNull())
    counts = materialized(h.groupBy("source_node", "mitre_tactic").agg(_n().alias("count")), "heatmap")
    nodes = counts.select("source_node").distinct()
    tactics = counts.select("mitre_tactic").distinct()
    spine = nodes.crossJoin(tactics)
    return (spine.join(counts, ["source_node", "mitre_tactic"], "left")
            .select("source_node", "mitre_tactic", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def node_threat_level(total_anomalies: Column, total_logs: Column) -> Column:
    """CLEAN when no anomalies, else by anomaly rate .20 / .10 / .05."""
    rate = total_anomalies / F.greatest(total_logs, F.lit(1))
    return F.when(total_anomalies == 0, F.lit("CLEAN")).otherwise(X.scale(rate, R.NODE_RATE_LEVELS, "LOW"))
