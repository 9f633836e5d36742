"""Device inventory data: classification, risk, snapshot diffs, connect/disconnect pairing.

(G08-G11, U01, J09, A33, A34, L04, L05, F17).  Enumerating USB buses or pinging
a LAN is a single-machine tool and stays out; these operators work on device
snapshots and event tables, batch or streaming.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import expr as X
from ..functions import rules as R
from . import stats


def _n() -> Column:
    return F.count(F.lit(1)).cast("bigint")


def class_by_name_and_vendor(name: str | Column, vendor_id: str | Column) -> Column:
    """First class whose name token is contained in lower(name), then vendor-id groups, else unknown."""
    n = F.lower(F.coalesce(X.col(name), F.lit("")))
    v = X.col(vendor_id)
    expr = None
    for cls, tokens in R.DEVICE_NAME_CLASSES:
        cond = X.contains_any(n, tokens)
        expr = F.when(cond, F.lit(cls)) if expr is None else expr.when(cond, F.lit(cls))
    for cls, vids in R.DEVICE_VENDOR_CLASSES:
        expr = expr.when(v.isin(*vids), F.lit(cls))
    return expr.otherwise(F.lit("unknown"))


def class_by_usb_code(code: str | Column) -> Column:
    """USB class code -> device class (unknown when unmapped)."""
    return X.lookup(R.USB_CLASS_CODES, F.lower(X.col(code)), "unknown")


def vendor_name(vendor_id: str | Column) -> Column:
    """Vendor id -> vendor name (NULL when unknown)."""
    return X.lookup(R.VENDOR_NAMES, F.lower(X.col(vendor_id)))


def device_risk(device_class: str | Column, vendor_id: str | Column) -> Column:
    """storage/network/phone HIGH (LOW for a trusted vendor), audio MEDIUM, HID LOW, else INFO."""
    c = X.col(device_class)
    v = F.lower(X.col(vendor_id))
    return (F.when(c.isin(*R.RISKY_DEVICE_CLASSES),
                   F.when(F.coalesce(v.isin(*R.SAFE_VENDOR_IDS), F.lit(False)), F.lit("LOW")).otherwise(F.lit("HIGH")))
            .when(c == "audio", F.lit("MEDIUM"))
            .when(c == "hid", F.lit("LOW"))
            .otherwise(F.lit("INFO")))


def ids_from_pnp(pnp: str | Column) -> tuple[Column, Column]:
    """(vendor id, product id) from a PnP string like USB\\VID_0781&PID_5567\\..."""
    p = F.upper(X.col(pnp))
    vid = F.lower(F.nullif(F.regexp_extract(p, r"VID_([0-9A-F]{4})", 1), F.lit("")))
    pid = F.lower(F.nullif(F.regexp_extract(p, r"PID_([0-9A-F]{4})", 1), F.lit("")))
    return vid, pid


def classify_devices(devices: DataFrame) -> DataFrame:
    """Device class, vendor name and risk level for every device row."""
    out = devices.withColumn("device_class", class_by_name_and_vendor("name", "vendor_id"))
    return (out.withColumn("vendor", vendor_name("vendor_id"))
               .withColumn("risk_level", device_risk("device_class", "vendor_id")))


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str = "device_id") -> DataFrame:
    """Connect events for new devices, disconnect events for devices gone (two anti joins)."""
    new = current.join(previous.select(key), key, "left_anti").withColumn("event", F.lit("connected"))
    gone = previous.join(current.select(key), key, "left_anti").withColumn("event", F.lit("disconnected"))
    return new.unionByName(gone, allowMissingColumns=True)


def snapshot_history_diff(snapshots: DataFrame, key: str = "device_id", snap: str = "snapshot") -> DataFrame:
    """U01 over a whole history of numbered snapshots, without a device x snapshot grid.

    Snapshot ids get dense ordinals (numbered range by range).  For each device,
    ``lag``/``lead`` over the snapshots it appears in find the gaps: a device appears
    (connected) where its previous appearance is not the previous snapshot, and
    disappears (disconnected) at the snapshot after an appearance that is not
    followed by the next one.  Output rows = real events only.
    """
    snaps = snapshots.select(snap).distinct()
    ords = stats.row_positions(snaps, [F.col(snap)], "pos").select(snap, F.col("pos").alias("_o"))
    by_o = ords.select(F.col("_o").alias("_eo"), F.col(snap).alias("_es"))
    last_o = ords.agg(F.max("_o")).first()[0]
    present = snapshots.select(key, snap).distinct().join(ords, snap)
    w = W.partitionBy(key).orderBy("_o")
    g = present.withColumn("_prev", F.lag("_o").over(w)).withColumn("_next", F.lead("_o").over(w))
    conn = g.filter(F.col("_prev").isNull() | (F.col("_prev") < F.col("_o") - 1)) \
        .select(key, F.col(snap), F.lit("connected").alias("event"))
    gone = g.filter((F.col("_next").isNull() & (F.col("_o") < F.lit(last_o))) |
                    (F.col("_next").isNotNull() & (F.col("_next") > F.col("_o") + 1))) \
        .select(key, (F.col("_o") + 1).alias("_eo"))
    gone = gone.join(by_o, "_eo").select(key, F.col("_es").alias(snap), F.lit("disconnected").alias("event"))
    return conn.unionByName(gone)


def scan_summary(devices: DataFrame) -> DataFrame:
    """Totals, USB/LAN, new and risky counts (one row)."""
    return devices.agg(
        _n().alias("total_devices"),
        F.count_if(F.col("device_class") != "lan_node").cast("bigint").alias("usb_count"),
        F.count_if(F.col("device_class") == "lan_node").cast("bigint").alias("lan_count"),
        F.count_if(F.coalesce(F.col("is_new"), F.lit(False))).cast("bigint").alias("new_devices"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).cast("bigint").alias("risky_devices"))


def devices_by_class(devices: DataFrame) -> DataFrame:
    """A33 by-class part."""
    return devices.groupBy("device_class").agg(_n().alias("count"))


def event_counters(device_log: DataFrame) -> DataFrame:
    """Connected, disconnected and high-risk event counts."""
    return device_log.agg(
        F.count_if(F.col("event") == "connected").cast("bigint").alias("connected"),
        F.count_if(F.col("event") == "disconnected").cast("bigint").alias("disconnected"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).cast("bigint").alias("high_risk"))


def device_history(device_log: DataFrame, limit: int = 50) -> DataFrame:
    """Newest device rows (connected_at desc, ties by device and sequence)."""
    return device_log.orderBy(F.desc_nulls_last("connected_at"), "device_id", F.desc("seq")).limit(limit)


def device_events(device_log: DataFrame, limit: int = 50) -> DataFrame:
    """Newest events by coalesce(removed_at, connected_at)."""
    t = F.coalesce("removed_at", "connected_at")
    return device_log.withColumn("event_time_", t).orderBy(F.desc_nulls_last("event_time_"), "device_id", F.desc("seq")) \
        .limit(limit).drop("event_time_")
