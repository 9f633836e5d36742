"""Window operators.

Every window here is partitioned by a key (host, source, device) except the ones
that number a bounded result (after a limit).  Global numbering of a whole table
(W05) uses ``stats.row_positions``, which never puts the table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import stats


def display_ids(limited: DataFrame, order_cols: list[Column], out: str = "display_id") -> DataFrame:
    """row_number as a display id — only over an already limited result."""
    return limited.withColumn(out, F.row_number().over(W.orderBy(*order_cols)).cast("bigint"))


def running_counter(df: DataFrame, key: str, order: list[str], value: str, out: str = "counter") -> DataFrame:
    """Running sum of ``value`` per key — a monotone counter like a byte or packet total.

    Skew-safe: rows are range-partitioned by (key, order); the running sum runs inside (key, range) windows and
    adds the totals of the key's earlier ranges (a small per-range table), so a hot key is spread over ranges.
    """
    d = stats.in_ranges(df, [key, *order])
    w_in = W.partitionBy(key, "_p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("_in", F.sum(value).over(w_in))
    tot = d.groupBy(key, "_p").agg(F.sum(value).alias("_t"))
    w_prev = W.partitionBy(key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carry = tot.select(key, "_p", F.coalesce(F.sum("_t").over(w_prev), F.lit(0)).alias("_c"))
    return d.join(carry, [key, "_p"]).withColumn(out, F.col("_c") + F.col("_in")).drop("_p", "_in", "_c")


def counter_rate(df: DataFrame, key: str, order: list[str], counter: str, out: str = "rate") -> DataFrame:
    """Difference to the previous sample of the same key, clamped at 0 (first sample NULL).

    Skew-safe like ``running_counter``: ``lag`` inside (key, range); the first sample of a range takes the last
    sample of the key's earlier ranges (``max_by`` per range, carried over a small per-range table).
    """
    d = stats.in_ranges(df, [key, *order])
    d = d.withColumn("_prev", F.lag(counter).over(W.partitionBy(key, "_p").orderBy(*order)))
    last = d.groupBy(key, "_p").agg(F.max_by(counter, F.struct(*order)).alias("_l"))
    w_prev = W.partitionBy(key).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(key, "_p", F.last("_l", ignorenulls=True).over(w_prev).alias("_c"))
    d = d.join(carry, [key, "_p"])
    prev = F.coalesce(F.col("_prev"), F.col("_c"))
    return d.withColumn(out, F.greatest(F.col(counter) - prev, F.lit(0.0))).drop("_p", "_prev", "_c")


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The greatest row of each key under ``order`` (columns compared descending,
    later ones break ties), e.g. [ingestion_time, id] -> latest ingestion, highest id.

    A ``max_by`` aggregation, partial then final: a key holding a third of all rows
    is reduced map-side to one candidate per partition before the shuffle (a
    row_number window would put the whole key in one task).
    """
    cols = [c for c in df.columns]
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def continue_ids(df: DataFrame, order_cols: list[Column], current_max: int, out: str = "id") -> DataFrame:
    """Dense ids max+1, max+2, ... in the given total order (distributed numbering)."""
    pos = stats.row_positions(df, order_cols, "_pos")
    return pos.withColumn(out, (F.lit(current_max + 1) + F.col("_pos")).cast("bigint")).drop("_pos")


def rank_spread(df: DataFrame, order_cols: list[Column], lo: float = 0.1, hi: float = 0.9,
                out: str = "spread") -> DataFrame:
    """Evenly spread values lo..hi by rank."""
    n = df.count()
    pos = stats.row_positions(df, order_cols, "_pos")
    step = (hi - lo) / (n - 1) if n > 1 else 0.0
    return pos.withColumn(out, F.lit(lo) + F.col("_pos") * F.lit(step)).drop("_pos")
