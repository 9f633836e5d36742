"""Population statistics that stay distributed: exact percentiles, row positions, exact samples.

``exact_percentiles`` reproduces numpy's linear-interpolation percentile by exact selection from
histograms.  Every pass counts the values of each interval that still holds a wanted rank in ``BINS`` bins, with
the least and greatest value of each bin; the bin with the rank becomes the next interval, until the rank falls on
its least or greatest value.  No row is shuffled: an exchange carries bins, and the driver receives one row per wanted
rank and pass.
"""

from __future__ import annotations

import math
import sys

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Bins of an interval and pass.
BINS = 4096
_LARGEST = sys.float_info.max
#: Natural logarithm below that of the least positive double.
_LEAST_LOG = -745.2


def _bin(v: Column, lo: float, hi: float, geometric: bool) -> Column:
    """Number of the bin of ``v`` in [lo, hi], rising with ``v``; ``lo`` and ``hi`` never share one.

    Equal bins, or ``geometric`` ones that grow with the distance from ``lo``, so that values of any
    scale part after a few passes.  Infinite values have bins of their own.
    """
    low, high = max(lo, -_LARGEST), min(hi, _LARGEST)
    half = 0.5 if math.isinf(high - low) else 1.0   # halves only where the span overflows
    span = high * half - low * half
    at = v * F.lit(half) - F.lit(low * half)
    if span <= 0:
        inner = F.lit(1)
    elif geometric:
        inner = F.when(at <= 0, 1).otherwise(2 + F.floor((F.log(at) - _LEAST_LOG) * F.lit(BINS / (math.log(span) - _LEAST_LOG))))
    else:
        inner = 1 + F.least(F.floor(at / F.lit(span) * BINS), F.lit(BINS - 1))
    return F.when(v < low, 0).when(v > high, BINS + 9).otherwise(inner).cast("int")


def order_statistics(df: DataFrame, cols: list[str], ranks) -> dict[str, dict[int, float]]:
    """Per column the values at the 0-based ``ranks(n)`` of its n sorted values (NULL and NaN don't count).

    Key -1 holds n.
    """
    kept = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    kept = kept.persist(StorageLevel.MEMORY_AND_DISK)   # every pass reads it
    try:
        ends = kept.agg(*[f(f"c{i}").alias(f"{n}{i}") for i in range(len(cols)) for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first()
        out: dict[str, dict[int, float]] = {c: {-1: ends[f"n{i}"]} for i, c in enumerate(cols)}
        # (column, lo, hi) -> [(rank, its place among the values of [lo, hi])]
        open_: dict[tuple[int, float, float], list[tuple[int, int]]] = {}
        for i, c in enumerate(cols):
            n, lo, hi = ends[f"n{i}"], ends[f"lo{i}"], ends[f"hi{i}"]
            for r in ranks(n) if n else []:
                _narrowed(out[c], open_, i, r, r, lo, hi, n)
        step = 0
        while open_:
            parts = list(open_)
            binned = [F.when(F.col(f"c{i}").between(lo, hi), F.struct(F.lit(j).alias("j"), _bin(F.col(f"c{i}"), lo, hi, step % 2 == 1).alias("b"),
                                                                      F.col(f"c{i}").alias("v"))) for j, (i, lo, hi) in enumerate(parts)]
            bins = (kept.select(F.explode(F.array_compact(F.array(*binned))).alias("x")).groupBy("x.j", "x.b")
                    .agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")))
            upto = bins.withColumn("end", F.sum("n").over(W.partitionBy("j").orderBy("b")))   # a window holds an interval's bins
            wanted = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(r).alias("rank"), F.lit(at).alias("at")) for j, p in enumerate(parts) for r, at in open_[p]])
            mine = F.filter(wanted, lambda x: (x["j"] == F.col("j")) & (x["at"] < F.col("end")) & (x["at"] >= F.col("end") - F.col("n")))
            found = upto.select("j", "n", "lo", "hi", "end", F.inline(mine.alias("x")).alias("_j", "rank", "at")).collect()   # a row per wanted rank
            open_ = {}
            for x in found:
                i = parts[x["j"]][0]
                _narrowed(out[cols[i]], open_, i, x["rank"], x["at"] - (x["end"] - x["n"]), x["lo"], x["hi"], x["n"])
            step += 1
    finally:
        kept.unpersist()
    return out


def _narrowed(found: dict[int, float], open_: dict, column: int, rank: int, at: int, lo: float, hi: float, n: int) -> None:
    """Notes the value of place ``at`` among ``n`` values of [lo, hi], or the interval to search."""
    if lo == hi or at == 0:
        found[rank] = lo
    elif at == n - 1:
        found[rank] = hi
    else:
        open_.setdefault((column, lo, hi), []).append((rank, at))


def exact_percentiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact linear percentiles (numpy's interpolation) of several columns in one pass."""
    def ranks(n: int) -> list[int]:
        return sorted({r for p in probs for r in (math.floor(p * (n - 1)), min(math.floor(p * (n - 1)) + 1, n - 1))})

    found = order_statistics(df, cols, ranks)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n, at = found[c][-1], found[c]
        out[c] = []
        for p in probs:
            low = math.floor(p * (n - 1)) if n else 0
            out[c].append(at[low] + (at[min(low + 1, n - 1)] - at[low]) * (p * (n - 1) - low) if n else None)
    return out


def exact_percentile(df: DataFrame, col: str, p: float) -> float | None:
    """numpy-style linear percentile of the non-NULL values of ``col``."""
    return exact_percentiles(df, [col], [p])[col][0]


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` range-partitioned by ``order`` with the range's number in ``_p``.

    Ranges hold about equally many rows whatever the keys, so a window by (key, ``_p``) never holds more
    than one range of a hot key; numbers rise along the order, so per-range results can be carried on.
    Checkpointed, because the numbers must not change between reads.
    """
    return df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).checkpoint()


def row_positions(df: DataFrame, order_cols: list[Column], pos_col: str = "pos") -> DataFrame:
    """0-based position of every row in the total order ``order_cols``.

    Rows are range-sorted, numbered inside each range and shifted by the sizes of the
    ranges before (a table with one row per range), so no task holds everything.
    """
    srt = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    srt = srt.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    srt = srt.checkpoint()
    first = srt.groupBy("_p").agg(F.min("_m").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    offs = first.select("_p", "_m0", F.coalesce(F.sum("_n").over(
        W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return (srt.join(F.broadcast(offs), "_p")
            .withColumn(pos_col, (F.col("_o") + F.col("_m") - F.col("_m0")).cast("bigint"))
            .drop("_p", "_m", "_m0", "_o"))


def hash_uniform(*cols: Column, seed: int = 42) -> Column:
    """Deterministic uniform [0, 1) from a 64-bit hash of the columns and a seed."""
    h = F.xxhash64(*cols, F.lit(seed))
    return (F.pmod(h, F.lit(1 << 53)).cast("double")) / float(1 << 53)


def exact_sample(df: DataFrame, target: int, key: str = "id", seed: int = 42,
                 label: str | None = None, n: int | None = None) -> DataFrame:
    """Exactly ``target`` rows (all rows when fewer), chosen by a seeded hash of ``key``.

    With ``label``: proportional class targets, largest remainder first.  A
    Bernoulli pre-filter keeps about 3x the target, so the final row_number runs
    over a bounded candidate set, never over the whole table.
    """
    n = df.count() if n is None else n
    if n <= target:
        return df
    u = hash_uniform(F.col(key), seed=seed)
    if label is None:
        targets = {None: target}
        counts = {None: n}
    else:
        rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).collect()
        counts = {r[label]: r["c"] for r in rows}
        fr = {k: c / n for k, c in counts.items()}
        tg = {k: int(math.floor(f * target)) for k, f in fr.items()}
        rem = target - sum(tg.values())
        for k in sorted(fr, key=lambda k: (-(fr[k] * target - tg[k]), str(k)))[:max(rem, 0)]:
            tg[k] += 1
        targets = tg
    frac = min(1.0, 3.0 * target / n + 1e-9)
    while True:
        cand = df.withColumn("_u", u).filter(F.col("_u") < frac)
        if label is None:
            got = cand.count()
            ok = got >= target or frac >= 1.0
        else:
            got_by = {r[label]: r["c"] for r in cand.groupBy(label).agg(F.count(F.lit(1)).alias("c")).collect()}
            ok = all(got_by.get(k, 0) >= min(t, counts[k]) for k, t in targets.items()) or frac >= 1.0
        if ok:
            break
        frac = min(1.0, frac * 2)
    if label is None:
        w = W.orderBy("_u", key)
        return cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= target).drop("_u", "_r")
    tmap = F.create_map(*[x for k, t in targets.items() for x in (F.lit(k), F.lit(t))])
    w = W.partitionBy(label).orderBy("_u", key)
    return (cand.withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= F.try_element_at(tmap, F.col(label))).drop("_u", "_r"))
