"""Set operations of the reference (U01-U03) as unions and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_catalogues(left: DataFrame, right: DataFrame, key: str, subset: list[str] | None = None) -> DataFrame:
    """Union of two catalogues where the right side overrides the left per key,
    optionally restricted to a name subset.  Output carries ``side`` (0 left, 1 right)."""
    u = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)), allowMissingColumns=True)
    if subset is not None:
        u = u.filter(F.col(key).isin(*subset))
    rest = [c for c in u.columns if c not in (key, "side")]
    return u.groupBy(key).agg(F.max(F.struct("side", *rest)).alias("_r")).select(key, "_r.*").select(*u.columns)
