"""Anomaly detectors and score blending.

All detectors score every row of a feature frame (``id`` + 20 feature columns).
Population parameters (means, deviations, min/max, percentile) are one-row
aggregates whose values become literals — the only shuffles are those
aggregates; scoring itself is a narrow projection.

* D01 z-score, D02 IQR, D05 keyword rules, D07/D06 blends, D08 rescale and D09
  percentile cut are built-in expressions (exactly reproducible in SQL).
* D03 isolation forest: samples are drawn by seeded hashes, each tree is built
  in its own ``applyInPandas`` group (256 rows), and the forest (bounded:
  trees x 511 nodes) scores all rows in ``mapInPandas`` with numpy.
* D04 one-class SVM: random Fourier features approximate the RBF kernel
  (Rahimi & Recht 2007); the primal one-class objective (Schölkopf et al. 2001)
  is minimised over the whole population by distributed passes until its duality
  gap is small, and the linear scorer runs over all rows in a pandas UDF.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..functions import rules as R
from ..session import materialized
from . import stats

FEATURES = R.FEATURE_NAMES


# ------------------------------------------------------------------ helpers
def _minmax(df: DataFrame, col: str, out: str, zero_when_flat: bool = True) -> DataFrame:
    """(x - min) / (max - min) over the population; 0 for every row when max == min."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    return df.withColumn(out, _between(F.col(col), lo, hi, lambda rng: rng == 0))


def _between(value: Column, lo: float | None, hi: float | None, flat) -> Column:
    """(value - lo) / (hi - lo), 0 where ``flat`` says so of the span; null bounds (no row) give null."""
    lo, rng = F.lit(lo).cast("double"), F.lit(hi).cast("double") - F.lit(lo).cast("double")
    return F.when(flat(rng), F.lit(0.0)).otherwise((value - lo) / rng)


#: Features of one aggregate: more would hold over 100 buffer fields and leave generated code.
_MOMENT_FEATURES = 10


def _moments(feats: DataFrame, names) -> DataFrame:
    """One row: mean_x and std_x (population) of every feature x."""
    names, out = list(names), None
    for i in range(0, len(names), _MOMENT_FEATURES):
        part = feats.agg(*[f(c).alias(f"{k}_{c}") for c in names[i:i + _MOMENT_FEATURES] for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
        out = part if out is None else out.crossJoin(part)
    return out


# ------------------------------------------------------------------ D01 z-score
def zscore_fit(feats: DataFrame, names=FEATURES) -> DataFrame:
    """Means and population deviations (0 -> 1e-10) of every feature: one row."""
    return _moments(feats, names).select(*[c for f in names for c in (
        F.col(f"mean_{f}"),
        F.when(F.col(f"std_{f}") == 0, F.lit(R.ZERO_STD_REPLACEMENT)).otherwise(F.col(f"std_{f}")).alias(f"std_{f}"))])


def zscore_score(feats: DataFrame, params: DataFrame, names=FEATURES, out: str = "stat_score",
                 threshold: float = R.ZSCORE_THRESHOLD) -> DataFrame:
    """max |z| over features, min-max scaled over the population; stat_pred -1 when max |z| > threshold."""
    p = params.first()
    maxz = F.greatest(*[F.abs((F.col(f) - F.lit(p[f"mean_{f}"]).cast("double")) / F.lit(p[f"std_{f}"]).cast("double")) for f in names])
    j = feats.withColumn("max_z", maxz)
    j = j.withColumn("stat_pred", F.when(F.col("max_z") > threshold, F.lit(-1)).otherwise(F.lit(1)))
    return _minmax(j, "max_z", out)


# ------------------------------------------------------------------ D02 IQR
def iqr_fit(feats: DataFrame, names=FEATURES) -> dict[str, tuple[float, float, float]]:
    """Exact (q1, q3, iqr) per feature with linear interpolation (iqr 0 -> 1e-10)."""
    qs = stats.exact_percentiles(feats, list(names), [0.25, 0.75])
    out = {}
    for f in names:
        q1, q3 = qs[f]
        iqr = q3 - q1
        out[f] = (q1, q3, iqr if iqr != 0 else R.ZERO_STD_REPLACEMENT)
    return out


def iqr_score(feats: DataFrame, params: dict, names=FEATURES, k: float = R.ZSCORE_THRESHOLD,
              out: str = "iqr_score") -> DataFrame:
    """Share of features outside [q1 - k*iqr, q3 + k*iqr]; iqr_pred -1 when any."""
    flags = []
    for f in names:
        q1, q3, iqr = params[f]
        lo, hi = q1 - k * iqr, q3 + k * iqr
        flags.append(((F.col(f) < F.lit(lo)) | (F.col(f) > F.lit(hi))).cast("int"))
    cnt = flags[0]
    for fl in flags[1:]:
        cnt = cnt + fl
    return (feats.withColumn("outlier_features", cnt.cast("bigint"))
            .withColumn(out, F.col("outlier_features") / float(len(names)))
            .withColumn("iqr_pred", F.when(F.col("outlier_features") > 0, F.lit(-1)).otherwise(F.lit(1))))


# ------------------------------------------------------------------ D05 keywords
def keyword_score_expr(message: str = "message", source: str = "source", severity: str = "severity") -> Column:
    """Severity base, max over the suspicious keywords, then each matching source rule
    in order: score = max(score, w) * 0.9; clipped to [0, 1]."""
    msg = F.lower(F.coalesce(F.col(message), F.lit("")))
    src = F.lower(F.coalesce(F.col(source), F.lit("")))
    sev = F.upper(F.coalesce(F.col(severity), F.lit("INFO")))
    base = X.lookup(R.KEYWORD_SEVERITY_BASE, sev, R.KEYWORD_SEVERITY_DEFAULT)
    score = X.max_weight(msg, R.SUSPICIOUS_KEYWORDS, base)
    # ordered fold over the matching source rules (one expression, the score is not copied per rule)
    rules_arr = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in R.SOURCE_SEVERITY_RULES])
    matched = F.filter(rules_arr, lambda r: src.contains(r["s"]))
    score = F.aggregate(matched, score, lambda acc, r: F.greatest(acc, r["w"]) * F.lit(R.SOURCE_RULE_DAMPING))
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def keyword_scores(logs: DataFrame, out: str = "keyword_score") -> DataFrame:
    return logs.select("id", keyword_score_expr().alias(out))


# ------------------------------------------------------------------ D08 / D09
def redistribute(df: DataFrame, col: str, out: str = "anomaly_score", order_key: str = "id",
                 return_count: bool = False):
    """min-max -> logistic(6(x - .5)) -> .1 + .89 s; a flat input spreads .1 .. .9 by row order.

    One aggregate pass gives min, max and the row count (returned with ``return_count``
    so the percentile step does not count again).
    """
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"), F.count(F.lit(1)).alias("_n")).first()
    n = mm["_n"]
    if n == 0:
        res = df.withColumn(out, F.lit(None).cast("double"))
    elif mm["_mx"] - mm["_mn"] < 1e-8:
        lo, hi = R.CONSTANT_SPREAD
        pos = stats.row_positions(df, [F.col(col), F.col(order_key)], "_pos")
        step = (hi - lo) / (n - 1) if n > 1 else 0.0
        res = pos.withColumn(out, F.lit(lo) + F.col("_pos") * F.lit(step)).drop("_pos")
    else:
        norm = (F.col(col) - F.lit(mm["_mn"])) / F.lit(mm["_mx"] - mm["_mn"])
        spread = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-R.REDISTRIBUTE_STEEPNESS) * (norm - F.lit(0.5))))
        res = df.withColumn(out, F.lit(R.REDISTRIBUTE_FLOOR) + F.lit(R.REDISTRIBUTE_SPAN) * spread)
    return (res, n) if return_count else res


def percentile_cut(df: DataFrame, col: str = "anomaly_score", p: float = R.PREDICTION_PERCENTILE,
                   out: str = "prediction", n: int | None = None, approx_accuracy: int | None = None
                   ) -> tuple[DataFrame, float]:
    """Prediction -1 when score >= the p-th percentile (linear, exact), else 1.

    ``approx_accuracy`` switches to ``percentile_approx`` (one pass, rank error at
    most n / accuracy) for runs where the exact cut is not required.
    """
    if approx_accuracy:
        thr = df.agg(F.percentile_approx(col, F.lit(p), approx_accuracy)).first()[0]
    else:
        thr = stats.exact_percentile(df, col, p)
    if thr is None:
        return df.withColumn(out, F.lit(1)), float("nan")
    return df.withColumn(out, F.when(F.col(col) >= F.lit(thr), F.lit(-1)).otherwise(F.lit(1))), thr


def blend(scores: DataFrame, weights: list[tuple[str, float]], out: str = "combined") -> DataFrame:
    """Weighted sum of score columns (a missing/failed member counts 0)."""
    total = None
    for c, w in weights:
        term = F.lit(float(w)) * F.coalesce(F.col(c), F.lit(0.0))
        total = term if total is None else total + term
    return scores.withColumn(out, total)


# ------------------------------------------------------------------ D03 isolation forest
FOREST_SCHEMA = ("tree int, node int, feature int, threshold double, left_child int, right_child int, "
                 "leaf_size int, depth int")


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search (Liu et al. 2008)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    nodes = []  # feature, threshold, left, right, leaf_size, depth

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx), depth])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        if left.size == 0 or right.size == 0:
            return me
        nodes[me][0], nodes[me][1] = f, thr
        nodes[me][2] = build(left, depth + 1)
        nodes[me][3] = build(right, depth + 1)
        return me

    build(np.arange(x.shape[0]), 0)
    return nodes


def _tree_builder(names, seed):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[names].to_numpy(dtype=np.float64)
        depth = int(math.ceil(math.log2(max(x.shape[0], 2))))
        rng = np.random.default_rng(seed * 1_000_003 + tree)
        nodes = _grow_tree(x, rng, depth)
        return pd.DataFrame({
            "tree": tree, "node": np.arange(len(nodes), dtype=np.int32),
            "feature": [n[0] for n in nodes], "threshold": [n[1] for n in nodes],
            "left_child": [n[2] for n in nodes], "right_child": [n[3] for n in nodes],
            "leaf_size": [n[4] for n in nodes], "depth": [n[5] for n in nodes]})
    return build


def forest_fit(feats: DataFrame, names=FEATURES, n_trees: int = R.ISOLATION_TREES,
               sample_size: int = R.ISOLATION_SAMPLE, seed: int = R.RANDOM_SEED, n: int | None = None) -> DataFrame:
    """Grow ``n_trees`` isolation trees, each on its own seeded sample of min(256, n) rows.

    A Bernoulli pre-sample bounds the candidates (about 2 x trees x 256 rows); each
    (candidate, tree) pair is then thinned by its own hash to about 4 x 256 per
    tree before the per-tree window picks the exact 256, so neither step grows
    with the table.  A tree left short by the thinning is re-drawn from all its
    candidates (checked by one small per-tree count).
    """
    n = feats.count() if n is None else n
    want = min(sample_size, n)
    frac = min(1.0, 2.0 * n_trees * sample_size / max(n, 1))
    cand = feats.select("id", *names)
    if frac < 1.0:
        cand = cand.filter(stats.hash_uniform(F.col("id"), seed=seed) < frac)
    m = max(int(frac * n), 1)
    keep_p = min(1.0, 4.0 * sample_size / m)
    per_tree = (cand.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
                .withColumn("_u", stats.hash_uniform(F.col("id"), F.col("tree"), seed=seed + 1)))
    thinned = per_tree.filter(F.col("_u") < keep_p) if keep_p < 1.0 else per_tree
    if keep_p < 1.0:
        # about 4 x 256 rows per tree: small, kept so the check and the sample share one pass
        thinned = thinned.persist(StorageLevel.MEMORY_AND_DISK)
        per = thinned.groupBy("tree").count().collect()          # one row per tree: bounded
        if len(per) < n_trees or min(r["count"] for r in per) < want:
            thinned = per_tree
    w = W.partitionBy("tree").orderBy("_u", "id")
    sample = thinned.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample_size)
    return (sample.select("tree", *names).groupBy("tree")
            .applyInPandas(_tree_builder(list(names), seed), FOREST_SCHEMA))


def _flat_tree(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(feature, threshold, children, path length, levels) of a tree's nodes: the right child of node k is
    children[2 k], its left one children[2 k + 1], a leaf its own child; a leaf's path length is depth + c(size)."""
    feature, leaf = nodes["feature"].to_numpy(np.int64), nodes["feature"].to_numpy() < 0
    children = np.stack([np.where(leaf, np.arange(len(nodes)), nodes[c].to_numpy(np.int64)) for c in ("right_child", "left_child")], axis=1).ravel()
    depth = nodes["depth"].to_numpy(np.int64)
    path = depth + np.array([_c(int(z)) for z in nodes["leaf_size"]])
    return np.maximum(feature, 0), nodes["threshold"].to_numpy(np.float64), children, path, int(depth.max())


def _path_lengths(x: np.ndarray, trees: list) -> np.ndarray:
    """Summed path length of every row: all rows step down a level at a time, those at a leaf stay there."""
    values, start, total = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
    for feature, threshold, children, path, levels in trees:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(levels):
            left = values.take(start + feature.take(node)) < threshold.take(node)
            node = children.take(2 * node + left)
        total += path.take(node)
    return total


def forest_raw(feats: DataFrame, forest: DataFrame, names=FEATURES, sample_size: int = R.ISOLATION_SAMPLE,
               out: str = "_if_score_raw", max_nodes: int = 2_000_000) -> DataFrame:
    """``feats`` with the anomaly score 2^(-E[h(x)]/c(psi)) of every row; only the features go to Python."""
    # bounded by construction: trees x (2 x sample - 1) nodes; re-checked after collection
    nodes = forest.orderBy("tree", "node").limit(max_nodes + 1).toPandas()
    if len(nodes) > max_nodes:
        raise ValueError(f"forest has more than {max_nodes} nodes, above the broadcast bound")
    trees = [_flat_tree(g) for _, g in nodes.groupby("tree", sort=True)]
    psi = int(nodes.loc[nodes["node"] == 0, "leaf_size"].max()) if len(nodes) else 1
    c_psi = _c(min(sample_size, max(psi, 1))) or 1.0
    bc = feats.sparkSession.sparkContext.broadcast((trees, c_psi))
    names = list(names)

    @F.pandas_udf("double")
    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        trees_, cpsi = bc.value
        for pdf in it:
            total = _path_lengths(pdf[names].to_numpy(dtype=np.float64), trees_)
            yield pd.Series(np.power(2.0, -(total / max(len(trees_), 1)) / cpsi))

    return feats.withColumn(out, score(F.struct(*names)))


def forest_score(feats: DataFrame, forest: DataFrame, names=FEATURES, out: str = "if_score") -> DataFrame:
    """The raw score min-max scaled over the population (the reference's contamination offset cancels)."""
    return scaled(forest_raw(feats, forest, names, out=f"_{out}_raw"), {f"_{out}_raw": out})


def scaled(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Raw member scores min-max scaled: {raw column: scaled column}.  The Python scorers run once: their
    output is written for the one min/max pass and the consumers."""
    raw = materialized(raw, "raw-scores")
    bounds = raw.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = raw
    for c, name in columns.items():
        out = out.withColumn(name, _between(F.col(c), bounds[f"lo_{c}"], bounds[f"hi_{c}"], lambda span: ~F.coalesce(span > 0, F.lit(False))))
    return out.drop(*columns)


# ------------------------------------------------------------------ D04 one-class SVM (RFF)
def nearest_point(gram: np.ndarray) -> np.ndarray:
    """Weights on the simplex that minimise a'Ga: the point of a hull nearest to 0 (Wolfe's active set)."""
    n = len(gram)
    a = np.zeros(n)
    a[np.argmin(np.diag(gram))] = 1.0
    small = 1e-12 * np.trace(gram) / n
    for _ in range(100 * n):
        grad = gram @ a
        j = int(np.argmin(np.where(a > 0, np.inf, grad)))
        if (a > 0).all() or grad[j] >= a @ grad - small:
            break
        on = a > 0
        on[j] = True
        while True:
            k = np.flatnonzero(on)
            system = np.block([[gram[np.ix_(k, k)], np.ones((len(k), 1))], [np.ones((1, len(k))), np.zeros((1, 1))]])
            y = np.linalg.lstsq(system, np.append(np.zeros(len(k)), 1.0), rcond=None)[0][:-1]
            if (y > 0).all():
                a[:] = 0.0
                a[k] = y
                break
            bad = y <= 0
            part = a[k] + (y - a[k]) * min(1.0, float((a[k][bad] / (a[k][bad] - y[bad])).min()))
            part[bad & (part <= part[bad].min())] = 0.0  # the first weight that would turn negative leaves
            a[:] = 0.0
            a[k] = np.maximum(part, 0.0) / np.maximum(part, 0.0).sum()
            on = a > 0
    return a


def _low_mean(z: np.ndarray, w: np.ndarray, nu: float) -> np.ndarray:
    """Mean of the nu share of the rows ``z`` (one row at least) with the smallest margins; a row may count in part."""
    share = max(nu * len(z), 1.0)
    order = np.argsort(z @ w, kind="stable")[:math.ceil(share)]
    part = np.ones(len(order))
    part[-1] -= len(order) - share
    return part @ z[order] / share


def _hull_steps(corners: list[np.ndarray], z: np.ndarray, nu: float, gap: float, most: int) -> list[np.ndarray]:
    """The points that the fit would visit if ``z`` were all rows, from the hull of ``corners`` (the mean of ``z`` without any)."""
    corners = list(corners) or [z.mean(axis=0)]
    visited: list[np.ndarray] = []
    while len(visited) < most:
        points = np.array(corners)
        a = nearest_point(points @ points.T)
        w = a @ points
        if visited and w @ w >= visited[-1] @ visited[-1] * (1 - 1e-12):
            break
        visited.append(w)
        corners = [p for p, x in zip(corners, a) if x > 0]
        low = _low_mean(z, w, nu)
        if w @ (w - low) <= gap * max(float(w @ w), 1e-6):
            break
        corners.append(low)
    return visited


#: Rows of a block of ``_packed``.
_BLOCK_ROWS = 1024


def _packed(feats: DataFrame) -> DataFrame:
    """The rows of double columns as blocks (``width``, ``block``: the values column by column), written once:
    the passes of a fit read every row a dozen times, and a block goes to Python as it is."""
    width = len(feats.columns)

    def pack(it):
        for batch in it:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            blocks = [x[:, i:i + _BLOCK_ROWS].tobytes() for i in range(0, batch.num_rows, _BLOCK_ROWS)]
            yield pa.RecordBatch.from_pydict({"width": pa.array([width] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.binary())})

    # small row groups: a reader holds one uncompressed
    return materialized(feats.mapInArrow(pack, "width int, block binary"), "blocks", **{"parquet.block.size": 4 << 20})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows x columns of every block of ``_packed``."""
    for batch in batches:
        for width, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield np.frombuffer(block.as_buffer(), np.float64).reshape(width, -1).T


def _may_be_below(rough, x: np.ndarray, dirs: np.ndarray, hi: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Which rows may have a margin below ``hi`` along some direction: all that have, and few others.

    Margins of the ``rough`` map are off by at most 1.7e-5 of their bound (its values by 1e-6 of theirs, a sum of
    256 single products by 256 roundings); 1e-4 is allowed for.  In blocks that stay in the cache.
    """
    room = 1e-4 * math.sqrt(2.0 / dirs.shape[1]) * np.abs(dirs).sum(axis=1) + 1e-12
    limit, across = np.nextafter((hi + room).astype(np.float32), np.float32(np.inf)), dirs.T.astype(np.float32)
    out = np.zeros(len(x), dtype=bool)
    for i in range(0, len(x), rows):
        out[i:i + rows] = (rough(x[i:i + rows]) @ across <= limit).any(axis=1)
    return out


class _Margins:
    """Distributed passes over the margins of mapped rows, for several directions at once (``passes`` counts them)."""

    def __init__(self, blocks: DataFrame, mapped, rough, n: int, components: int):
        self.blocks, self.mapped, self.rough, self.n, self.components, self.passes = blocks, mapped, rough, n, components, 0

    def _sums(self, dirs: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Directions x bins x (1 + components): rows and their mapped sum, below ``lo`` (bin 0) and per bin of [lo, hi)."""
        mapped, rough, size, n_bins = self.mapped, self.rough, 1 + self.components, R.SVM_MARGIN_BINS

        def local(it):
            total = np.zeros((len(dirs), 1 + n_bins, size))
            for x in _unpacked(it):
                # rows above every ``hi`` count nowhere: single precision leaves most of them out
                x = x[_may_be_below(rough, x, dirs, hi)]
                if not len(x):
                    continue
                z = mapped(x)
                at = np.floor((z @ dirs.T - lo) / np.maximum(hi - lo, 1e-300) * n_bins) + 1
                for j in range(len(dirs)):
                    rows = np.flatnonzero(at[:, j] <= n_bins)
                    bins = np.maximum(at[rows, j], 0).astype(np.int64)
                    order = np.argsort(bins, kind="stable")
                    rows, bins = rows[order], bins[order]
                    head = np.flatnonzero(np.diff(bins, prepend=-1))
                    if len(head):
                        total[j, bins[head], 0] += np.diff(np.append(head, len(bins)))
                        total[j, bins[head], 1:] += np.add.reduceat(z[rows], head, axis=0)
            flat = total.reshape(-1, size)
            k = np.flatnonzero(flat[:, 0])
            if len(k):
                yield pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "v": pa.array([r.tobytes() for r in flat[k]], pa.binary())})

        def add(it):
            total: dict[int, np.ndarray] = {}
            for pdf in it:
                rows = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(-1, size)
                for k, row in zip(pdf["k"].tolist(), rows):
                    if k in total:
                        total[k] += row
                    else:
                        total[k] = row.copy()
            if total:
                yield pd.DataFrame({"k": np.array(list(total), np.int32), "v": [r.tobytes() for r in total.values()]})

        self.passes += 1
        # a vector per task, direction and bin is exchanged, whatever the table; the sums are added up as they stream by
        kind = "k int, v binary"
        out = np.zeros((len(dirs) * (1 + n_bins), size))
        for r in self.blocks.mapInArrow(local, kind).repartition("k").mapInPandas(add, kind).collect():
            out[r["k"]] = np.frombuffer(r["v"], np.float64)
        return out.reshape(len(dirs), 1 + n_bins, size)

    def lowest(self, dirs: np.ndarray, lo: np.ndarray, hi: np.ndarray, nu: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """Per direction the mean of the nu share of rows (one at least) with the smallest margins, and the margin where it ends (the start of its bin).

        ``lo`` and ``hi`` say where that margin is thought to lie.  The search narrows or leaves them until
        the rows that share the last bin can move a margin of the mean by ``tolerance`` at most.
        """
        share = max(nu * self.n, 1.0)
        bound = math.sqrt(2.0 / self.components) * np.abs(dirs).sum(axis=1) * (1 + 1e-9) + 1e-12
        lo, hi = np.maximum(lo, -bound), np.minimum(hi, bound)
        means, ends = np.zeros_like(dirs), np.zeros(len(dirs))
        todo = np.arange(len(dirs))
        while len(todo):
            again = []
            for j, bins in zip(todo, self._sums(dirs[todo], lo[todo], hi[todo])):
                upto = np.cumsum(bins[:, 0])
                width = (hi[j] - lo[j]) / R.SVM_MARGIN_BINS
                b = int(np.searchsorted(upto, share - 1e-6))
                if b == 0 and lo[j] > -bound[j]:
                    lo[j], hi[j] = -bound[j], lo[j]
                elif b == len(upto):
                    lo[j], hi[j] = hi[j] - width * 1e-3, bound[j]
                else:
                    rest = share - (upto[b] - bins[b, 0])
                    if width * rest / share > tolerance and width > 1e-12 * bound[j] and b:
                        start = lo[j] + (b - 1) * width
                        lo[j], hi[j] = start - width * 1e-3, start + width * 1.001
                    else:
                        inside = bins[b, 1:] / bins[b, 0]
                        means[j] = (bins[:b, 1:].sum(axis=0) + inside * rest) / share
                        ends[j] = min(lo[j] + (b - 1) * width, inside @ dirs[j]) if b else inside @ dirs[j]
                        continue
                again.append(j)
            todo = np.array(again, dtype=np.int64)
        return means, ends


def svm_fit(feats: DataFrame, names=FEATURES, nu: float = 0.01, n_components: int = 256,
            seed: int = R.RANDOM_SEED, gap: float = R.SVM_GAP) -> dict:
    """Standardise, map with random Fourier features of the RBF kernel (gamma = 1/d), and minimise the
    primal one-class objective |w|^2 / 2 - (mean margin of the nu share of rows with the smallest) over
    the whole population, until the duality gap is at most ``gap`` of |w|^2.

    The means of the nu share of rows whose margins along some direction are smallest are the corners of the dual's
    feasible set; w is the point nearest to 0 in the hull of those met, and w (w - mean) is the gap.  Which
    directions are worth asking for is worked out on a hashed sample of at most about ``R.SVM_SAMPLE`` rows on the driver: from
    the corners known, it steps on as the fit would, and the whole population then answers for all of these directions
    (w itself first) in one pass that sums rows per bin of the margins around the sample's quantile.  The sample only proposes; corners, gap and rho come from all rows.
    """
    names, d = list(names), len(names)
    n, row = feats.count(), _moments(feats, names).first()
    mean = np.array([row[f"mean_{c}"] or 0.0 for c in names])
    std = np.array([row[f"std_{c}"] or 0.0 for c in names])
    std = np.where(std == 0, 1.0, std)
    rng = np.random.default_rng(seed)
    w_rff = rng.normal(0.0, math.sqrt(2.0 / d), size=(d, n_components))
    b_rff = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    scale = math.sqrt(2.0 / n_components)

    def mapped(x: np.ndarray) -> np.ndarray:
        return scale * np.cos((x - mean) / std @ w_rff + b_rff)

    def rough(x: np.ndarray) -> np.ndarray:
        # whole turns are taken off in double precision
        turns = ((x - mean) / std @ w_rff + b_rff) / (2.0 * math.pi)
        turns -= np.rint(turns)
        return np.float32(scale) * np.cos(np.float32(2.0 * math.pi) * turns.astype(np.float32))

    w, rho, passes = np.zeros(n_components), 0.0, 0
    if n:
        key = F.col("id") if "id" in feats.columns else F.struct(*names)
        chosen = feats.where(stats.hash_uniform(key, seed=seed) < R.SVM_SAMPLE / n).select(*names).toPandas()
        z = mapped((chosen if len(chosen) else feats.select(*names).limit(1).toPandas()).to_numpy(dtype=np.float64))
        margins = _Margins(_packed(feats.select(*[F.col(c).cast("double") for c in names])), mapped, rough, n, n_components)
        corners: list[np.ndarray] = []
        while True:
            # the whole sample's steps, then those of its quarters, whose noise differs: near the end they show new corners
            steps = _hull_steps(corners, z, nu, gap / 50, R.SVM_DIRECTIONS)
            size = max(float(steps[-1] @ steps[-1]), 1e-6)
            if corners:
                for k in range(4):
                    steps += _hull_steps(corners, z[k::4], nu, gap / 50, 1 + R.SVM_DIRECTIONS // 4)[1:]
            dirs = np.array(steps)
            sample = np.sort(z @ dirs.T, axis=0)
            at = nu * len(z)
            lo, hi = sample[int(at * 0.6)] if at >= 50 else sample[0], sample[min(int(at * 1.5) + 1, len(z) - 1)]
            slack = (hi - lo) * 0.02 + 1e-9
            low, ends = margins.lowest(dirs, lo - slack, hi + slack, nu, 0.2 * gap * size)
            if corners:   # the first direction is w
                rho = float(ends[0])
                if w @ (w - low[0]) + 0.2 * gap * size <= gap * max(float(w @ w), 1e-6):
                    break
            points = np.array(corners + list(low))
            a = nearest_point(points @ points.T)
            nearer = a @ points
            if corners and nearer @ nearer >= w @ w * (1 - 1e-12):  # no nearer point: as far as doubles go
                break
            w, corners = nearer, [p for p, x in zip(points, a) if x > 0]
        passes = margins.passes
    return {"mean": mean, "std": std, "w_rff": w_rff, "b_rff": b_rff, "w": w, "rho": rho,
            "n_components": n_components, "passes": passes}


def svm_raw(feats: DataFrame, model: dict, names=FEATURES, out: str = "_svm_score_raw") -> DataFrame:
    """``feats`` with -(decision function) of every row; only the features go to Python."""
    bc = feats.sparkSession.sparkContext.broadcast(model)
    names = list(names)

    @F.pandas_udf("double")
    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        m = bc.value
        scale = math.sqrt(2.0 / m["n_components"])
        for pdf in it:
            x = (pdf[names].to_numpy(dtype=np.float64) - m["mean"]) / m["std"]
            yield pd.Series(m["rho"] - scale * np.cos(x @ m["w_rff"] + m["b_rff"]) @ m["w"])

    return feats.withColumn(out, score(F.struct(*names)))


def svm_score(feats: DataFrame, model: dict, names=FEATURES, out: str = "svm_score") -> DataFrame:
    """The raw score min-max scaled over the population."""
    return scaled(svm_raw(feats, model, names, out=f"_{out}_raw"), {f"_{out}_raw": out})


# ------------------------------------------------------------------ D13-D15 explanations
def feature_contributions(feats: DataFrame, params: DataFrame, names=FEATURES) -> DataFrame:
    """|x - baseline mean| per feature as a map column."""
    j = feats.join(F.broadcast(params.select(*[f"mean_{f}" for f in names])), F.lit(True), "inner")
    kv = []
    for f in names:
        kv += [F.lit(f), F.abs(F.col(f) - F.col(f"mean_{f}"))]
    return j.select("id", F.create_map(*kv).alias("contributions"))


def explanation_a(score_col: str = "anomaly_score") -> Column:
    """Ordered reasons joined with '; ' and the score to three places."""
    kr = F.col("keyword_risk")
    reasons = F.array_compact(F.array(
        F.when(F.col("after_hours") == 1, F.format_string("activity at unusual hour (%02d:00)",
                                                          F.col("hour_of_day").cast("int"))),
        F.when(kr >= 0.85, F.lit("high-risk keywords detected")).when(kr >= 0.60, F.lit("suspicious keywords present")),
        F.when(F.col("has_failure_signal") == 1, F.lit("authentication/access failure")),
        F.when(F.col("has_privilege_signal") == 1, F.lit("privilege escalation activity")),
        F.when(F.col("severity_level") >= 4, F.lit("high severity event")),
        F.when(F.col("message_length") > 300, F.lit("unusually long message")),
        F.when(F.col("source_risk") >= 0.60, F.lit("high-risk source")),
    ))
    score = F.format_string("%.3f", F.col(score_col))
    return F.when(F.size(reasons) > 0,
                  F.concat(F.lit("Anomaly (score "), score, F.lit("): "), F.array_join(reasons, "; "))) \
        .otherwise(F.concat(F.lit("Statistical anomaly detected (score "), score, F.lit(")")))


def explanation_b(score_col: str = "anomaly_score") -> Column:
    """The explainer's rules (hour, severity, length, missing process)."""
    hour = F.col("hour_of_day").cast("int")
    sev = F.col("severity_level")
    ml = F.col("message_length").cast("int")
    reasons = F.array_compact(F.array(
        F.when((hour < 6) | (hour > 22), F.format_string("unusual activity time (%02d:00)", hour)),
        F.when(sev.cast("int") >= 4, F.lit("critical/high severity event")),
        F.when(ml > 1000, F.lit("extremely long log message")).when(ml < 5, F.lit("suspiciously short message")),
        F.when((F.col("has_process") == 0) & (sev >= 3), F.lit("high-severity event with no process information")),
    ))
    score = F.format_string("%.3f", F.col(score_col))
    return F.when(F.size(reasons) > 0,
                  F.concat(F.lit("Anomaly (score: "), score, F.lit(") - "), F.array_join(reasons, "; "))) \
        .otherwise(F.concat(F.lit("Statistical anomaly detected (score: "), score, F.lit(")")))
