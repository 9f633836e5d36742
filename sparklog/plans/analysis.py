"""End-to-end anomaly analysis as one Spark plan.

scan -> 20 features -> detector scores (columns of one frame) -> blend ->
rescale -> exact 85th percentile -> accept -> severity + explanation ->
ATT&CK mapping -> anomalies (+ one session row).

The scored frame is persisted once: the population statistics (min/max, the
percentile) each need a pass over it, and recomputing the features for every pass
would cost more than keeping them.  Executor loss only drops cached blocks, which
Spark recomputes from the lineage.
"""

from __future__ import annotations

import datetime as _dt
import json

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions import rules as R
from ..operators import detect as D
from ..operators import features as FE
from ..operators import mitre as M
from ..session import materialized, path_exists

SUPPORTED = ("ensemble", "isolation_forest", "one_class_svm", "statistical")
KEEP = ("id", "timestamp", "source", "event_id", "event_type", "severity", "message")


def resolve_algorithm(requested: str, total_logs: int) -> str:
    """Explicit names pass; auto/adaptive/flexible pick by size; anything else -> ensemble."""
    norm = (requested or "").strip().lower()
    if norm in SUPPORTED:
        return norm
    if norm in ("auto", "adaptive", "flexible"):
        if total_logs < R.AUTO_STATISTICAL_BELOW:
            return "statistical"
        if total_logs > R.AUTO_FOREST_ABOVE:
            return "isolation_forest"
        return "ensemble"
    return "ensemble"


class Model:
    """Fitted parameters of one run (D11): encoders, z-score params, forest, SVM."""

    def __init__(self, encoders=None, zparams=None, forest=None, svm=None):
        self.encoders = encoders
        self.zparams = zparams
        self.forest = forest
        self.svm = svm

    PARAMS = {"n_trees": R.ISOLATION_TREES, "sample_size": R.ISOLATION_SAMPLE, "svm_gap": R.SVM_GAP,
              "zscore_threshold": R.ZSCORE_THRESHOLD, "seed": R.RANDOM_SEED}

    def save(self, path: str) -> None:
        """Parquet tables + one JSON/npz file per array model, under ``path``."""
        if self.encoders is not None:
            self.encoders[0].write.mode("overwrite").parquet(f"{path}/source_codes")
            self.encoders[1].write.mode("overwrite").parquet(f"{path}/event_type_codes")
        if self.zparams is not None:
            self.zparams.write.mode("overwrite").parquet(f"{path}/zscore")
        if self.forest is not None:
            self.forest.write.mode("overwrite").parquet(f"{path}/forest")
        if self.svm is not None:
            spark = SparkSession.getActiveSession()
            row = {k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in self.svm.items()}
            spark.createDataFrame([(json.dumps(row),)], "model string").write.mode("overwrite").json(f"{path}/svm")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(len(R.FEATURE_NAMES), "v1", json.dumps(self.PARAMS, sort_keys=True))],
                              "n_features int, version string, params string") \
            .write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, n_features: int = len(R.FEATURE_NAMES)) -> "Model | None":
        """The stored model, or None when missing or fitted for another feature count."""
        if not path_exists(spark, f"{path}/meta"):
            return None
        meta = spark.read.json(f"{path}/meta").first()
        if meta is None or meta["n_features"] != n_features:
            return None
        if "params" in meta.asDict() and meta["params"] != json.dumps(cls.PARAMS, sort_keys=True):
            return None   # fitted with other parameters: retrain

        def opt(sub):
            return spark.read.parquet(f"{path}/{sub}") if path_exists(spark, f"{path}/{sub}") else None
        enc = (opt("source_codes"), opt("event_type_codes"))
        svm = None
        if path_exists(spark, f"{path}/svm"):
            js = json.loads(spark.read.json(f"{path}/svm").first()["model"])
            svm = {k: (np.asarray(v) if isinstance(v, list) else v) for k, v in js.items()}
        return cls(enc if enc[0] is not None else None, opt("zscore"), opt("forest"), svm)


def score_logs(logs: DataFrame, algorithm: str = "ensemble", model: Model | None = None,
               with_keywords: bool = True, persist: bool = True,
               approx_accuracy: int | None = None) -> tuple[DataFrame, dict, Model]:
    """Score every log: returns (frame with anomaly_score and prediction, info, fitted model)."""
    model = model or Model()
    feats, model.encoders = FE.feature_frame_and_encoders(logs, keep=KEEP, encoders=model.encoders)
    feats = feats.withColumn("keyword_score", D.keyword_score_expr())
    if persist:
        # written once: every parameter aggregate and every pass of a fit below reads it
        feats = materialized(feats, "features")
        n_rows = feats.count()
    else:
        n_rows = None
    base, members = feats, []   # what members are fitted on: no member's own score is computed for it
    if algorithm in ("statistical", "ensemble"):
        if model.zparams is None:
            model.zparams = D.zscore_fit(feats).persist(StorageLevel.MEMORY_AND_DISK)
        feats = D.zscore_score(feats, model.zparams)
        members.append("statistical")
    failed, raw = [], {}
    if algorithm in ("isolation_forest", "ensemble"):
        try:
            if model.forest is None:
                model.forest = D.forest_fit(base, n=n_rows).persist(StorageLevel.MEMORY_AND_DISK)
            feats = D.forest_raw(feats, model.forest)
            raw["_if_score_raw"] = "if_score"
            members.append("isolation_forest")
        except (ValueError, ArithmeticError, np.linalg.LinAlgError):  # a member that can't be fitted counts 0
            failed.append("isolation_forest")
            feats = feats.withColumn("if_score", F.lit(0.0))
    if algorithm in ("one_class_svm", "ensemble"):
        try:
            if model.svm is None:
                model.svm = D.svm_fit(base)
            feats = D.svm_raw(feats, model.svm)
            raw["_svm_score_raw"] = "svm_score"
            members.append("one_class_svm")
        except (ValueError, ArithmeticError, np.linalg.LinAlgError):
            failed.append("one_class_svm")
            feats = feats.withColumn("svm_score", F.lit(0.0))
    if raw:
        feats = D.scaled(feats, raw)
    col_of = {"statistical": "stat_score", "isolation_forest": "if_score", "one_class_svm": "svm_score",
              "keyword": "keyword_score"}
    if algorithm == "ensemble":
        weights = [(col_of[name], w) for name, w in R.ENSEMBLE_WEIGHTS]
        if not with_keywords:
            weights = [(c, w) for c, w in weights if c != "keyword_score"]
    else:
        weights = [(col_of[algorithm], R.SINGLE_MODEL_WEIGHT if with_keywords else 1.0)]
        if with_keywords:
            weights.append(("keyword_score", R.SINGLE_KEYWORD_WEIGHT))
    blended = D.blend(feats, weights, "combined")
    if persist and not raw:   # ``scaled`` has written the raw scores: the rest is a projection of them
        blended = materialized(blended, "scores")
    final, n = D.redistribute(blended, "combined", "anomaly_score", return_count=True)
    scored, thr = D.percentile_cut(final, "anomaly_score", n=n, approx_accuracy=approx_accuracy)
    return scored, {"algorithm": algorithm, "percentile_threshold": thr, "members": members, "failed": failed}, model


def accepted_anomalies(scored: DataFrame, techniques: DataFrame, algorithm: str,
                       threshold: float = R.DEFAULT_ACCEPT_THRESHOLD, detected_at=None,
                       session_id: str | None = None) -> DataFrame:
    """F09 + G01 + D14 + M01: the anomaly rows of a scored frame."""
    acc = scored.filter((F.col("prediction") == -1) & (F.col("anomaly_score") >= F.lit(threshold)))  # F09
    feat_map = F.create_map(*[x for n in R.FEATURE_NAMES for x in (F.lit(n), F.col(n))])
    acc = acc.select(
        F.col("id").alias("log_id"), "anomaly_score", F.lit(algorithm).alias("algorithm"),
        X.stored_severity("anomaly_score").alias("severity"),
        feat_map.alias("features"), D.explanation_a().alias("explanation"),
        (F.lit(detected_at) if detected_at is not None else F.col("timestamp")).alias("detected_at"),
        F.lit(session_id).cast("string").alias("session_id"),
        "event_id", "event_type", "message")
    mapped = M.map_techniques(acc, techniques, key="log_id")
    return mapped.drop("event_id", "event_type", "message")


def analyze_logs(logs: DataFrame, techniques: DataFrame, algorithm: str = "ensemble",
                 threshold: float = R.DEFAULT_ACCEPT_THRESHOLD, start=None, end=None, source: str | None = None,
                 session_id: str = "session", as_of=None, model: Model | None = None,
                 model_path: str | None = None, force_retrain: bool = False) -> tuple[DataFrame, DataFrame]:
    """(anomalies, session row) of one analysis run.

    D11: with ``model_path`` a stored model is reused unless it was fitted for
    another feature count or other parameters, or ``force_retrain`` is set; a newly
    fitted model is saved there.
    """
    spark_ = logs.sparkSession
    if model is None and model_path and not force_retrain:
        model = Model.load(spark_, model_path)
    fitted_here = model is None
    from ..operators.filters import analysis_scan
    scan = analysis_scan(logs, start, end, source)
    norm = (algorithm or "").strip().lower()
    # the row count is only needed to resolve an automatic algorithm choice
    n = scan.count() if norm not in SUPPORTED else None
    algo = resolve_algorithm(algorithm, n or 0)
    as_of = as_of or _dt.datetime.utcnow()
    scored, info, fitted = score_logs(scan, algo, model)
    if model_path and fitted_here:
        fitted.save(model_path)
    anomalies = accepted_anomalies(scored, techniques, algo, threshold, as_of, session_id)
    params = json.dumps({"algorithm": algo, "start_time": start.isoformat() if start else None,
                         "end_time": end.isoformat() if end else None, "threshold": threshold,
                         "log_source": source})
    # one lazy row: counts come from the (persisted) scored frame when the caller asks for it
    session = (scored.agg(F.count(F.lit(1)).alias("logs_analyzed"))
               .crossJoin(anomalies.agg(F.count(F.lit(1)).alias("anomalies_detected")))
               .select(F.lit(session_id).alias("session_id"), X.instant(as_of).alias("start_time"),
                       X.instant(as_of).alias("end_time"), F.lit("completed").alias("status"),
                       "logs_analyzed", "anomalies_detected", F.lit(params).alias("parameters")))
    return anomalies, session
