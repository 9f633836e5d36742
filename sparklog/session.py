"""SparkSession construction and the few session settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library expects.  They are applied with
# ``spark.conf.set`` on an existing session too, so a cluster session keeps its
# own resources and only gains these semantics.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # key=value lines repeat keys; the last one wins (plain maps raise by default)
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "sparklog") -> SparkSession:
    """Local/test session.  On a cluster pass the existing session to :func:`configure`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("SPARKLOG_DRIVER_MEMORY", "16g"))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` exists in its file system (errors other than absence rise)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder; set a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    Only a session without it (a local test) gets a fresh scratch folder, set on the
    SparkContext (the conf key itself cannot be changed at runtime).
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparklog-ckpt-"))
    return sc.getCheckpointDir()


def materialized(df: DataFrame, what: str, **options) -> DataFrame:
    """``df`` written once to the shared folder and read back: computed once, whoever reads it and whichever executor is
    lost, with a short plan and prunable columns.  ``options`` go to the writer."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
