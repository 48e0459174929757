"""Spark session and cluster-level settings.

Only settings a job needs for correct results are forced (UTC session time
zone, AQE). Anything the cluster already defines (checkpoint dir, shuffle
partitions, memory) is read from the session and left alone.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes,
# coalesces tiny shuffle partitions and splits skewed join partitions.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "textlake",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or attach to) a session. ``master`` is only set for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("TEXTLAKE_DRIVER_MEM", "16g"))
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required runtime settings to an existing session."""
    for k, v in REQUIRED_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: keep the cluster's value
            pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is used as is.
    Only a local session that has none gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="textlake-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint_root(spark: SparkSession) -> str:
    """Folder (on shared storage) for staged tables and streaming checkpoints."""
    d = ensure_checkpoint_dir(spark)
    return d.rstrip("/")


def materialize(df):
    """Cut a long lineage before iterative work (model fits, sweeps): a
    reliable checkpoint written to ``spark.checkpoint.dir``, so a lost
    executor does not force recomputing the whole upstream plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df):
    """Write ``df`` as Parquet in the shared folder and read it back. Unlike a
    checkpoint its size is known to the planner, which so chooses the join."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/staged-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def release(spark) -> None:
    """Let Spark delete the shuffle files and blocks that no plan refers to any more.
    It does so only when the driver collects its garbage, by itself every half hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df) -> None:
    """Delete the files of a ``staged`` table that nobody reads any more, and release its shuffles."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    release(spark)
