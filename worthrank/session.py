"""Session helpers: building a local session for tests/bench and locating shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "worthrank") -> SparkSession:
    """A session with AQE on and the UI off. Cluster deployments pass their own conf."""
    master = master or os.environ.get("WORTHRANK_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WORTHRANK_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint directory of the cluster.

    Taken from the session (``spark.checkpoint.dir`` or an earlier ``setCheckpointDir``).
    Only a local-mode session without one gets a private temporary directory; a cluster
    session without a shared directory is a configuration error, never a local fallback.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="worthrank-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError("set spark.checkpoint.dir to a shared directory (HDFS/S3/...) for this cluster")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint directory for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/worthrank-{name}-{uuid.uuid4().hex[:12]}"


def tasks_for(df: DataFrame, rows_per_task: int = 100_000) -> int:
    """Tasks for a step that must be dealt out by hand: as many as the rows need, and one per core at least.
    Counts the rows, so a frame that is dear to compute is materialised first."""
    return max(int(df.sparkSession.sparkContext.defaultParallelism), -(-df.count() // rows_per_task))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``worthrank`` importable in the Python workers of this application (what
    ``--py-files`` does): the package is zipped once on the driver and added with ``addPyFile``,
    which Spark distributes to every executor. Needed before ``mapInPandas`` closures that refer
    to package functions run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="worthrank-pyfiles-"), "worthrank.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
