"""Spark session helpers.

The library never creates its own scratch space on a cluster: lineage is cut
with ``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``. Only when that setting is missing (local tests) do we
point it at a fresh folder of our own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # per-config top-k (sweeps) uses row_number() <= k; let Catalyst insert
    # WindowGroupLimit for every k the reference's grids use
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # generated methods above 8,000 bytecode bytes stay with the JVM's interpreter; such plans
    # run operator by operator instead, in methods short enough to be compiled
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# The p-normal kernels compile to large generated methods; without this flag the
# JVM leaves methods above 8,000 bytecode bytes to its interpreter.
_JVM_FLAGS = "-XX:-DontCompileHugeMethods"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "corelev") -> SparkSession:
    """Return (or create) a session configured for this library."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("CORELEV_DRIVER_MEMORY", "4g"))
    builder = builder.config("spark.driver.extraJavaOptions", _JVM_FLAGS)
    builder = builder.config("spark.executor.extraJavaOptions", _JVM_FLAGS)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; a temporary one is set only where it is unset and the master is local."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            current = tempfile.mkdtemp(prefix="corelev-ckpt-", dir="/tmp")
        sc.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so tasks import it from any working directory."""
    import shutil
    import tempfile

    sc = spark.sparkContext
    if getattr(sc, "_corelev_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    zipped = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="corelev-code-"), "corelev"), "zip",
                                 os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(zipped)
    sc._corelev_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the session's (shared) checkpoint folder."""
    import uuid

    return os.path.join(ensure_checkpoint_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:8]}")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's SQL defaults to an existing session (runtime confs only)."""
    for k, v in _DEFAULTS.items():
        if k.startswith("spark.ui"):
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session
            pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark
