"""Session defaults shared by jobs, tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that are safe on a laptop and on a cluster alike.  Partition
#: counts are left to AQE: it coalesces small shuffles and splits skewed ones.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    # plain TIMESTAMP on read, so that time filters reach the Parquet scan
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "palisade", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the defaults above; ``conf`` entries win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    fall back to a temporary folder, since executors there share the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    local = os.path.join(tempfile.gettempdir(), f"palisade-ckpt-{os.getpid()}")
    os.makedirs(local, exist_ok=True)
    return local


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever its file system keeps it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints; it goes when the program ends.

    What is read from it stays readable until then, also lazily.
    """
    path = os.path.join(checkpoint_dir(spark), f"palisade-{name}-{uuid.uuid4().hex}")
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH.append((spark, path))
    return path


_SCRATCH: list[tuple[SparkSession, str]] = []


def _clean() -> None:
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            remove_folder(spark, path)
        except Exception:  # the session has ended first; the folder is all that is left
            continue


def truncate_lineage(df):
    """Cut a plan with a reliable checkpoint, which survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
