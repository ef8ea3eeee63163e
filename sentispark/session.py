"""Session defaults and the shared working folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Functions of this package travel to the tasks by value, so the executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["sentispark"])

_DIR_KEY = "spark.checkpoint.dir"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, app: str = "sentispark", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Checkpoint files go when nothing refers to them any more; a stream makes some per batch.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a fresh temporary folder; a cluster
    session must name one, since a machine-local folder would not survive a lost executor.
    """
    configured = spark.conf.get(_DIR_KEY, None)
    if configured:
        folder = configured
    elif spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    elif spark.sparkContext.master.partition("[")[0] == "local":
        folder = tempfile.mkdtemp(prefix="sentispark-")
    else:
        raise ValueError(f"set {_DIR_KEY} to a folder shared by all executors")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df):
    """Write ``df`` to the shared folder once and read it from there on (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def use_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
