"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of the package expects; all can change at run time.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

RUNTIME_CONF = {
    # Instants are stored in UTC; business days are computed with a fixed +08:00 shift.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small tasks after a shuffle: a row of an order may unfold to six long messages in the task that reads it.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Hot join keys are split at run time, even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State with timers and maps needs it, and it does not live on the heap.
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
}

# Settings fixed when a session starts. Call sites of column expressions only serve error messages.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply RUNTIME_CONF to a session made by somebody else."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "waybill", master: str | None = None, **conf: str) -> SparkSession:
    """Session for scripts and tests; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**START_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below spark.checkpoint.dir, the folder all executors can reach.

    Where the setting is absent a local master gets a temporary folder; on a cluster that would
    be a folder of one machine only, so the call fails there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="waybill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/waybill-{purpose}-{uuid.uuid4().hex}"
