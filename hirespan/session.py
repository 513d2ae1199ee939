"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every query relies on; all can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Streams keep keys for good; their state lies on disk and not in the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hirespan")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in RUNTIME_CONF.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session made elsewhere."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


_LOCAL: dict[str, str] = {}  # by application


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's checkpoint folder.

    Only a local session that names none (tests, a laptop) gets a temporary folder; a session whose
    executors run elsewhere is refused, as each would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="hirespan-")
        _LOCAL[context.applicationId] = root
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
