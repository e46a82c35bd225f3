"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Only runtime SQL settings: they hold for any cluster and fix no partition count.
# Skew splitting is allowed even where it costs a further exchange.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the plans of this package are written for."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


@contextmanager
def files_of_shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What runs or starts inside drops the shuffle files of each execution at its end.

    Otherwise they stay until the driver collects its garbage, which over the micro-batches of a
    stream fills the disks.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def use_incremental_state(spark: SparkSession) -> SparkSession:
    """Keep streaming state in RocksDB and checkpoint only its changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    spark.conf.set(
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"
    )
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares between its machines.

    The cluster names it in ``spark.checkpoint.dir``. A machine-local folder is
    taken only for a local session, where one machine is all there is.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
        return tempfile.mkdtemp(prefix="navspark-")
    return f"{base.rstrip('/')}/navspark-{uuid.uuid4()}"
