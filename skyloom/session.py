"""Session builder and the few places that depend on session settings."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        STATE_PROVIDER: ROCKSDB,
        # Many distinct plans run in one session; the default of 100 entries recompiles them.
        "spark.sql.codegen.cache.maxEntries": "2000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = _OWN_DIR.get("path")
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        own = _OWN_DIR["path"] = tempfile.mkdtemp(prefix="skyloom-", dir=os.environ.get("TMPDIR"))
        forget_at_end(spark, own)
    return own


def forget_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder of intermediate data deleted when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


_OWN_DIR: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and go on from the written table.

    The result is computed once, survives the loss of executors, ends the growth of an iterative
    plan, and tells the planner its real size. The table goes when the application ends.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store_ready(spark: SparkSession):
    """Keyed state of the streaming operators needs the RocksDB provider; restored afterwards."""
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, before)
