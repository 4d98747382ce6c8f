"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import os

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "slotline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with this library's defaults; ``extra`` uses ``__`` for dots in setting names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in extra.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def pin_time_zone(spark: SparkSession) -> None:
    """Slot arithmetic is done on UTC instants; make the session agree."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Typed keyed state (lists, maps, timers) needs the store on local disk; it is backed up with the checkpoint."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named


def default_shared_folder(spark: SparkSession, folder: str) -> None:
    """For entry points that run on one machine: name a shared folder where the session has none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)


def _on_storage(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove_folder(spark: SparkSession, path: str) -> None:
    storage, where = _on_storage(spark, path)
    storage.delete(where, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; what is written there goes when the application ends."""
    owned = f"{shared_folder(spark).rstrip('/')}/slotline/{label}-{os.urandom(6).hex()}"
    storage, where = _on_storage(spark, owned)
    storage.mkdirs(where)
    storage.deleteOnExit(where)
    return f"{owned}/data"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of frames that nothing refers to any more.

    Spark finds out at the next collection of the driver's heap, which in a long chain of written tables comes late.
    """
    gc.collect()
    spark._jvm.System.gc()


BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Rows may be long texts: what a Python worker gets at a time is bounded by bytes, not only by rows. A bound set in another unit, or a lower one, stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(name).rstrip("bB")
    if known.isdigit() and int(known) > most:
        spark.conf.set(name, str(most))


class Staging:
    """Owner of the intermediate tables of one operator.

    ``keep`` writes a table below the shared folder and reads it back: the expensive part runs once, readers
    prune its columns, and a lost executor costs a re-read instead of a recomputation of the history.
    ``drop`` removes tables that nothing reads any more, and leaving the context removes all of them. Tables
    that back a returned frame are made without the context (``stage``) and go with the application.
    """

    def __init__(self, spark: SparkSession, label: str = "stage") -> None:
        self.spark, self.label, self.paths = spark, label, {}
        bound_batches(spark)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names or list(self.paths):
            remove_folder(self.spark, self.paths.pop(name))
        free_shuffles(self.spark)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *raised) -> None:
        self.drop()


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage of ``df`` with a table that stays until the application ends."""
    return Staging(df.sparkSession, label).keep(df, "table")
