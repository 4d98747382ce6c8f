"""The live board as versioned tables: seed, upsert per micro-batch, reset, rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from slotline.operators import figures as F_
from slotline.operators.activity import upsert_latest
from slotline.streaming.ingest import checkpoint_id

KEPT_VERSIONS = 5  # readers of an older version must have finished by then


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, ascending. A version counts once its success marker exists."""
    at, fs, jvm = _file_system(spark, path)
    if not fs.exists(at):
        return []
    found = []
    for item in fs.listStatus(at):
        name = item.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(item.getPath(), "_SUCCESS")
        if name.startswith("v") and name[1:].isdigit() and fs.exists(done):
            found.append(int(name[1:]))
    return sorted(found)


def read_board(spark: SparkSession, path: str) -> DataFrame | None:
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/v{known[-1]:012d}") if known else None


def read_beside(spark: SparkSession, path: str, beside: str) -> DataFrame | None:
    """What is kept below ``beside`` for the newest version of the board."""
    known = versions(spark, path)
    return spark.read.parquet(f"{beside}/v{known[-1]:012d}") if known else None


def write_version(df: DataFrame, path: str, number: int) -> None:
    """A version becomes visible only when complete, so readers never see half a board."""
    df.write.mode("overwrite").parquet(f"{path}/v{number:012d}")


def seed_if_empty(baseline: DataFrame, path: str) -> bool:
    if versions(baseline.sparkSession, path):
        return False
    write_version(baseline, path, 0)
    return True


def merged_until(spark: SparkSession, path: str, source: str) -> int:
    """Number of the last micro-batch of ``source`` that the board holds; -1 when there is none.

    The newest version carries one marker per source, whatever came before it, so a reset or a
    second source changes nothing about what a source has delivered.
    """
    return _merged(spark, path).get(source, -1)


def _merged(spark: SparkSession, path: str) -> dict[str, int]:
    at, fs, jvm = _file_system(spark, path)
    last: dict[str, int] = {}
    # Where a crash cut off the markers of a version, those of the one before hold.
    for number in reversed(versions(spark, path)):
        for item in fs.listStatus(jvm.org.apache.hadoop.fs.Path(at, f"v{number:012d}")):
            name = item.getPath().getName()
            if name.startswith("_merged."):
                source, _, batch = name.removeprefix("_merged.").rpartition(".")
                last[source] = max(last.get(source, -1), int(batch))
        if last:
            break
    return last


def _settle(spark: SparkSession, path: str, number: int, merged: dict[str, int]) -> None:
    """Mark what version ``number`` holds and remove versions that no reader needs any more."""
    at, fs, jvm = _file_system(spark, path)
    for source, batch in merged.items():
        fs.create(jvm.org.apache.hadoop.fs.Path(at, f"v{number:012d}/_merged.{source}.{batch}")).close()
    for old in versions(spark, path)[:-KEPT_VERSIONS]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(at, f"v{old:012d}"), True)


def reset(baseline: DataFrame, path: str) -> int:
    """Put the baseline back as the newest version."""
    known = versions(baseline.sparkSession, path)
    number = known[-1] + 1 if known else 0
    merged = _merged(baseline.sparkSession, path)
    write_version(baseline, path, number)
    _settle(baseline.sparkSession, path, number, merged)
    return number


def upsert_batch(batch: DataFrame, path: str, batch_id: int, key: str, order: list[str],
                 source: str = "batch", beside: Callable[[int | None, int, DataFrame, DataFrame], None] | None = None) -> bool:
    """Merge one micro-batch of ``source`` into the board as its next version.

    A batch id that this source has delivered before changes nothing; version numbers are only an order. ``beside`` gets the version before, the new
    version, and the rows of the changed keys before and after, and keeps what follows from the board; it is done before the version becomes visible.
    """
    spark = batch.sparkSession
    merged = _merged(spark, path)
    if merged.get(source, -1) >= batch_id:
        return False
    known = versions(spark, path)
    board = read_board(spark, path)
    rows = upsert_latest(batch.limit(0) if board is None else board, batch, key, order)
    number = known[-1] + 1 if known else 0
    if beside is not None:
        keys = batch.select(key).distinct()
        old = batch.limit(0) if board is None else board.join(keys, key, "left_semi")
        beside(known[-1] if known else None, number, old, upsert_latest(old, batch, key, order))
    write_version(rows, path, number)
    # Merging the same batch twice gives the same board, so a crash before the markers does no harm.
    _settle(spark, path, number, merged | {source: batch_id})
    return True


def board_stream(changes: DataFrame, path: str, checkpoint: str, key: str, order: list[str],
                 prepare: Callable[[DataFrame], DataFrame] | None = None, figures: str | None = None) -> StreamingQuery:
    """Keep the board current from a stream. ``prepare`` adds context and scores per micro-batch.

    With ``figures``, a path, the headline figures of every version are kept there too, by differences.
    """

    def keep(before: int | None, number: int, old: DataFrame, new: DataFrame) -> None:
        known = None if before is None else old.sparkSession.read.parquet(f"{figures}/v{before:012d}")
        write_version(F_.after_changes(known, old, new), figures, number)


    def merge(batch: DataFrame, batch_id: int) -> None:
        source = checkpoint_id(batch.sparkSession, checkpoint)
        upsert_batch(prepare(batch) if prepare else batch, path, batch_id, key, order, source, keep if figures else None)

    return (
        changes.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
