"""Stream ingest: validation, slot aggregation, sessions and append-only logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators import timeseries as ts
from slotline.operators.activity import event_key

WATERMARK = "2 hours"


def rules() -> dict[str, Column]:
    """What makes an ingest row invalid, per column. Only the measurement itself is required."""
    between = lambda c, low, high: (F.col(c) < low) | (F.col(c) > high)
    stamp = F.col("timestamp")
    return {
        "occupancy": F.col("occupancy").isNull() | F.isnan("occupancy") | (F.col("occupancy") < 0),
        "queue_length": between("queue_length", 0, fixed.QUEUE_LIMIT),
        "is_special_day": between("is_special_day", 0, 1),
        "capacity": (F.col("capacity") <= 0) | F.isnan("capacity"),
        "timestamp": stamp.isNotNull() & F.try_to_timestamp(stamp).isNull(),
        "traffic_condition_nearby": ~F.col("traffic_condition_nearby").isin(*fixed.TRAFFIC_LEVELS),
    }


def validate(events: DataFrame, known: DataFrame, key: str = "system_code") -> DataFrame:
    """Each event with ``problems`` (broken rules, comma separated) and ``is_valid``.

    ``known`` is the site list; whether it is broadcast is left to its measured size.
    """
    marked = events.join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    broken = [F.when(F.col("_known").isNull(), F.lit("unknown_key"))]
    broken += [F.when(test, F.lit(name)) for name, test in rules().items()]
    return (
        marked.withColumn("problems", F.concat_ws(",", *broken))
        .withColumn("is_valid", F.col("problems") == "")
        .drop("_known")
    )


def with_defaults(valid: DataFrame) -> DataFrame:
    """Defaults of the optional ingest fields."""
    return valid.withColumns(
        {
            "queue_length": F.coalesce("queue_length", F.lit(0)),
            "is_special_day": F.coalesce("is_special_day", F.lit(0)),
            "traffic_condition_nearby": F.coalesce("traffic_condition_nearby", F.lit("low")),
        }
    )


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
               files_per_batch: int | None = None) -> DataFrame:
    """A parquet folder as a stream, with a declared schema."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream got with its checkpoint; a fresh checkpoint is another source with batch ids of its own."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def split_stream(events: DataFrame, known: DataFrame, valid_path: str, quarantine_path: str,
                 checkpoint: str) -> StreamingQuery:
    """Valid rows and quarantined rows to their tables, in folders by source (checkpoint) and batch.

    A replayed batch overwrites its own folder and no other; a stream that starts anew adds to what is there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        judged = validate(batch, known).persist()
        own = f"source={checkpoint_id(batch.sparkSession, checkpoint)}/batch={batch_id}"
        good = with_defaults(judged.where("is_valid")).drop("problems", "is_valid")
        good.write.mode("overwrite").parquet(f"{valid_path}/{own}")
        judged.where("NOT is_valid").drop("is_valid").write.mode("overwrite").parquet(
            f"{quarantine_path}/{own}"
        )
        judged.unpersist()

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def slot_stream(observations: DataFrame, key: str = "system_code", time: str = "timestamp",
                delay: str = WATERMARK, minutes: int = fixed.SLOT_MINUTES) -> DataFrame:
    """The batch slot aggregation on a stream; a slot is emitted once the watermark has passed it."""
    slotted = observations.withColumn("time_slot", X.slot_round(time, minutes)).withWatermark(
        "time_slot", delay
    )
    return slotted.groupBy(key, "time_slot").agg(
        F.min("record_id").alias("record_id"),
        F.min(time).alias(time),
        F.max("capacity").alias("capacity"),
        F.max("is_special_day").alias("is_special_day"),
        *[
            F.avg(X.nan_to_null(c)).alias(c)
            for c in ("latitude", "longitude", "occupancy", "queue_length")
        ],
        *[ts.mode_smallest(c).alias(c) for c in ("vehicle_type", "traffic_condition_nearby")],
    )


def session_stream(observations: DataFrame, key: str = "system_code", time: str = "timestamp",
                   delay: str = WATERMARK, minutes: int = fixed.SLOT_MINUTES) -> DataFrame:
    """Runs of touching slots as session windows: first and last slot and readings."""
    slotted = observations.withColumn("time_slot", X.slot_round(time, minutes)).withWatermark(
        "time_slot", delay
    )
    return (
        slotted.groupBy(key, F.session_window("time_slot", f"{minutes} minutes").alias("session"))
        .agg(F.count(F.lit(1)).alias("readings"))
        .select(
            key,
            F.col("session.start").alias("session_start"),
            (F.col("session.end") - F.expr(f"INTERVAL {minutes} MINUTES")).alias("session_last_slot"),
            "readings",
        )
    )


def log_stream(events: DataFrame, parts: list[str], path: str, checkpoint: str,
               key: str = "entry_key") -> StreamingQuery:
    """Append-only log with a deterministic key per entry, exactly once through the checkpoint."""
    return (
        events.withColumn(key, event_key(*parts))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a table and read the table."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
