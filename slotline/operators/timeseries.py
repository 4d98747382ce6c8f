"""Slot tables: aggregation, sessions, lags, rolling means, leads, latest rows.

A raw feed can be heavily skewed towards one key, so the only step that sees raw rows is
``slot_aggregate``: a (key, slot) aggregation with map-side combine. Everything after it works
on at most one row per key and slot (48 per day at 30 minutes), which bounds what a
window over one key can hold regardless of how many raw rows that key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X


def mode_smallest(column: str) -> Column:
    """Most frequent value, smallest on ties, null when all are null."""
    return F.mode(F.col(column), True)


def slot_aggregate(
    df: DataFrame,
    key: str = "system_code",
    time: str = "timestamp",
    slot: str = "time_slot",
    minutes: int = fixed.SLOT_MINUTES,
    smallest: Sequence[str] = ("record_id", "timestamp"),
    largest: Sequence[str] = ("capacity", "is_special_day"),
    averaged: Sequence[str] = ("latitude", "longitude", "occupancy", "queue_length"),
    commonest: Sequence[str] = ("vehicle_type", "traffic_condition_nearby"),
) -> DataFrame:
    """One row per key and slot. Rows without key or time belong to no slot.

    Raw rows are combined by slot and ``commonest`` values with fixed-width buffers in generated code; only the few
    combinations of a slot are folded into its row.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    extremes = [F.min(c).alias(c) for c in smallest] + [F.max(c).alias(c) for c in largest]
    sums = [F.sum(X.nan_to_null(c).cast("double")).alias(f"_sum_{c}") for c in averaged]
    counts = [F.count(X.nan_to_null(c)).alias(f"_n_{c}") for c in averaged]
    combined = rows.groupBy(key, X.slot_round(time, minutes).alias(slot), *commonest).agg(
        *extremes, *sums, *counts, F.count(F.lit(1)).alias("_rows")
    )
    for c in commonest:
        often = F.sum("_rows").over(Window.partitionBy(key, slot, c))
        combined = combined.withColumn(f"_top_{c}", F.when(F.col(c).isNotNull(), F.struct((-often).alias("n"), F.col(c).alias("v"))))
    return combined.groupBy(key, slot).agg(
        *extremes,
        *[F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(c) for c in averaged],
        *[F.min(f"_top_{c}")["v"].alias(c) for c in commonest],
    )


def clean_measures(df: DataFrame, null_occupancy: str = "full") -> DataFrame:
    """Cap occupancy to capacity, floor at zero and derive availability and utilization.

    ``null_occupancy="full"`` counts an unknown mean occupancy as a full site;
    ``"keep"`` leaves it unknown.
    """
    if null_occupancy not in ("full", "keep"):
        raise ValueError("null_occupancy must be 'full' or 'keep'")
    raw, cap = X.nan_to_null("occupancy"), F.col("capacity").cast("double")
    capped = F.least(raw, cap)
    if null_occupancy == "keep":
        capped = F.when(raw.isNotNull(), capped)
    return (
        df.withColumns(
            {
                "occupancy_raw": raw,
                "occupancy_clean": X.floor_at(capped),
                "occupancy_anomaly_flag": F.coalesce((raw > cap).cast("int"), F.lit(0)),
                "queue_length": X.floor_at("queue_length"),
            }
        )
        .withColumn("available_spaces", cap - F.col("occupancy_clean"))
        .withColumn("utilization", X.clip(X.ratio("occupancy_clean", "capacity")))
    )


def calendar_features(df: DataFrame, slot: str = "time_slot", minutes: int = fixed.SLOT_MINUTES) -> DataFrame:
    return df.withColumns(X.calendar_columns(slot, minutes))


def ordinal_levels(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "traffic_level": X.ordinal("traffic_condition_nearby", fixed.TRAFFIC_LEVELS),
            "vehicle_priority": X.ordinal("vehicle_type", fixed.VEHICLE_LEVELS),
        }
    )


def stress(df: DataFrame, bounded: bool = True) -> DataFrame:
    return df.withColumn("capacity_pressure", X.capacity_pressure("queue_length", "capacity")).withColumn(
        "parking_stress_index",
        X.stress_index("utilization", "traffic_level", "capacity_pressure", bounded),
    )


def sessionize(
    df: DataFrame, key: str = "system_code", slot: str = "time_slot", minutes: int = fixed.SLOT_MINUTES
) -> DataFrame:
    """Number the runs of consecutive slots of each key, from 1."""
    order = Window.partitionBy(key).orderBy(slot)
    gap = F.unix_seconds(F.col(slot)) - F.unix_seconds(F.lag(slot).over(order))
    return (
        df.withColumn("_gap", gap)
        .withColumn("is_new_session", F.col("_gap").isNull() | (F.col("_gap") != minutes * 60))
        .withColumn(
            "session_id",
            F.sum(F.col("is_new_session").cast("long")).over(
                order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .withColumn("minutes_from_previous", F.coalesce(F.col("_gap") / 60.0, F.lit(0.0)))
        .drop("_gap")
    )


def session_progress(
    df: DataFrame,
    key: str = "system_code",
    session: str = "session_id",
    slot: str = "time_slot",
    counted: str = "record_id",
) -> DataFrame:
    whole = Window.partitionBy(key, session)
    order = whole.orderBy(slot)
    return (
        df.withColumn("session_step", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("session_size", F.count(counted).over(whole))
        .withColumn("session_progress", F.col("session_step") / X.at_least_one("session_size"))
    )


# --- windows with named outputs: {output: (input, offset)} ------------------

IN_SESSION_LAGS = {
    "lag_occupancy_30m": ("occupancy_clean", 1),
    "lag_occupancy_60m": ("occupancy_clean", 2),
    "lag_utilization_30m": ("utilization", 1),
    "lag_utilization_60m": ("utilization", 2),
    "lag_utilization_120m": ("utilization", 4),
    "lag_queue_30m": ("queue_length", 1),
}
ROLLING_MEANS = {
    "rolling_utilization_3": ("utilization", 3),
    "rolling_utilization_6": ("utilization", 6),
    "rolling_queue_3": ("queue_length", 3),
    "rolling_queue_6": ("queue_length", 6),
    "rolling_stress_3": ("parking_stress_index", 3),
}
PREVIOUS_DAY_LAGS = {
    "lag_utilization_prev_day": ("utilization", 1),
    "lag_queue_prev_day": ("queue_length", 1),
    "lag_stress_prev_day": ("parking_stress_index", 1),
}
LEAD_TARGETS = {
    "target_time_slot": ("time_slot", 2),
    "target_occupancy_1h": ("occupancy_clean", 2),
    "target_available_spaces_1h": ("available_spaces", 2),
    "target_utilization_1h": ("utilization", 2),
    "target_stress_1h": ("parking_stress_index", 2),
    "target_time_slot_30m": ("time_slot", 1),
    "target_utilization_30m": ("utilization", 1),
    "target_available_spaces_30m": ("available_spaces", 1),
    "target_time_slot_2h": ("time_slot", 4),
    "target_utilization_2h": ("utilization", 4),
    "target_available_spaces_2h": ("available_spaces", 4),
}


def _within(scope: Sequence[str], slot: str):
    return Window.partitionBy(*scope).orderBy(slot)


def lags(df: DataFrame, spec: dict, scope: Sequence[str] = ("system_code", "session_id"),
         slot: str = "time_slot") -> DataFrame:
    """Values ``offset`` rows back. ``scope`` is (key, session) in batch features, (key,) live."""
    order = _within(scope, slot)
    return df.withColumns({out: F.lag(src, n).over(order) for out, (src, n) in spec.items()})


def leads(df: DataFrame, spec: dict = LEAD_TARGETS, scope: Sequence[str] = ("system_code", "session_id"),
          slot: str = "time_slot") -> DataFrame:
    order = _within(scope, slot)
    return df.withColumns({out: F.lead(src, n).over(order) for out, (src, n) in spec.items()})


def rolling_means(df: DataFrame, spec: dict = ROLLING_MEANS,
                  scope: Sequence[str] = ("system_code", "session_id"), slot: str = "time_slot") -> DataFrame:
    """Mean of up to ``n`` rows strictly before the current one."""
    order = _within(scope, slot)
    return df.withColumns(
        {out: F.avg(src).over(order.rowsBetween(-n, -1)) for out, (src, n) in spec.items()}
    )


def previous_day_lags(df: DataFrame, spec: dict = PREVIOUS_DAY_LAGS, key: str = "system_code",
                      slot_index: str = "slot_index", slot: str = "time_slot") -> DataFrame:
    """Values of the previous available day in the same slot of the day."""
    return lags(df, spec, scope=(key, slot_index), slot=slot)


def deltas(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "utilization_delta_30m": F.col("utilization") - F.col("lag_utilization_30m"),
            "utilization_delta_60m": F.col("utilization") - F.col("lag_utilization_60m"),
        }
    )


def latest_per_key(df: DataFrame, key: str | Sequence[str] = "system_code",
                   order: Sequence[str] = ("time_slot",)) -> DataFrame:
    """The newest row of each key, as an aggregation (one row per key leaves each map task)."""
    keys = [key] if isinstance(key, str) else list(key)
    whole = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.max_by(whole, rank).alias("_row")).select("_row.*")


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of each key in ``order``; a fixed choice, unlike ``dropDuplicates``.

    The rank filter lets Spark cut each map task to one row per key before the shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def sequence_windows(
    df: DataFrame,
    features: Sequence[str] = tuple(fixed.SEQUENCE_FEATURES),
    length: int = fixed.SEQUENCE_LENGTH,
    ahead: int = fixed.HORIZON_STEPS,
    scope: Sequence[str] = ("system_code", "session_id"),
    slot: str = "time_slot",
    target: str = "utilization",
    min_rows: int | None = None,
) -> DataFrame:
    """Fixed-length runs of feature rows with the target ``ahead`` steps later.

    Sessions shorter than ``min_rows`` (default length + 3) give none.
    """
    order = _within(scope, slot)
    row = F.array(*[F.col(c).cast("double") for c in features])
    need = length + 3 if min_rows is None else min_rows
    return (
        df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*scope)))
        .withColumn("sequence", F.collect_list(row).over(order.rowsBetween(-(length - 1), 0)))
        .withColumn("target_time_slot", F.lead(slot, ahead).over(order))
        .withColumn("target_value", F.lead(target, ahead).over(order))
        .where(
            (F.col("_rows") >= need)
            & (F.size("sequence") == length)
            & F.col("target_time_slot").isNotNull()
        )
        .drop("_rows")
    )
