"""From the raw feed to the clean slot table and the model table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators import spatial
from slotline.operators import timeseries as ts
from slotline.session import pin_time_zone


def enrich_slots(slots: DataFrame, minutes: int = fixed.SLOT_MINUTES, null_occupancy: str = "full") -> DataFrame:
    """Aggregated slots with measures, calendar, levels and stress; no window needed."""
    return (
        slots.transform(ts.clean_measures, null_occupancy)
        .transform(ts.calendar_features, "time_slot", minutes)
        .transform(ts.ordinal_levels)
        .transform(ts.stress)
    )


def build_clean(observations: DataFrame, minutes: int = fixed.SLOT_MINUTES,
                null_occupancy: str = "full") -> DataFrame:
    """The clean slot table, one row per site and slot, with its sessions.

    Shuffles: one for the (site, slot) aggregation, which carries combined rows only, and one
    by site that the session, lag and same-slot windows that follow all share.
    """
    pin_time_zone(observations.sparkSession)
    return (
        ts.slot_aggregate(observations, minutes=minutes)
        .transform(enrich_slots, minutes, null_occupancy)
        .transform(ts.sessionize, minutes=minutes)
        .transform(ts.session_progress)
    )


def neighbour_graph(observations: DataFrame, k: int = fixed.NEIGHBOURS) -> DataFrame:
    return spatial.knn_graph(spatial.canonical_sites(observations), k)


def add_lags_and_targets(clean: DataFrame) -> DataFrame:
    return (
        clean.transform(ts.previous_day_lags)
        .transform(ts.lags, ts.IN_SESSION_LAGS)
        .transform(ts.rolling_means)
        .transform(ts.leads)
        .transform(ts.deltas)
    )


def build_features(clean: DataFrame, edges: DataFrame) -> DataFrame:
    """Every slot row with its model columns, before incomplete rows are dropped."""
    with_lags = add_lags_and_targets(clean)
    return (
        with_lags.join(spatial.neighbour_means(clean, edges), ["system_code", "time_slot"], "left")
        .withColumn(
            "spatial_utilization_gap", F.col("utilization") - F.col("neighbor_utilization_mean")
        )
        .withColumns(
            {
                "future_demand_regime": X.demand_regime("target_stress_1h"),
                "current_utilization_band": X.utilization_band("utilization"),
                "target_utilization_band_1h": X.utilization_band("target_utilization_1h"),
            }
        )
    )


def build_model_table(clean: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows with all required lags, neighbour context and the one-hour target."""
    return build_features(clean, edges).dropna(subset=fixed.REQUIRED_FEATURES)
