"""Live feature rows: the batch twin and the keyed stateful stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotline.operators import spatial
from slotline.operators import timeseries as ts
from slotline.streaming import keyed

PREVIOUS_DAY = keyed.PREVIOUS_DAY
FEATURES = [*keyed.HISTORY, "utilization_delta_30m", "utilization_delta_60m"]


def site_history(slots: DataFrame, key: str = "system_code", slot: str = "time_slot") -> DataFrame:
    """What a live row derives from the earlier rows of its own site, sessions disregarded for lags.

    A slot of the day that was never seen before keeps the value the previous row had.
    """
    scope = (key,)
    order = Window.partitionBy(key).orderBy(slot)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        slots.transform(ts.sessionize, key, slot)
        .transform(ts.session_progress, key, "session_id", slot)
        .transform(ts.previous_day_lags, ts.PREVIOUS_DAY_LAGS, key)
        .withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in PREVIOUS_DAY})
        .transform(ts.lags, ts.IN_SESSION_LAGS, scope, slot)
        .transform(ts.rolling_means, ts.ROLLING_MEANS, scope, slot)
        .transform(ts.deltas)
    )
    # A live row is the newest of its session: the session is as long as the steps taken.
    return rows.withColumn("session_size", F.col("session_step") + 1).withColumn(
        "session_progress", F.col("session_step") / F.col("session_size")
    )


def add_context(rows: DataFrame, history: DataFrame, edges: DataFrame) -> DataFrame:
    return spatial.asof_neighbour_context(rows, history, edges).withColumn(
        "spatial_utilization_gap", F.col("utilization") - F.col("neighbor_utilization_mean")
    )


def live_features(slots: DataFrame, edges: DataFrame) -> DataFrame:
    """Batch twin of the live path: every slot row as it would have looked on arrival."""
    return add_context(site_history(slots), slots, edges)


def live_feature_stream(slots: DataFrame, key: str = "system_code") -> DataFrame:
    """Own-history features per arriving slot row, from state bounded per site (``keyed``)."""
    return keyed.feature_stream(slots, key)
