"""From validated events to scored board rows, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators import decide
from slotline.operators import evaluate as ev
from slotline.operators import timeseries as ts
from slotline.plans import training
from slotline.sources.tables import union_history
from slotline.streaming import board, keyed
from slotline.streaming.live import add_context, site_history

CARRIED = ["capacity", "latitude", "longitude", "vehicle_type"]


def arrivals_to_slots(events: DataFrame, history: DataFrame, key: str = "system_code") -> DataFrame:
    """Ingest events as slot rows: what an event leaves out is carried over from the site's newest row.

    An event without a time belongs to the slot after that row. Of several events for one slot the last by
    time stays.
    """
    newest = ts.latest_per_key(history.select(key, "time_slot", *CARRIED), key)
    template = newest.withColumnsRenamed({c: f"_{c}" for c in ["time_slot", *CARRIED]})
    given = F.try_to_timestamp(F.col("timestamp"))
    next_slot = F.col("_time_slot") + F.expr(f"INTERVAL {fixed.SLOT_MINUTES} MINUTES")
    rows = (
        events.join(template, key)
        .withColumn("timestamp", F.coalesce(given, next_slot))
        .withColumn("time_slot", X.slot_round("timestamp"))
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in CARRIED})
        .select(key, "time_slot", "timestamp", "occupancy", "queue_length", "traffic_condition_nearby",
                "is_special_day", *CARRIED)
    )
    once = ts.latest_per_key(rows, [key, "time_slot"], ["timestamp", "occupancy"])
    return (
        once.transform(ts.clean_measures)
        .transform(ts.calendar_features)
        .transform(ts.ordinal_levels)
        .transform(ts.stress, False)
        .withColumn("record_id", F.lit(None).cast("long"))
    )


def live_rows(events: DataFrame, history: DataFrame, edges: DataFrame, key: str = "system_code") -> DataFrame:
    """Feature rows of the new events, with history strictly before each of them."""
    fresh = arrivals_to_slots(events, history, key)
    base = history.join(fresh.select(key, "time_slot"), [key, "time_slot"], "left_anti")
    both = union_history(base.withColumn("is_live", F.lit(False)), fresh.withColumn("is_live", F.lit(True)))
    touched = both.join(fresh.select(key).distinct(), key, "left_semi")
    rows = site_history(touched, key).where("is_live").drop("is_live")
    return add_context(rows, both, edges).withColumn(
        "target_time_slot", F.col("time_slot") + F.expr("INTERVAL 1 HOUR")
    )


def score_live(
    rows: DataFrame, models: dict[str, PipelineModel], weights: dict[str, float], widths: DataFrame
) -> DataFrame:
    """Ensemble prediction, interval from the widest published width, scores and total risk band."""
    scored = reduce(
        lambda d, name: training.score(models[name], d, f"_{name}"), models, training.model_input(rows)
    )
    members = {n: weights[n] for n in models}
    blended = scored.withColumn(
        "predicted_utilization_1h", ev.ensemble_value(members, {n: f"_{n}" for n in models})
    ).drop(*[f"_{n}" for n in models])
    return score_prediction(blended, widths)


def linear_prediction(weights: dict[str, float], intercept: float = 0.0) -> Column:
    """A stand-in model: a weighted sum of features, unknown ones left out, within [0, 1]."""
    total = F.lit(float(intercept))
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.coalesce(F.col(name), F.lit(0.0))
    return X.clip(total)


def score_prediction(rows: DataFrame, widths: DataFrame) -> DataFrame:
    """Interval from the widest published width, free spaces, scores and total risk band for rows with a prediction."""
    ranged = decide.live_interval(rows, widths).withColumn(
        "predicted_available_spaces_1h", X.free_spaces("capacity", "predicted_utilization_1h")
    )
    ratioed = ranged.withColumn(
        "predicted_free_ratio", F.col("predicted_available_spaces_1h") / X.at_least_one("capacity")
    )
    return ratioed.withColumns(
        {
            **X.score_columns(
                "predicted_free_ratio",
                "predicted_utilization_1h",
                "capacity_pressure",
                "uncertainty_width",
                "prediction_interval_upper",
                bounded=False,
            ),
            "risk_band": X.risk_band_total("prediction_interval_upper"),
        }
    )


def scored_board_stream(
    slots: DataFrame,
    edges: DataFrame,
    history: DataFrame,
    widths: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    key: str = "system_code",
) -> StreamingQuery:
    """The live path in one stream: slot rows to features on keyed state, prediction, scores, and the board of each site's newest row.

    ``history`` is read once, into the state; ``predict`` adds ``predicted_utilization_1h``. Late rows have no features and change nothing on the board.
    """
    rows = keyed.feature_stream(slots, key, edges, history, carry=["capacity", "capacity_pressure"])

    def scored(batch: DataFrame) -> DataFrame:
        return score_prediction(predict(batch.where("NOT is_late")), widths).drop("is_late")

    return board.board_stream(rows, path, checkpoint, "system_code", ["time_slot"], scored)
