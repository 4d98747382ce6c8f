"""Recommendations, rankings, what-if rows, stress scenarios and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators.order import dense_rank
from slotline.operators.timeseries import first_per_key


def score_board(board: DataFrame) -> DataFrame:
    """Fill missing interval ends with the prediction and add free ratio, scores and risk band."""
    predicted = F.col("predicted_utilization_1h")
    filled = (
        board.withColumn("prediction_interval_lower", F.coalesce("prediction_interval_lower", predicted))
        .withColumn("prediction_interval_upper", F.coalesce("prediction_interval_upper", predicted))
        .withColumn(
            "uncertainty_width", F.col("prediction_interval_upper") - F.col("prediction_interval_lower")
        )
        .withColumn(
            "predicted_free_ratio",
            F.col("predicted_available_spaces_1h") / X.at_least_one("capacity"),
        )
    )
    return filled.withColumns(
        {
            **X.score_columns(
                "predicted_free_ratio",
                "predicted_utilization_1h",
                "capacity_pressure",
                "uncertainty_width",
                "prediction_interval_upper",
            ),
            "risk_band": X.risk_band("prediction_interval_upper"),
        }
    )


def recommend(board: DataFrame, key: str = "system_code", ordered: bool = True) -> DataFrame:
    """The whole board with scores and its dense rank by balanced score."""
    ranked = dense_rank(score_board(board), "balanced_score", "recommendation_rank")
    if not ordered:
        return ranked
    return ranked.orderBy("recommendation_rank", F.desc("predicted_available_spaces_1h"), key)


def top_n(df: DataFrame, by: str, n: int, key: str = "system_code", descending: bool = True) -> DataFrame:
    """The n leading rows; each task keeps n rows, nothing is sorted globally."""
    first = F.desc(by) if descending else F.asc(by)
    return df.orderBy(first, F.asc(key)).limit(n)


def objective_rank(
    board: DataFrame, objective: str = "Balanced", limit: int = 10, key: str = "system_code"
) -> DataFrame:
    """The ``limit`` best rows for an objective, ranked 1..limit.

    Ranking happens after the cut, on ``limit`` rows. An unknown objective means Balanced.
    """
    score = fixed.OBJECTIVES.get(objective, fixed.OBJECTIVES["Balanced"])
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(score), F.asc(key))
    return top_n(board, score, limit, key).withColumn("recommendation_rank", F.row_number().over(order))


def rank_of(board: DataFrame, row_key: Column, score: str = "balanced_score", key: str = "system_code") -> DataFrame:
    """Position of one key on the board: one plus the rows ahead of it. Two aggregations, no ordering."""
    mine = board.where(F.col(key) == row_key).agg(F.max(score)).scalar()
    ahead = (F.col(score) > mine) | ((F.col(score) == mine) & (F.col(key) < row_key))
    return board.agg((F.count_if(ahead) + 1).alias("recommendation_rank"))


def what_if(
    latest: DataFrame, scenarios: DataFrame, key: str = "system_code", scenario: str = "scenario_id"
) -> DataFrame:
    """Feature rows for many scenarios at once: overrides applied and dependent columns redone.

    ``scenarios`` has the key, an id and nullable overrides ``new_queue_length``,
    ``new_traffic_condition_nearby``, ``new_is_special_day`` and ``new_vehicle_type``.
    """
    joined = scenarios.join(latest, key)
    word = F.col("new_traffic_condition_nearby")
    changed = joined.withColumns(
        {
            "queue_length": F.coalesce(F.col("new_queue_length").cast("double"), "queue_length"),
            "traffic_level": F.when(word.isNotNull(), X.ordinal(word, fixed.TRAFFIC_LEVELS)).otherwise(
                F.col("traffic_level")
            ),
            "traffic_condition_nearby": F.coalesce(word, "traffic_condition_nearby"),
            "is_special_day": F.coalesce(F.col("new_is_special_day").cast("int"), "is_special_day"),
            "vehicle_type": F.coalesce("new_vehicle_type", "vehicle_type"),
        }
    )
    return (
        changed.withColumn("capacity_pressure", X.ratio("queue_length", "capacity"))
        .withColumn(
            "parking_stress_index", X.stress_index("utilization", "traffic_level", "capacity_pressure")
        )
        .withColumns(
            {
                "rolling_queue_3": F.col("queue_length"),
                "rolling_queue_6": F.col("queue_length"),
                "rolling_stress_3": F.col("parking_stress_index"),
            }
        )
        .select(scenario, *latest.columns)
    )


def what_if_answer(rows: DataFrame, widths: DataFrame, predicted: str = "predicted_utilization_1h") -> DataFrame:
    """What a scenario row with a prediction answers: prediction, interval of half the widest published width, free spaces."""
    ranged = live_interval(rows, widths, predicted)
    six = lambda c: F.rint(F.col(c) * 1e6) / 1e6
    return ranged.withColumns(
        {
            "predicted_free_spaces_1h": X.free_spaces("capacity", predicted).cast("long"),
            **{c: six(c) for c in (predicted, "prediction_interval_lower", "prediction_interval_upper")},
        }
    ).drop("uncertainty_width")


def live_interval(df: DataFrame, widths: DataFrame, predicted: str = "predicted_utilization_1h") -> DataFrame:
    """Interval of half the widest published width around a live prediction."""
    widest = widths.agg(
        F.coalesce(
            F.max(F.coalesce(F.col("uncertainty_width"), F.lit(0.0))), F.lit(fixed.DEFAULT_INTERVAL_WIDTH)
        )
    ).scalar()
    lower = F.greatest(F.lit(0.0), F.col(predicted) - widest / 2)
    upper = F.least(F.lit(1.0), F.col(predicted) + widest / 2)
    return df.withColumns({"prediction_interval_lower": lower, "prediction_interval_upper": upper}).withColumn(
        "uncertainty_width", F.col("prediction_interval_upper") - F.col("prediction_interval_lower")
    )


# --- stress scenarios -------------------------------------------------------


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    """0-based index over an already cut, handful-sized table."""
    return df.withColumn(
        "_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1
    )


def union_top_lists(board: DataFrame, picks: list[tuple[str, int]], key: str = "system_code") -> DataFrame:
    """Several top-n lists in one, each key kept where it first appears."""
    parts = None
    for turn, (column, n) in enumerate(picks):
        part = _numbered(top_n(board, column, n, key), F.desc(column), F.asc(key)).withColumn(
            "_list", F.lit(turn)
        )
        parts = part if parts is None else parts.unionByName(part)
    once = first_per_key(parts, key, [F.asc("_list"), F.asc("_i")])
    return _numbered(once, F.asc("_list"), F.asc("_i")).drop("_list")


def _stressed(picked: DataFrame, shift: Column, queue_shift: Column, traffic: str, special: int,
              target: Column | None = None, key: str = "system_code") -> DataFrame:
    cap = F.col("capacity").cast("double")
    moved = cap * target if target is not None else F.col("occupancy_clean") + cap * shift
    bounded = F.greatest(F.lit(0.0), F.least(cap, moved))
    queue = F.greatest(
        F.lit(0), F.least(F.lit(fixed.QUEUE_LIMIT), F.rint("queue_length").cast("int") + queue_shift)
    )
    if traffic == "low":
        queue = F.least(queue, F.lit(fixed.QUIET_QUEUE_LIMIT))
    return picked.select(
        key,
        (F.rint(bounded * 100) / 100).alias("occupancy"),
        queue.cast("int").alias("queue_length"),
        F.lit(traffic).alias("traffic_condition_nearby"),
        F.lit(special).alias("is_special_day"),
        F.coalesce(F.col("vehicle_type"), F.lit("car")).alias("vehicle_type") if "vehicle_type" in picked.columns else F.lit("car").alias("vehicle_type"),
        cap.alias("capacity"),
        *[F.col(c).cast("double").alias(c) if c in picked.columns else F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude")],
    )


def rush_hour(board: DataFrame, step: int, key: str = "system_code") -> DataFrame:
    by = "predicted_utilization_1h"
    i = F.col("_i")
    picked = _numbered(top_n(board, by, 6, key), F.desc(by), F.asc(key))
    return _stressed(
        picked,
        F.lit(0.05 + 0.015 * step) + 0.005 * i,
        F.lit(2 + step) + F.floor(i / 2).cast("int"),
        "high" if step >= 2 else "average",
        0,
        key=key,
    )


def event_overflow(board: DataFrame, step: int, key: str = "system_code") -> DataFrame:
    i = F.col("_i")
    picked = union_top_lists(board, [("capacity", 4), ("predicted_utilization_1h", 3)], key)
    return _stressed(
        picked, F.lit(0.08 + 0.02 * step) + 0.01 * (i % 2), F.lit(4 + step) + i, "high", 1, key=key
    )


def holiday_relief(board: DataFrame, step: int, key: str = "system_code") -> DataFrame:
    picked = top_n(board, "capacity", 8, key)
    drop = -F.greatest(F.col("queue_length").cast("double"), F.lit(1.0)).cast("int")
    return _stressed(picked, F.lit(-(0.06 + 0.015 * step)), drop, "low", 1, key=key)


def spillover(board: DataFrame, edges: DataFrame, step: int, key: str = "system_code",
              neighbour: str = "neighbor_code") -> DataFrame:
    """The busiest site is driven towards full and its heaviest-weighted neighbours take the overflow."""
    origin = top_n(board, "predicted_utilization_1h", 1, key)
    t = fixed.SPILL_TARGET
    target = F.least(
        F.lit(t["ceiling"]),
        F.greatest(F.col("utilization") + t["gain"] + t["per_step"] * step, F.lit(t["floor"])),
    )
    hit = _stressed(origin, F.lit(0.0), F.lit(5 + step), "high", 0, target=target, key=key)
    around = (
        edges.where(F.col(key) == origin.select(key).scalar())
        .groupBy(neighbour)
        .agg(F.max("weight").alias("_w"))
        .orderBy(F.desc("_w"), F.asc(neighbour))
        .limit(3)
    )
    spread = board.join(F.broadcast(around.select(F.col(neighbour).alias(key))), key, "left_semi")
    return hit.unionByName(
        _stressed(spread, F.lit(0.04 + 0.015 * step), F.lit(2 + step), "high", 0, key=key)
    )


def stress_scenario(board: DataFrame, name: str, step: int = 1, edges: DataFrame | None = None,
                    key: str = "system_code") -> DataFrame:
    """Ingest rows that a named scenario would produce from the current board."""
    if name == "rush_hour_surge":
        return rush_hour(board, step, key)
    if name == "event_overflow":
        return event_overflow(board, step, key)
    if name == "holiday_relief":
        return holiday_relief(board, step, key)
    if name == "spillover_disruption":
        if edges is None:
            raise ValueError("spillover_disruption needs the neighbour edges")
        return spillover(board, edges, step, key)
    raise ValueError(f"unknown scenario: {name}")


# --- alerts -----------------------------------------------------------------


def _alert(df: DataFrame, severity: Column, category: str, title: Column, message: Column, action: Column):
    return df.select(
        severity.alias("severity"),
        F.lit(category).alias("category"),
        title.alias("title"),
        message.alias("message"),
        action.alias("recommended_action"),
    )


def capacity_alert(board: DataFrame, key: str = "system_code") -> DataFrame:
    text = fixed.ALERT_TEXT["capacity"]
    worst = F.struct(-F.col("predicted_utilization_1h"), F.col(key))
    state = (
        board.where(F.col("risk_band") == "Critical")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by(F.struct(F.col(key).cast("string").alias("k"), "predicted_utilization_1h"), worst).alias("w"),
        )
        .where(F.col("n") > 0)
    )
    # Percent with two digits, half-even as the reports print it.
    percent = F.rint(F.col("w.predicted_utilization_1h") * 10000) / 100
    return _alert(
        state,
        F.when(F.col("n") >= 3, "critical").otherwise("warning"),
        "capacity",
        F.lit(text["title"]),
        F.format_string(text["message"], F.col("n"), F.col("w.k"), percent),
        F.lit(text["action"]),
    )


def availability_alert(board: DataFrame, key: str = "system_code") -> DataFrame:
    text = fixed.ALERT_TEXT["availability"]
    tight = board.where(X.low_availability())
    # Three rows at most reach the list.
    first = (
        tight.orderBy("predicted_available_spaces_1h", key)
        .limit(3)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("predicted_available_spaces_1h", F.col(key).alias("k")))
            ).alias("rows")
        )
        .select(F.array_join(F.transform("rows", lambda x: x["k"].cast("string")), ", "))
    )
    names = first.scalar()
    state = tight.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    return _alert(
        state,
        F.lit("warning"),
        "availability",
        F.lit(text["title"]),
        F.format_string(text["message"], F.col("n"), names),
        F.lit(text["action"]),
    )


def drift_alert(drift: DataFrame) -> DataFrame:
    text = fixed.ALERT_TEXT["drift"]
    state = drift.agg(
        F.min_by(F.struct("feature", "psi"), F.struct(-F.col("psi"), F.col("feature"))).alias("top")
    ).where(F.col("top").isNotNull())
    severity = X.drift_level("top.psi", fixed.DRIFT_SEVERITIES)
    return _alert(
        state,
        F.when(severity == "stable", "info").otherwise(severity),
        "drift",
        F.lit(text["title"]),
        F.format_string(
            text["message"], F.rint(F.col("top.psi") * 1000) / 1000, F.col("top.feature"), severity
        ),
        F.lit(text["action"]),
    )


def retrain_alert(jobs: DataFrame) -> DataFrame:
    """Newest job (by creation, then id); one row even when there is none."""
    none, some = fixed.ALERT_TEXT["no_job"], fixed.ALERT_TEXT["job"]
    state = jobs.agg(
        F.max_by(
            F.struct("status", F.coalesce("finished_at", "started_at", "created_at").alias("at")),
            F.struct("created_at", "job_id"),
        ).alias("job")
    )
    has = F.col("job").isNotNull()
    status = F.col("job.status")
    return _alert(
        state,
        F.when(status == "failed", "critical").otherwise("info"),
        "retraining",
        F.when(has, F.format_string(some["title"], status)).otherwise(none["title"]),
        F.when(
            has,
            F.format_string(some["message"], status, F.date_format("job.at", "yyyy-MM-dd HH:mm:ss")),
        ).otherwise(none["message"]),
        F.when(has, F.lit(some["action"])).otherwise(none["action"]),
    )


def severity_rank(c: str = "severity") -> Column:
    out = F.when(F.col(c) == fixed.SEVERITY_ORDER[0], 0)
    for i, name in enumerate(fixed.SEVERITY_ORDER[1:], start=1):
        out = out.when(F.col(c) == name, i)
    return out.otherwise(len(fixed.SEVERITY_ORDER))


def ops_alerts(board: DataFrame, drift: DataFrame, jobs: DataFrame, key: str = "system_code") -> DataFrame:
    """All rule outcomes, most severe first, then by category. At most one row per rule."""
    return (
        capacity_alert(board, key)
        .unionByName(availability_alert(board, key))
        .unionByName(drift_alert(drift))
        .unionByName(retrain_alert(jobs))
        .orderBy(severity_rank(), "category")
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Count per severity, zero where a severity has no alert."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in fixed.SEVERITY_ORDER]
    pairs = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in fixed.SEVERITY_ORDER])
    return alerts.agg(*counts).select(F.inline(pairs))
