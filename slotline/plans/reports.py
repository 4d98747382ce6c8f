"""Nested report records: model registry, project summary, operations summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators import decide, profile
from slotline.operators.evaluate import champion


def _listed(df: DataFrame, *order: str, hide: tuple[str, ...] = ()):
    """A report-sized table as a sorted array of structs (a handful of models, features or windows)."""
    lead = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    item = F.struct(*lead, *[F.col(c) for c in df.columns])
    drop = [*[f"_o{i}" for i in range(len(order))], *hide]
    rows = df.agg(F.array_sort(F.collect_list(item)).alias("r"))
    return rows.select(F.transform("r", lambda x: x.dropFields(*drop))).scalar()


def registry_record(
    metrics: DataFrame,
    split_time,
    weights: dict[str, float],
    drift: DataFrame,
    backtest: DataFrame | None = None,
    feature_count: int = len(fixed.NUMERIC_FEATURES) + len(fixed.CATEGORICAL_FEATURES),
) -> DataFrame:
    """One row: champion, split, weights, metrics, the five most drifted features, backtest rows."""
    best = champion(metrics).select("model").scalar()
    top = drift.withColumn("_w", -F.col("psi")).orderBy("_w", "feature").limit(5)
    pairs = [x for name, w in weights.items() for x in (F.lit(name), F.lit(float(w)))]
    spark = metrics.sparkSession
    columns = [
        F.current_timestamp().alias("generated_at_utc"),
        best.alias("champion_model"),
        F.lit(split_time).alias("train_test_split_time"),
        F.lit(feature_count).alias("feature_count"),
        _listed(metrics, "rmse").alias("metrics"),
        F.create_map(*pairs).alias("ensemble_weights"),
        _listed(top, "_w", "feature", hide=("_w",)).alias("drift_summary"),
    ]
    if backtest is not None:
        columns.append(_listed(backtest, "window", "model").alias("backtest_summary"))
    return spark.range(1).select(*columns)


def project_summary(
    slots: DataFrame,
    metrics: DataFrame,
    horizons: DataFrame,
    board: DataFrame,
    split_time,
    clusters: dict | None = None,
) -> DataFrame:
    """One row: data set, best model, horizon errors, cluster figures, top recommendation."""
    best = champion(metrics)
    data = profile.dataset_summary(slots)
    pairs = horizons.agg(F.map_from_entries(F.collect_list(F.struct("forecast_horizon", "rmse"))))
    top = board.agg(F.min_by("system_code", F.struct("recommendation_rank", "system_code")))
    columns = [
        F.struct(*data.columns).alias("dataset_summary"),
        F.lit(split_time).alias("split_time"),
        best.select("model").scalar().alias("best_model"),
        best.select("rmse").scalar().alias("best_rmse"),
        best.select("mae").scalar().alias("best_mae"),
        pairs.scalar().alias("multi_horizon_best_rmse"),
        top.scalar().alias("top_recommendation"),
    ]
    if clusters:
        columns.append(
            F.struct(*[F.lit(float(v)).alias(k) for k, v in clusters.items()]).alias("cluster_summary")
        )
    return data.select(*columns)


WATCH_COLUMNS = [
    "system_code",
    "predicted_available_spaces_1h",
    "predicted_utilization_1h",
    "prediction_interval_upper",
    "risk_band",
]


def ops_summary(
    board: DataFrame,
    drift: DataFrame,
    jobs: DataFrame,
    metrics: DataFrame | None = None,
    backtest: DataFrame | None = None,
    live_observations: DataFrame | None = None,
) -> DataFrame:
    """One nested row over the board, drift rows, jobs and model metrics."""
    alerts = decide.ops_alerts(board, drift, jobs).withColumn("_rank", decide.severity_rank())
    watch = decide.top_n(board, "predicted_utilization_1h", 5).select(
        (-F.col("predicted_utilization_1h")).alias("_w"), *WATCH_COLUMNS
    )
    options = decide.objective_rank(board, "Balanced", 5).select("recommendation_rank", *WATCH_COLUMNS)
    worst = F.coalesce(F.max("psi"), F.lit(0.0))
    overview = drift.agg(
        F.struct(
            X.drift_level(worst, fixed.DRIFT_SEVERITIES).alias("severity"),
            worst.alias("max_psi"),
            F.count(F.lit(1)).alias("features_monitored"),
        )
    )
    top = drift.select((-F.col("psi")).alias("_w"), "feature", "psi").orderBy("_w", "feature").limit(5)
    latest = jobs.agg(
        F.max_by(
            F.struct("job_id", "status", "created_at", "started_at", "finished_at"),
            F.struct("created_at", "job_id"),
        )
    )
    recent = jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(10)
    recent = recent.select((-F.unix_micros("created_at")).alias("_w"), "job_id", "status", "created_at")
    snapshot = profile.board_snapshot(board)
    columns = [
        F.current_timestamp().alias("as_of_utc"),
        F.struct(*snapshot.columns).alias("live_snapshot"),
        overview.scalar().alias("drift_overview"),
        _listed(top, "_w", "feature", hide=("_w",)).alias("top_drift_features"),
        latest.scalar().alias("retrain_status"),
        _listed(alerts, "_rank", "category", hide=("_rank",)).alias("alerts"),
        _listed(decide.alert_counts(alerts), "severity").alias("alert_counts"),
        _listed(watch, "_w", "system_code", hide=("_w",)).alias("critical_watchlist"),
        _listed(options, "recommendation_rank").alias("recommended_alternatives"),
        _listed(recent, "_w", "job_id", hide=("_w",)).alias("retrain_jobs"),
    ]
    if metrics is not None:
        best = champion(metrics).agg(F.first(F.struct("model", "rmse", "band_accuracy")))
        columns.append(best.scalar().alias("champion"))
    if backtest is not None:
        mean = backtest.where(F.lower("model").contains("boosted")).agg(
            F.coalesce(F.avg("band_accuracy"), F.lit(0.0))
        )
        columns.append(mean.scalar().alias("rolling_band_accuracy"))
    if live_observations is not None:
        columns.append(live_observations.agg(F.count(F.lit(1))).scalar().alias("live_observations"))
    return snapshot.select(*columns)
