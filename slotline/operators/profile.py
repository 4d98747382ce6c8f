"""Summaries: data set, site profiles, reporting views, pivots and board snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators.order import exact_quantiles


def dataset_summary(slots: DataFrame, key: str = "system_code", slot: str = "time_slot") -> DataFrame:
    return slots.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(slots.columns)).alias("columns"),
        F.countDistinct(key).alias("systems"),
        F.min(slot).alias("date_start"),
        F.max(slot).alias("date_end"),
        F.sum("occupancy_anomaly_flag").alias("anomaly_rows"),
        F.avg("utilization").alias("avg_utilization"),
        F.avg("queue_length").alias("avg_queue_length"),
    )


def site_profiles(slots: DataFrame, key: str = "system_code") -> DataFrame:
    """Eleven aggregates per site; a one-row site has spread 0."""
    share_high = F.avg(F.when(F.col("traffic_level") == 2, 1.0).otherwise(0.0))
    return (
        slots.groupBy(key)
        .agg(
            F.avg("latitude").alias("latitude"),
            F.avg("longitude").alias("longitude"),
            F.max("capacity").alias("capacity"),
            F.avg("occupancy_clean").alias("mean_occupancy"),
            F.max("occupancy_clean").alias("max_occupancy"),
            F.avg("utilization").alias("mean_utilization"),
            F.stddev_samp("utilization").alias("std_utilization"),
            F.avg("queue_length").alias("mean_queue_length"),
            share_high.alias("high_traffic_ratio"),
            F.avg("is_special_day").alias("special_day_ratio"),
            F.avg("parking_stress_index").alias("average_stress"),
        )
        .fillna(0)
    )


def daily_summary(slots: DataFrame, key: str = "system_code", slot: str = "time_slot") -> DataFrame:
    return slots.groupBy(key, F.to_date(slot).alias("summary_date")).agg(
        F.avg("utilization").alias("avg_utilization"),
        F.max("utilization").alias("max_utilization"),
        F.avg("queue_length").alias("avg_queue_length"),
        F.sum("occupancy_anomaly_flag").alias("anomaly_rows"),
    )


def peak_periods(slots: DataFrame, key: str = "system_code") -> DataFrame:
    return (
        slots.groupBy(key, "hour")
        .agg(F.avg("utilization").alias("avg_utilization"), F.avg("queue_length").alias("avg_queue_length"))
        .orderBy(F.desc("avg_utilization"), F.desc("avg_queue_length"))
    )


def recommended_view(board: DataFrame, key: str = "system_code") -> DataFrame:
    return board.select(
        "recommendation_rank",
        key,
        "predicted_available_spaces_1h",
        "predicted_utilization_1h",
        "risk_band",
        "balanced_score",
    ).orderBy(F.asc("recommendation_rank"), F.desc("balanced_score"))


def mean_metrics(metrics: DataFrame, by: str) -> DataFrame:
    """Mean errors per horizon or per model."""
    return metrics.groupBy(by).agg(
        F.avg("rmse").alias("avg_rmse"),
        F.avg("mae").alias("avg_mae"),
        F.avg("band_accuracy").alias("avg_band_accuracy"),
    )


def register_views(slots: DataFrame, board: DataFrame, horizons: DataFrame, backtest: DataFrame) -> list[str]:
    """The five reporting views as session views."""
    views = {
        "vw_daily_system_summary": daily_summary(slots),
        "vw_peak_periods": peak_periods(slots),
        "vw_recommended_parking": recommended_view(board),
        "vw_multi_horizon_summary": mean_metrics(horizons, "forecast_horizon"),
        "vw_backtest_summary": mean_metrics(backtest, "model"),
    }
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return list(views)


def label_counts(df: DataFrame, label: str = "risk_band", unknown: str = "Unknown") -> DataFrame:
    return (
        df.groupBy(F.coalesce(F.col(label), F.lit(unknown)).alias(label))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(label)
    )


def hour_pivot(slots: DataFrame, key: str = "system_code", value: str = "utilization") -> DataFrame:
    """Mean value per site and hour of day; the 24 output columns are declared, not discovered."""
    return (
        slots.withColumn("_h", F.format_string("h%02d", F.col("hour")))
        .groupBy(key)
        .pivot("_h", [f"h{h:02d}" for h in range(24)])
        .agg(F.avg(value))
    )


def distribution_summary(df: DataFrame, category: str, value: str, few_categories: bool = False) -> DataFrame:
    """Five-number summary and mean per category."""
    rows = df.where(F.col(category).isNotNull() & F.col(value).isNotNull())
    five = exact_quantiles(rows, value, [0.0, 0.25, 0.5, 0.75, 1.0], [category], output="q", few_groups=few_categories)
    basics = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return basics.join(five, category).select(
        category,
        "n",
        "mean",
        *[F.col("q")[i].alias(name) for i, name in enumerate(["lowest", "q1", "median", "q3", "highest"])],
    )


def key_catalog(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)


def bounded_sample(df: DataFrame, by: Sequence[str], size: int = 3000, seed: int = fixed.SEED) -> DataFrame:
    """At most ``size`` rows in hash order: the same rows on every run, no global shuffle."""
    return (
        df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])))
        .orderBy("_h", *by)
        .limit(size)
        .drop("_h")
    )


def board_snapshot(board: DataFrame, key: str = "system_code") -> DataFrame:
    """Headline numbers of a board in one aggregation pass."""
    predicted = F.col("predicted_utilization_1h")
    # min_by over (-score, key): highest score, smallest key on ties.
    return board.agg(
        F.countDistinct(key).alias("systems"),
        F.coalesce(F.avg(predicted), F.lit(0.0)).alias("mean_utilization"),
        F.count_if(F.col("risk_band") == "Critical").alias("critical_systems"),
        F.count_if(F.col("risk_band").isin("Critical", "High")).alias("high_risk_systems"),
        F.count_if(X.low_availability()).alias("low_availability_systems"),
        F.min_by(key, F.struct(-F.col("balanced_score"), F.col(key))).alias("best_option"),
        F.min_by(key, F.struct(-predicted, F.col(key))).alias("most_congested"),
    )


def snapshot_delta(before: DataFrame, after: DataFrame, key: str = "system_code") -> DataFrame:
    """Change of mean utilization and critical count between two boards."""
    state = lambda df, tag: df.groupBy(F.lit(tag).alias("state")).agg(
        F.avg("predicted_utilization_1h").alias("use"),
        F.count_if(F.col("risk_band") == "Critical").alias("critical"),
    )
    pick = lambda tag, c: F.max(F.when(F.col("state") == tag, F.col(c)))
    return (
        state(before, "before")
        .unionByName(state(after, "after"))
        .agg(
            pick("before", "use").alias("before_mean_utilization"),
            pick("after", "use").alias("after_mean_utilization"),
            (pick("after", "use") - pick("before", "use")).alias("delta_mean_utilization"),
            (pick("after", "critical") - pick("before", "critical")).alias("delta_critical_systems"),
        )
    )
