"""Time-ordered splits, error metrics, intervals, ensembles and the backtest plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators.order import exact_quantiles, time_bucket, value_positions


def _positions(df: DataFrame, time: str) -> DataFrame:
    return value_positions(df, time, bucket=time_bucket(time))


def split_time(df: DataFrame, time: str = "target_time_slot", ratio: float = fixed.TRAIN_RATIO) -> DataFrame:
    """One row: the last training time, at the floor(ratio * n)-th distinct time (at least the first)."""
    cut = F.greatest(F.lit(1), F.floor(F.col("total_values") * F.lit(ratio)))
    return _positions(df, time).where(F.col("position") == cut).select(F.col(time).alias("split_time"))


def temporal_split(
    df: DataFrame, time: str = "target_time_slot", ratio: float = fixed.TRAIN_RATIO, flag: str = "is_train"
) -> DataFrame:
    """Rows with a train flag; the cut is a scalar subquery, so it reaches the scan as a filter."""
    return df.withColumn(flag, F.col(time) <= split_time(df, time, ratio).scalar())


def calibration_start(
    train: DataFrame, time: str = "target_time_slot", ratio: float = fixed.CALIBRATION_RATIO
) -> DataFrame:
    """One row: the first time of the calibration tail, the last max(1, floor(ratio * n)) distinct times."""
    held = F.greatest(F.lit(1), F.floor(F.col("total_values") * F.lit(ratio)))
    first = F.col("total_values") - held + 1
    return (
        _positions(train, time).where(F.col("position") == first).select(F.col(time).alias("calibration_start"))
    )


def calibration_split(
    train: DataFrame,
    time: str = "target_time_slot",
    ratio: float = fixed.CALIBRATION_RATIO,
    flag: str = "is_calibration",
) -> DataFrame:
    return train.withColumn(flag, F.col(time) >= calibration_start(train, time, ratio).scalar())


def backtest_plan(
    df: DataFrame,
    time: str = "target_time_slot",
    size: int = fixed.BACKTEST_SIZE,
    windows: int = fixed.BACKTEST_WINDOWS,
) -> DataFrame:
    """Rolling-origin windows over the distinct times, numbered from the oldest.

    The bounds sit at fixed positions counted from the end, so the plan is an aggregation of the
    positions table into one row per window.
    """
    n = F.col("total_values")
    numbered = F.explode(F.sequence(F.lit(1), F.lit(windows)))
    placed = _positions(df, time).withColumn("_slot", numbered)
    ends = n - (F.lit(windows) - F.col("_slot")) * size
    starts = F.greatest(F.lit(1), ends - size)
    zero_based = F.col("position") - 1
    raw = (
        placed.where(n > size + fixed.BACKTEST_SLACK)
        .where(
            (starts - 1 >= fixed.BACKTEST_MIN_TRAIN)
            & (zero_based.isin(starts - 1, starts, ends - 1))
        )
        .groupBy("_slot")
        .agg(
            F.max(F.when(zero_based == starts - 1, F.col(time))).alias("train_end_time"),
            F.max(F.when(zero_based == starts, F.col(time))).alias("test_start_time"),
            F.max(F.when(zero_based == ends - 1, F.col(time))).alias("test_end_time"),
        )
    )
    # Skipped windows are always the oldest, and numbering starts at the first one kept.
    kept = raw.agg(F.min("_slot")).scalar()
    return raw.select(
        (F.col("_slot") - kept + 1).cast("int").alias("window"),
        "train_end_time",
        "test_start_time",
        "test_end_time",
    )


def assign_windows(
    df: DataFrame, plan: DataFrame, time: str = "target_time_slot", role: str = "test"
) -> DataFrame:
    """Rows of each window's test span, or of its (expanding) training span.

    The plan has one row per window, so it is carried as one small array and no join is needed.
    """
    spans = plan.agg(
        F.collect_list(F.struct("window", "train_end_time", "test_start_time", "test_end_time"))
    ).scalar()
    at = F.col(time)
    if role == "test":
        inside = lambda w: (at >= w["test_start_time"]) & (at <= w["test_end_time"])
    else:
        inside = lambda w: at <= w["train_end_time"]
    return (
        df.withColumn("_spans", spans)
        .withColumn("_w", F.explode(F.filter("_spans", inside)))
        .select(*df.columns, "_w.*")
    )


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ("model",), clip: bool = True
) -> DataFrame:
    """MAE, RMSE, R2 and MAPE per group in one pass."""
    y = F.col(actual).cast("double")
    p = X.clip(F.col(predicted).cast("double")) if clip else F.col(predicted).cast("double")
    rows = df.select(*by, y.alias("_y"), (y - p).alias("_e")).where(
        F.col("_y").isNotNull() & F.col("_e").isNotNull()
    )
    square = F.sum(F.col("_e") * F.col("_e"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("_e")).alias("mae"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        (1 - F.try_divide(square, F.count(F.lit(1)) * F.var_pop("_y"))).alias("r2"),
        (F.avg(F.abs("_e") / F.greatest(F.abs("_y"), F.lit(fixed.ERROR_FLOOR))) * 100).alias("mape"),
    )


def band_metrics(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ("model",), clip: bool = True
) -> DataFrame:
    """Band accuracy and support-weighted F1. Out-of-range values form a band of their own.

    Only the confusion counts (bands squared per group) leave the first aggregation.
    """
    p = X.clip(F.col(predicted).cast("double")) if clip else F.col(predicted).cast("double")
    confusion = (
        df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(*by, X.utilization_band(actual).alias("_t"), X.utilization_band(p).alias("_p"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    sides = confusion.withColumn(
        "_side",
        F.explode(
            F.array(
                F.struct(F.col("_t").alias("band"), F.col("_n").alias("support"), F.lit(0).alias("claimed")),
                F.struct(F.col("_p").alias("band"), F.lit(0).alias("support"), F.col("_n").alias("claimed")),
            )
        ),
    ).withColumn("_hit", F.when(F.col("_t") == F.col("_p"), F.col("_side.support")).otherwise(0))
    per_band = sides.groupBy(*by, F.col("_side.band").alias("_band")).agg(
        F.sum("_side.support").alias("_support"),
        F.sum("_side.claimed").alias("_claimed"),
        F.sum("_hit").alias("_hits"),
    )
    f1 = F.coalesce(
        F.try_divide(2.0 * F.col("_hits"), (F.col("_support") + F.col("_claimed")).cast("double")),
        F.lit(0.0),
    )
    return per_band.groupBy(*by).agg(
        (F.sum("_hits") / F.sum("_support")).alias("band_accuracy"),
        (F.sum(f1 * F.col("_support")) / F.sum("_support")).alias("weighted_f1"),
    )


def metrics_table(
    df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ("model",), clip: bool = True
) -> DataFrame:
    """All error and band metrics from one pass over the rows.

    The pass leaves one row per group and (true band, predicted band); everything else is
    arithmetic on these at most 25 rows per group.
    """
    by = list(by)
    y = F.col(actual).cast("double")
    p = X.clip(F.col(predicted).cast("double")) if clip else F.col(predicted).cast("double")
    cells = (
        df.select(*by, y.alias("_y"), p.alias("_p"))
        .where(F.col("_y").isNotNull() & F.col("_p").isNotNull())
        .withColumn("_e", F.col("_y") - F.col("_p"))
        .groupBy(*by, X.utilization_band("_y").alias("_t"), X.utilization_band("_p").alias("_c"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg("_y").alias("_mean"),
            F.var_pop("_y").alias("_var"),
            F.sum(F.abs("_e")).alias("_abs"),
            F.sum(F.col("_e") * F.col("_e")).alias("_sq"),
            F.sum(F.abs("_e") / F.greatest(F.abs("_y"), F.lit(fixed.ERROR_FLOOR))).alias("_rel"),
        )
    )
    group, true_band = Window.partitionBy(*by), Window.partitionBy(*by, "_t")
    claimed = Window.partitionBy(*by, "_c")
    rows = F.sum("_n").over(group)
    center = F.sum(F.col("_n") * F.col("_mean")).over(group) / rows
    hit = F.col("_t") == F.col("_c")
    # Only hits raise F1: the band's weight times 2 * hits / (support + claimed).
    part = F.when(
        hit,
        F.sum("_n").over(true_band)
        * 2.0
        * F.col("_n")
        / (F.sum("_n").over(true_band) + F.sum("_n").over(claimed)),
    ).otherwise(0.0)
    spread = F.col("_n") * (F.col("_var") + F.pow(F.col("_mean") - F.col("_center"), 2))
    return (
        cells.withColumns({"_center": center, "_f1": part})
        .groupBy(*by)
        .agg(
            F.sum("_n").alias("n"),
            (F.sum("_abs") / F.sum("_n")).alias("mae"),
            F.sqrt(F.sum("_sq") / F.sum("_n")).alias("rmse"),
            (1 - F.try_divide(F.sum("_sq"), F.sum(spread))).alias("r2"),
            (F.sum("_rel") / F.sum("_n") * 100).alias("mape"),
            (F.sum(F.when(hit, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("band_accuracy"),
            (F.sum("_f1") / F.sum("_n")).alias("weighted_f1"),
        )
    )


def interval_radius(
    df: DataFrame,
    actual: str,
    predicted: str,
    by: Sequence[str] = ("model",),
    quantile: float = fixed.INTERVAL_QUANTILE,
) -> DataFrame:
    """Quantile of the absolute residual per group."""
    rows = df.select(*by, F.abs(F.col(actual) - F.col(predicted)).alias("_e"))
    return exact_quantiles(rows, "_e", [quantile], list(by), few_groups=True).select(
        *by, F.col("quantiles")[0].alias("radius")
    )


def ensemble_weights(df: DataFrame, actual: str, predicted: str, model: str = "model") -> DataFrame:
    """Inverse-RMSE weights, one row per model, adding up to 1."""
    error = F.sqrt(F.avg(F.pow(F.col(actual) - F.col(predicted), 2)))
    inverse = df.groupBy(model).agg((1.0 / F.greatest(error, F.lit(fixed.ERROR_FLOOR))).alias("_inverse"))
    whole = inverse.agg(F.sum("_inverse")).scalar()
    return inverse.select(model, (F.col("_inverse") / whole).alias("weight"))


def ensemble_value(members: dict[str, Column | float], values: dict[str, str]) -> Column:
    """Weighted mean over the members that gave a value; weights renormalise when one is missing."""
    top = total = None
    for name, weight in members.items():
        w = weight if isinstance(weight, Column) else F.lit(float(weight))
        v = F.col(values[name])
        part = F.when(v.isNotNull(), w * v).otherwise(0.0)
        share = F.when(v.isNotNull(), w).otherwise(0.0)
        top = part if top is None else top + part
        total = share if total is None else total + share
    fallback = F.coalesce(*[F.col(values[name]) for name in members])
    return F.when(total > 0, top / total).otherwise(fallback)


def prediction_interval(
    df: DataFrame, radius: Column | float, predicted: str = "predicted_utilization_1h"
) -> DataFrame:
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    p = F.col(predicted)
    return (
        df.withColumn("prediction_interval_lower", X.clip(p - r))
        .withColumn("prediction_interval_upper", X.clip(p + r))
        .withColumn(
            "uncertainty_width", F.col("prediction_interval_upper") - F.col("prediction_interval_lower")
        )
    )


PREDICTION_COLUMNS = [
    "system_code",
    "time_slot",
    "target_time_slot",
    "capacity",
    "available_spaces",
    "target_available_spaces_1h",
    "utilization",
    "target_utilization_1h",
]


def prediction_frame(df: DataFrame, model: str, predicted: Column) -> DataFrame:
    """The common shape of every model's test predictions."""
    return (
        df.select(*PREDICTION_COLUMNS, X.clip(predicted).alias("predicted_utilization_1h"))
        .withColumn("model", F.lit(model))
        .withColumn(
            "predicted_available_spaces_1h",
            X.half_even(F.col("capacity") * (1 - F.col("predicted_utilization_1h"))),
        )
    )


def champion(metrics: DataFrame, error: str = "rmse") -> DataFrame:
    """The row with the smallest error; the model name breaks ties."""
    whole = F.struct(*[F.col(c) for c in metrics.columns])
    return metrics.agg(F.min_by(whole, F.struct(error, "model")).alias("_row")).select("_row.*")
