"""Forecast models on Spark ML: preparation, forest, boosted trees, horizons, backtest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators import evaluate as ev
from slotline.session import stage

HASHED, SITE_WIDTH = ("system_code",), 256
MODEL_NAMES = {"forest": "Random Forest", "boost": "Boosted Trees"}
SMALL_FOREST = {"trees": 20, "depth": 6, "min_leaf": 2}
SMALL_BOOST = {"rounds": 10, "depth": 4, "step": 0.05, "row_share": 0.9, "column_share": "0.8"}


def preparation(
    numeric: Sequence[str] = tuple(fixed.NUMERIC_FEATURES),
    categorical: Sequence[str] = tuple(fixed.CATEGORICAL_FEATURES),
) -> list:
    """Standardised numbers plus one-hot words; an unseen word encodes as nothing.

    The site key is hashed into ``SITE_WIDTH`` places instead, since there may be any number of sites.
    """
    keyed = [c for c in categorical if c in HASHED]
    words = [c for c in categorical if c not in HASHED]
    coded, hot = [f"{c}_code" for c in words], [f"{c}_hot" for c in words]
    hashers = [FeatureHasher(inputCols=[c], categoricalCols=[c], outputCol=f"{c}_hot", numFeatures=SITE_WIDTH) for c in keyed]
    return [
        VectorAssembler(inputCols=list(numeric), outputCol="numbers", handleInvalid="keep"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=words, outputCols=coded, handleInvalid="keep"),
        OneHotEncoder(inputCols=coded, outputCols=hot, dropLast=True, handleInvalid="error"),
        *hashers,
        VectorAssembler(inputCols=["scaled", *hot, *[f"{c}_hot" for c in keyed]], outputCol="features", handleInvalid="keep"),
    ]


def forest_pipeline(label: str, settings: dict = fixed.FOREST_SETTINGS, **prep) -> Pipeline:
    model = RandomForestRegressor(
        featuresCol="features",
        labelCol=label,
        predictionCol="prediction",
        numTrees=settings["trees"],
        maxDepth=settings["depth"],
        minInstancesPerNode=settings["min_leaf"],
        featureSubsetStrategy="all",
        seed=fixed.SEED,
    )
    return Pipeline(stages=[*preparation(**prep), model])


def boost_pipeline(label: str, settings: dict = fixed.BOOST_SETTINGS, **prep) -> Pipeline:
    model = GBTRegressor(
        featuresCol="features",
        labelCol=label,
        predictionCol="prediction",
        maxIter=settings["rounds"],
        maxDepth=settings["depth"],
        stepSize=settings["step"],
        subsamplingRate=settings["row_share"],
        featureSubsetStrategy=settings["column_share"],
        seed=fixed.SEED,
    )
    return Pipeline(stages=[*preparation(**prep), model])


def target_means(
    rows: DataFrame, key: str, label: str, fold: Column, prior: float = 10.0, output: str = "site_mean"
) -> DataFrame:
    """``rows`` with the mean label of their key's rows in the other folds, drawn towards the mean of all rows as by ``prior`` rows of it.

    An encoding of fixed width for keys of any number: sums by (key, fold) are combined on the map side and joined back, no key comes to the driver,
    and no row sees its own label. A key that is seen in one fold only gets the mean of all.
    """
    folded = rows.withColumn("_fold", fold)
    sums = folded.where(F.col(label).isNotNull()).groupBy(key, "_fold").agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
    sums = stage(sums, "sums")
    whole = sums.groupBy(key).agg(F.sum("_s").alias("_all_s"), F.sum("_n").alias("_all_n"))
    mean = sums.agg(F.sum("_s") / F.sum("_n")).scalar()
    # One row per key and fold, so the sides meet without a hot key: what repeats are the rows, which the adaptive join may split.
    parts = sums.select(F.col(key).alias("_key"), F.col("_fold").alias("_own"), "_s", "_n")
    met = folded.join(whole.withColumnRenamed(key, "_key2"), F.col(key).eqNullSafe(F.col("_key2")), "left").join(
        parts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_fold").eqNullSafe(F.col("_own")), "left"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = (zero("_all_s") - zero("_s") + F.lit(prior) * mean) / (zero("_all_n") - zero("_n") + F.lit(prior))
    return met.withColumn(output, value).drop("_fold", "_s", "_n", "_all_s", "_all_n", "_key", "_key2", "_own")


def model_input(df: DataFrame) -> DataFrame:
    """Model columns as doubles and null-safe words; null numbers count as 0."""
    return df.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in fixed.NUMERIC_FEATURES},
            **{c: F.coalesce(F.col(c), F.lit("unknown")) for c in fixed.CATEGORICAL_FEATURES},
        }
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame, output: str) -> DataFrame:
    helpers = ["numbers", "scaled", "features"] + [
        f"{c}_{tag}" for c in fixed.CATEGORICAL_FEATURES for tag in ("code", "hot")
    ]
    return model.transform(df).withColumnRenamed("prediction", output).drop(*helpers)


def train_and_evaluate(
    table: DataFrame,
    forest: dict = fixed.FOREST_SETTINGS,
    boost: dict = fixed.BOOST_SETTINGS,
    label: str = "target_utilization_1h",
    time: str = "target_time_slot",
) -> dict:
    """Fit both tree models, weigh them on the calibration tail and evaluate all on the test part.

    Members fitted on the core part give calibration and test predictions; the published models
    are refitted on the whole training part. Returns models, weights, radii (plain numbers) and
    the prediction and metric frames.
    """
    rows = stage(model_input(table))
    split = ev.split_time(rows, time).first()
    if split is None:
        raise ValueError("no target times to split")
    cut = F.lit(split["split_time"])
    train, test = rows.where(F.col(time) <= cut), rows.where(F.col(time) > cut)
    tail = F.lit(ev.calibration_start(train, time).first()["calibration_start"])
    core, held = train.where(F.col(time) < tail), train.where(F.col(time) >= tail)

    makers = {"forest": forest_pipeline(label, forest), "boost": boost_pipeline(label, boost)}
    drafts = {name: maker.fit(core) for name, maker in makers.items()}
    both = lambda df: reduce(
        lambda d, name: score(drafts[name], d, f"_{name}"), drafts, df
    )

    calibrated = stage(both(held))
    long = calibrated.unpivot([label], [f"_{n}" for n in drafts], "model", "predicted")
    weights = {
        r["model"][1:]: r["weight"] for r in ev.ensemble_weights(long, label, "predicted").collect()
    }
    blend = ev.ensemble_value(weights, {n: f"_{n}" for n in drafts})
    radii = {
        r["model"]: r["radius"]
        for r in ev.interval_radius(
            calibrated.withColumn("_ensemble", blend).unpivot(
                [label], ["_boost", "_ensemble"], "model", "predicted"
            ),
            label,
            "predicted",
        ).collect()
    }

    tested = stage(both(test).withColumn("_ensemble", blend))
    boosted = ev.prediction_interval(
        ev.prediction_frame(tested, MODEL_NAMES["boost"], F.col("_boost")), radii["_boost"]
    )
    blended = ev.prediction_interval(
        ev.prediction_frame(tested, "Weighted Ensemble", F.col("_ensemble")), radii["_ensemble"]
    )
    predictions = (
        ev.prediction_frame(tested, "Persistence Baseline", F.col("utilization"))
        .unionByName(ev.prediction_frame(tested, MODEL_NAMES["forest"], F.col("_forest")))
        .unionByName(boosted, allowMissingColumns=True)
        .unionByName(blended, allowMissingColumns=True)
    )
    metrics = ev.metrics_table(predictions, label, "predicted_utilization_1h").withColumn(
        "split", F.lit("test")
    )
    return {
        "models": {name: maker.fit(train) for name, maker in makers.items()},
        "weights": weights,
        "radius": radii["_ensemble"],
        "split_time": split["split_time"],
        "predictions": predictions,
        "metrics": metrics,
        "rows": rows,
    }


def score_latest(latest: DataFrame, trained: dict) -> DataFrame:
    """The forecast board: newest rows scored by the ensemble with interval and free spaces."""
    scored = reduce(
        lambda d, name: score(trained["models"][name], d, f"_{name}"),
        trained["models"],
        model_input(latest),
    )
    blend = ev.ensemble_value(trained["weights"], {n: f"_{n}" for n in trained["models"]})
    named = (
        scored.withColumn("predicted_utilization_1h", blend)
        .withColumnRenamed("_forest", "rf_predicted_utilization_1h")
        .drop("_boost")
    )
    return ev.prediction_interval(named, trained["radius"]).withColumn(
        "predicted_available_spaces_1h", X.free_spaces("capacity", "predicted_utilization_1h")
    )


def multi_horizon(table: DataFrame, boost: dict = fixed.BOOST_SETTINGS) -> tuple[DataFrame, DataFrame]:
    """One boosted model per horizon, each with its own time split. Returns metrics and predictions."""
    rows = stage(model_input(table))
    frames = []
    for name, (target, time) in fixed.HORIZONS.items():
        usable = rows.dropna(subset=[target, time])
        cut = F.lit(ev.split_time(usable, time).first()["split_time"])
        model = boost_pipeline(target, boost).fit(usable.where(F.col(time) <= cut))
        tested = score(model, usable.where(F.col(time) > cut), "_p")
        frames.append(
            tested.select(
                F.lit(name).alias("forecast_horizon"),
                F.lit(target).alias("target_column"),
                "system_code",
                "time_slot",
                F.col(time).alias("target_time"),
                "capacity",
                F.col(target).alias("actual"),
                X.clip("_p").alias("predicted_utilization"),
                X.free_spaces("capacity", "_p").alias("predicted_available_spaces"),
            )
        )
    predictions = reduce(DataFrame.unionByName, frames)
    metrics = ev.metrics_table(
        predictions, "actual", "predicted_utilization", ["forecast_horizon", "target_column"]
    ).withColumn("model", F.concat(F.lit("Boosted Trees "), F.col("forecast_horizon")))
    return metrics, predictions


def backtest_persistence(
    table: DataFrame,
    actual: str = "target_utilization_1h",
    current: str = "utilization",
    time: str = "target_time_slot",
) -> DataFrame:
    """Per-window metrics of the forecast that nothing changes."""
    tests = ev.assign_windows(table, ev.backtest_plan(table, time), time)
    spans = ["window", "train_end_time", "test_start_time", "test_end_time"]
    return ev.metrics_table(tests, actual, current, spans).withColumn("model", F.lit("Rolling Persistence"))


def backtest(
    table: DataFrame, boost: dict = fixed.BOOST_SETTINGS, time: str = "target_time_slot"
) -> tuple[DataFrame, DataFrame]:
    """Rolling-origin comparison of the boosted model with persistence. Returns metrics, predictions."""
    label = "target_utilization_1h"
    rows = stage(model_input(table))
    plan = ev.backtest_plan(rows, time).orderBy("window").collect()  # at most one row per window
    base = backtest_persistence(rows)
    if not plan:
        return base, rows.limit(0)
    frames = []
    for w in plan:
        train = rows.where(F.col(time) <= F.lit(w["train_end_time"]))
        test = rows.where(F.col(time).between(F.lit(w["test_start_time"]), F.lit(w["test_end_time"])))
        model = boost_pipeline(label, boost).fit(train)
        frames.append(
            score(model, test, "_p").select(
                "system_code",
                "time_slot",
                time,
                label,
                "capacity",
                F.lit(w["window"]).cast("int").alias("window"),
                *[F.lit(w[c]).alias(c) for c in ("train_end_time", "test_start_time", "test_end_time")],
                X.clip("_p").alias("predicted_utilization_1h"),
            )
        )
    predictions = reduce(DataFrame.unionByName, frames)
    spans = ["window", "train_end_time", "test_start_time", "test_end_time"]
    fitted = ev.metrics_table(predictions, label, "predicted_utilization_1h", spans).withColumn(
        "model", F.lit("Rolling Boosted Trees")
    )
    metrics = fitted.unionByName(base).withColumn("split", F.lit("backtest"))
    return metrics, predictions.withColumn("model", F.lit("Rolling Boosted Trees"))


def feature_importance(model: PipelineModel, sample: DataFrame, n: int = 15) -> DataFrame:
    """The n largest importances by feature name (one entry per model input, not per row)."""
    spark = sample.sparkSession
    attrs = model.transform(sample.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    tree = model.stages[-1]
    pairs = [
        (names.get(i, f"feature_{i}"), float(v)) for i, v in enumerate(tree.featureImportances.toArray())
    ]
    rows = spark.createDataFrame(pairs, "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(n)


def sequence_regressor(
    windows: DataFrame, split_time: str | None = None, label: str = "target_value"
) -> tuple[PipelineModel, DataFrame]:
    """Linear model on flattened, standardised windows; returns it with its test predictions.

    Each feature is standardised over all training rows and steps (spread below 1e-6 counts as 1).
    The width is taken from the declared features, not from the rows.
    """
    rows = stage(windows)
    cut = (
        F.lit(split_time)
        if split_time
        else F.lit(ev.split_time(rows, "target_time_slot").first()["split_time"])
    )
    train = rows.where(F.col("target_time_slot") <= cut)
    # Means and spreads per feature: one row per feature.
    steps = train.select(F.explode("sequence").alias("step")).select(F.posexplode("step").alias("i", "v"))
    moments = (
        steps.groupBy("i")
        .agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))))
        .scalar()
    )
    spread = lambda p: F.when(p["s"] < 1e-6, F.lit(1.0)).otherwise(p["s"])
    flat = F.flatten(
        F.transform(
            "sequence",
            lambda step: F.zip_with(step, F.col("_moments"), lambda x, p: (x - p["m"]) / spread(p)),
        )
    )
    ready = stage(
        rows.withColumn("_moments", moments).withColumn("features", array_to_vector(flat)).drop("_moments")
    )
    model = Pipeline(
        stages=[
            LinearRegression(featuresCol="features", labelCol=label, regParam=1e-3, standardization=False)
        ]
    ).fit(ready.where(F.col("target_time_slot") <= cut))
    tested = model.transform(ready.where(F.col("target_time_slot") > cut))
    return model, tested.withColumn("predicted_value", X.clip("prediction")).drop("prediction", "features")
