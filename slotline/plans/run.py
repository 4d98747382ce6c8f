"""The whole batch run: feed in, tables, models, reports and views out.

    python -m slotline.plans.run --input feed.csv --output /shared/run1 [--small]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline import fixed
from slotline.operators import anomalies, cluster, decide, drift, profile, spatial
from slotline.operators import timeseries as ts
from slotline.plans import features, reports, training
from slotline.sources import tables as S


def run(
    observations: DataFrame,
    folder: str,
    forest: dict = fixed.FOREST_SETTINGS,
    boost: dict = fixed.BOOST_SETTINGS,
    anomaly_trees: int = fixed.ANOMALY_TREES,
) -> dict[str, str]:
    """Run every stage and return the path of each output.

    Each stage is written before the next one reads it, so a stage is computed once and a restart
    can continue from the written tables.
    """
    spark = observations.sparkSession
    paths: dict[str, str] = {}

    def put(name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        paths[name] = f"{folder.rstrip('/')}/{name}"
        S.write_table(df, paths[name], partition_by)
        back = S.read_table(spark, paths[name])
        # A partition column comes back with an inferred type.
        return back.select(*[F.col(f.name).cast(f.dataType) for f in df.schema])

    def report(name: str, df: DataFrame) -> None:
        paths[name] = f"{folder.rstrip('/')}/{name}"
        S.write_report(df, paths[name])

    clean = put("clean", features.build_clean(observations), ("date",))
    edges = put("neighbour_graph", spatial.knn_graph(spatial.canonical_sites(clean)))
    table = put("model_table", features.build_model_table(clean, edges), ("date",))

    trained = training.train_and_evaluate(table, forest, boost)
    metrics = trained["metrics"]
    predictions = trained["predictions"]
    sequences, sequence_test = training.sequence_regressor(
        ts.sequence_windows(clean), trained["split_time"]
    )
    if sequence_test.limit(1).count():
        from slotline.operators.evaluate import metrics_table

        named = sequence_test.withColumn("model", F.lit("Sequence Regressor"))
        metrics = metrics.unionByName(
            metrics_table(named, "target_value", "predicted_value").withColumn("split", F.lit("test"))
        )
        put("sequence_predictions", named.drop("sequence"))
    metrics = put("model_metrics", metrics)
    put("test_predictions", predictions)
    for name, model in {**trained["models"], "sequence": sequences}.items():
        paths[f"model_{name}"] = f"{folder.rstrip('/')}/models/{name}"
        training.save_model(model, paths[f"model_{name}"])

    horizon_metrics, horizon_predictions = training.multi_horizon(table, boost)
    horizons = put("horizon_metrics", horizon_metrics)
    put("horizon_predictions", horizon_predictions)

    profiles = put("profiles", profile.site_profiles(clean))
    clusters, cluster_figures = cluster.choose_clusters(profiles)
    put("site_clusters", clusters)

    latest = put("latest_forecast", training.score_latest(ts.latest_per_key(table), trained))
    board = put("recommendations", decide.recommend(latest))
    put("anomalies", anomalies.detect_anomalies(table, trees=anomaly_trees))

    cut = F.lit(trained["split_time"])
    reference = F.col("target_time_slot") <= cut
    drift_rows = put("drift", drift.drift_report(table, fixed.DRIFT_FEATURES, reference))
    report("drift_report", drift.drift_record(table, fixed.DRIFT_FEATURES, "target_time_slot", cut, drift_rows))
    back, back_predictions = training.backtest(table, boost)
    backtest = put("backtest_metrics", back)
    put("backtest_predictions", back_predictions)

    report(
        "model_registry",
        reports.registry_record(metrics, trained["split_time"], trained["weights"], drift_rows, backtest),
    )
    report(
        "project_summary",
        reports.project_summary(clean, metrics, horizons, board, trained["split_time"], cluster_figures),
    )
    profile.register_views(clean, board, horizons, backtest)
    return paths


def needs_retrain(spark: SparkSession, drift_path: str, threshold: float = fixed.DRIFT_CUTS[0],
                  force: bool = False) -> bool:
    """Whether the stored drift rows call for a new run."""
    return bool(drift.drift_decision(spark.read.parquet(drift_path), threshold, force).first()["retrain"])


def main() -> None:
    from slotline.session import build_session

    parser = argparse.ArgumentParser(description="Run the batch stages over an occupancy feed.")
    parser.add_argument("--input", required=True, help="feed CSV in its source header")
    parser.add_argument("--output", required=True, help="folder for tables, models and reports")
    parser.add_argument("--timestamp-format", default=None)
    parser.add_argument("--small", action="store_true", help="small models for a trial run")
    args = parser.parse_args()
    spark = build_session("slotline-run")
    feed = S.read_observations_csv(spark, args.input, args.timestamp_format)
    if args.small:
        paths = run(feed, args.output, training.SMALL_FOREST, training.SMALL_BOOST, 25)
    else:
        paths = run(feed, args.output)
    for name, path in paths.items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
