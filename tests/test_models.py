"""Fitted parts on a small synthetic week: splits, ensemble, horizons, backtest, anomalies, records."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slotline import fixed
from slotline.operators import anomalies, decide
from slotline.operators import timeseries as ts
from slotline.plans import features, reports, training
from slotline.session import scratch_path, stage

FOREST = {"trees": 5, "depth": 4, "min_leaf": 2}
BOOST = {"rounds": 4, "depth": 3, "step": 0.3, "row_share": 0.9, "column_share": "0.8"}


@pytest.fixture(scope="module")
def parts(spark):
    """Four sites with a daily wave, half-hourly from 08:00 to 17:30 for 36 days."""
    rows, rid = [], 0
    for s in range(4):
        for day in range(36):
            for i in range(20):
                at = datetime(2024, 3, 1, 8) + timedelta(days=day, minutes=30 * i)
                wave = math.sin(math.pi * i / 20) * (0.6 + 0.1 * s)
                occupancy = 100 * wave + ((rid * 7919) % 13) - 6
                rows.append(
                    (rid, f"s{s}", 100 + 10 * s, 1.0 + s, 2.0 + s * s, float(occupancy),
                     ["car", "bike", "truck"][rid % 3], ["low", "average", "high"][(rid // 3) % 3],
                     (rid * 31) % 9, int(day % 7 == 0), at)
                )
                rid += 1
    from slotline.schemas import OBSERVATIONS

    observations = spark.createDataFrame(rows, OBSERVATIONS)
    clean = stage(features.build_clean(observations), "clean")
    edges = stage(features.neighbour_graph(observations), "edges")
    table = stage(features.build_model_table(clean, edges), "model")
    return clean, edges, table


def test_model_table_has_no_future(parts):
    _, _, table = parts
    assert table.count() > 1000
    assert table.where(F.col("target_time_slot") != F.expr("time_slot + INTERVAL 1 HOUR")).count() == 0
    assert table.dropna(subset=fixed.REQUIRED_FEATURES).count() == table.count()


def test_training_board_and_records(spark, parts):
    clean, _, table = parts
    trained = training.train_and_evaluate(table, FOREST, BOOST)
    assert math.isclose(sum(trained["weights"].values()), 1.0)
    metrics = {r.model: r for r in trained["metrics"].collect()}
    assert set(metrics) == {"Persistence Baseline", "Random Forest", "Boosted Trees", "Weighted Ensemble"}
    assert metrics["Random Forest"].rmse < metrics["Persistence Baseline"].rmse
    assert all(r.n == metrics["Random Forest"].n for r in metrics.values())

    path = scratch_path(spark, "saved")
    training.save_model(trained["models"]["forest"], path)
    again = training.load_model(path)
    sample = training.model_input(table.orderBy("system_code", "time_slot").limit(20))
    a = [r._p for r in training.score(again, sample, "_p").orderBy("system_code", "time_slot").collect()]
    b = [r._p for r in training.score(trained["models"]["forest"], sample, "_p").orderBy("system_code", "time_slot").collect()]
    assert a == b

    board = stage(decide.recommend(training.score_latest(ts.latest_per_key(table), trained)), "board")
    assert board.count() == 4
    assert board.where("predicted_utilization_1h NOT BETWEEN 0 AND 1").count() == 0

    drift_rows = spark.createDataFrame([("a", 0.3), ("b", 0.01)], "feature string, psi double")
    record = reports.registry_record(trained["metrics"], trained["split_time"], trained["weights"], drift_rows).first()
    assert record.champion_model in metrics and record.feature_count == 47
    assert [x.feature for x in record.drift_summary] == ["a", "b"]
    horizons = trained["metrics"].select(F.col("model").alias("forecast_horizon"), "rmse")
    summary = reports.project_summary(clean, trained["metrics"], horizons, board, trained["split_time"]).first()
    assert summary.dataset_summary.rows == clean.count() and summary.top_recommendation.startswith("s")

    jobs = spark.createDataFrame([], "job_id string, status string, created_at timestamp, started_at timestamp, "
                                     "finished_at timestamp, message string")
    ops = reports.ops_summary(board, drift_rows, jobs, trained["metrics"]).first()
    assert {x.severity: x.n for x in ops.alert_counts}["critical"] >= 1
    assert any(a.title == "No retraining jobs on record" for a in ops.alerts)


def test_horizons_backtest_sequences(parts):
    clean, _, table = parts
    metrics, predictions = training.multi_horizon(table, BOOST)
    assert {r.forecast_horizon for r in metrics.collect()} == set(fixed.HORIZONS)
    assert predictions.where("predicted_utilization NOT BETWEEN 0 AND 1").count() == 0
    back, _ = training.backtest(table, BOOST)
    assert {(r.window, r.model) for r in back.collect()} == {
        (w, m) for w in (1, 2, 3) for m in ("Rolling Boosted Trees", "Rolling Persistence")
    }
    _, tested = training.sequence_regressor(ts.sequence_windows(clean))
    assert tested.count() > 100
    error = tested.agg(F.sqrt(F.avg(F.pow(F.col("target_value") - F.col("predicted_value"), 2)))).first()[0]
    assert error < 0.3


def test_feature_names_survive(parts):
    _, _, table = parts
    rows = training.model_input(table)
    model = training.forest_pipeline("target_utilization_1h", FOREST).fit(rows)
    top = training.feature_importance(model, rows).collect()
    assert len(top) == 15 and not any(r.feature.startswith("feature_") for r in top)


def test_isolation_finds_planted_rows(spark):
    rows = [(i, float(i % 10) / 10, float(i % 7)) for i in range(600)] + [(9000, 40.0, 90.0), (9001, -30.0, 80.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    scored = anomalies.isolation_scores(df, ["a", "b"], ["id"], trees=30, sample=128)
    top = [r.id for r in scored.orderBy(F.desc("anomaly_score")).limit(2).collect()]
    assert sorted(top) == [9000, 9001]
    again = anomalies.isolation_scores(df.repartition(5), ["a", "b"], ["id"], trees=30, sample=128)
    diff = scored.join(again.select("id", F.col("anomaly_score").alias("other")), "id").where("anomaly_score <> other")
    assert diff.count() == 0
    flagged = anomalies.flag_above_quantile(scored, "anomaly_score")
    assert 1 <= flagged.where("anomaly_flag = 1").count() <= 0.03 * 602 + 1


def test_whole_run(spark, tmp_path):
    """The batch run end to end on a generated feed, read back through its own outputs."""
    rows, rid = [], 0
    for s in range(4):
        for day in range(12):
            for i in range(20):
                at = datetime(2024, 3, 1, 8) + timedelta(days=day, minutes=30 * i)
                level = 80 * math.sin(math.pi * i / 20) + ((rid * 7919) % 13)
                rows.append((rid, f"s{s}", 100 + s, 1.0 + s, 2.0 + s * s, level, "car", "low", rid % 5, 0, at))
                rid += 1
    from slotline.operators import profile
    from slotline.plans.run import needs_retrain, run
    from slotline.schemas import DRIFT_REPORT, INGEST_EVENT, OBSERVATIONS
    from slotline.sources import tables as S
    from slotline.streaming import score

    paths = run(spark.createDataFrame(rows, OBSERVATIONS), str(tmp_path), FOREST, BOOST, 10)
    read = lambda name: spark.read.parquet(paths[name])
    assert read("clean").count() == len(rows)
    assert {r.model for r in read("model_metrics").collect()} >= {"Sequence Regressor", "Weighted Ensemble"}
    assert read("recommendations").count() == 4 and read("site_clusters").count() == 4
    assert spark.sql("SELECT * FROM vw_daily_system_summary").count() == 48
    record = S.read_report(spark, paths["drift_report"], DRIFT_REPORT).first()
    assert len(record.features) == len(fixed.DRIFT_FEATURES)
    psi = [f.psi for f in record.features]
    assert psi == sorted(psi, reverse=True)
    assert needs_retrain(spark, paths["drift"], force=True)

    # Live path on top of the written tables.
    history, edges = read("clean"), read("neighbour_graph")
    last = history.where("system_code = 's1'").agg(F.max("time_slot")).first()[0]
    later = (last + timedelta(minutes=30)).strftime("%Y-%m-%d %H:%M:%S")
    blank = (None, None, None, None)
    events = spark.createDataFrame(
        [("s1", 70.0, 3, "high", 0, later, *blank), ("s2", 500.0, 0, "low", 0, None, *blank)], INGEST_EVENT
    )
    live = score.live_rows(events, history, edges)
    models = {"boost": training.load_model(paths["model_boost"]), "forest": training.load_model(paths["model_forest"])}
    out = {r.system_code: r for r in score.score_live(live, models, {"boost": 0.5, "forest": 0.5}, read("latest_forecast")).collect()}
    before = history.where(F.col("system_code") == "s1").orderBy(F.desc("time_slot")).limit(2).collect()
    assert set(out) == {"s1", "s2"}
    assert out["s1"].lag_utilization_30m == before[0].utilization
    assert out["s1"].lag_utilization_60m == before[1].utilization
    assert out["s1"].session_step == before[0].session_step + 1
    assert out["s2"].occupancy_clean == 102 and out["s2"].utilization == 1.0
    assert all(0 <= r.prediction_interval_lower <= r.prediction_interval_upper <= 1 for r in out.values())
    board = read("recommendations")
    assert profile.label_counts(board).agg(F.sum("count")).first()[0] == 4
