"""Scenarios, rankings and window roles on small boards."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slotline.operators import decide
from slotline.operators import evaluate as ev
from slotline.sources import tables as S


@pytest.fixture(scope="module")
def board(spark):
    rows = [(f"s{i}", 100 + 10 * i, 0.1 * i, 0.1 * i + 0.05, 3 * i, 10.0 * i) for i in range(1, 10)]
    names = "system_code string, capacity long, utilization double, predicted_utilization_1h double, queue_length int, occupancy_clean double"
    df = spark.createDataFrame(rows, names).withColumns(
        {
            "prediction_interval_lower": F.lit(None).cast("double"),
            "prediction_interval_upper": F.lit(None).cast("double"),
            "capacity_pressure": F.col("queue_length") / F.col("capacity"),
            "predicted_available_spaces_1h": F.rint(F.col("capacity") * (1 - F.col("predicted_utilization_1h"))),
        }
    )
    return decide.score_board(df)


def test_spillover(spark, board):
    edges = spark.createDataFrame(
        [("s9", "s1", 1.0, 0.2), ("s9", "s2", 1.0, 0.5), ("s9", "s3", 1.0, 0.3), ("s9", "gone", 1.0, 0.1), ("s1", "s4", 1.0, 1.0)],
        "system_code string, neighbor_code string, distance double, weight double",
    )
    out = {r.system_code: r for r in decide.stress_scenario(board, "spillover_disruption", 1, edges).collect()}
    assert set(out) == {"s9", "s1", "s2", "s3"}
    assert out["s9"].occupancy == pytest.approx(190 * 0.99)  # 0.9 + 0.12 + 0.02 is capped
    assert out["s9"].queue_length == 30  # 27 + 6 is capped
    assert out["s2"].occupancy == pytest.approx(20 + 120 * 0.055) and out["s2"].queue_length == 9
    with pytest.raises(ValueError):
        decide.stress_scenario(board, "spillover_disruption", 1)
    with pytest.raises(ValueError):
        decide.stress_scenario(board, "unheard_of", 1)


def test_relief_clamps(board):
    out = {r.system_code: r for r in decide.stress_scenario(board, "holiday_relief", 3).collect()}
    assert len(out) == 8 and "s1" not in out
    assert all(r.queue_length <= 2 and r.traffic_condition_nearby == "low" for r in out.values())
    assert all(r.occupancy >= 0 for r in out.values())


def test_objectives(board):
    best = decide.objective_rank(board, "Lowest Risk", 3).orderBy("recommendation_rank").collect()
    assert [r.system_code for r in best] == ["s1", "s2", "s3"] and [r.recommendation_rank for r in best] == [1, 2, 3]
    unknown = decide.objective_rank(board, "Whatever", 3).select("system_code").collect()
    assert unknown == decide.objective_rank(board, "Balanced", 3).select("system_code").collect()
    for i, r in enumerate(decide.top_n(board, "balanced_score", 9).collect(), start=1):
        assert decide.rank_of(board, F.lit(r.system_code)).first()[0] == i


def test_window_roles(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, start + timedelta(minutes=30 * i)) for i in range(461)], "i int, t timestamp")
    plan = ev.backtest_plan(df, "t")
    tests = {r.window: r["count"] for r in ev.assign_windows(df, plan, "t").groupBy("window").count().collect()}
    trains = {r.window: r["count"] for r in ev.assign_windows(df, plan, "t", "train").groupBy("window").count().collect()}
    assert tests == {1: 120, 2: 120, 3: 120}
    assert trains == {1: 101, 2: 221, 3: 341}


def test_partitioned_table_and_pruned_read(spark, tmp_path, board):
    path = str(tmp_path / "board")
    S.write_table(board, path, partition_by=["risk_band"])
    assert S.read_table(spark, path, ["system_code", "risk_band"]).count() == 9
    S.write_table(board.limit(2), path, partition_by=["risk_band"])
    assert S.read_table(spark, path).count() == 2
    S.write_table(board.select("system_code", "capacity"), str(tmp_path / "csv"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 9


def test_publish_replaces(spark, board):
    for n in (9, 4):
        names = S.publish({"published_board": board.select("system_code", "capacity").limit(n)})
        assert spark.table(names[0]).count() == n
