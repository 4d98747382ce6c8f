"""Hand-made edge rows: rounding, bands, nulls, modes, sessions."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from slotline.functions import columns as X
from slotline.operators import timeseries as ts


def stamp(text):
    return datetime.strptime("2024-03-04 " + text, "%Y-%m-%d %H:%M:%S")


def test_slot_round_ties_go_to_even(spark):
    pairs = [("08:15:00", "08:00:00"), ("08:45:00", "09:00:00"), ("09:01:00", "09:00:00"), ("08:44:59", "08:30:00")]
    df = spark.createDataFrame([(stamp(a), stamp(b)) for a, b in pairs], "t timestamp, want timestamp")
    assert df.where(X.slot_round("t") != F.col("want")).count() == 0


def test_bands(spark):
    cases = [(-0.01, "nan"), (0.0, "Low"), (0.4, "Low"), (0.7, "Moderate"), (0.9, "High"), (1.0, "Critical"),
             (1.01, "Critical"), (1.02, "nan"), (None, "nan"), (float("nan"), "nan")]
    df = spark.createDataFrame(cases, "v double, want string")
    assert df.where(X.utilization_band("v") != F.col("want")).count() == 0


def test_total_risk_band(spark):
    cases = [(-1.0, "Low"), (0.55, "Low"), (0.75, "Moderate"), (0.9, "High"), (5.0, "Critical")]
    df = spark.createDataFrame(cases, "v double, want string")
    assert df.where(X.risk_band_total("v") != F.col("want")).count() == 0


def test_half_even_and_clips(spark):
    row = spark.range(1).select(
        X.half_even(F.lit(2.5)).alias("a"),
        X.half_even(F.lit(3.5)).alias("b"),
        X.floor_at(F.lit(None).cast("double")).alias("c"),
        X.clip(F.lit(None).cast("double")).alias("d"),
        X.ratio(F.lit(1), F.lit(0)).alias("e"),
        X.ordinal(F.lit("HIGH"), {"low": 0, "high": 2}).alias("f"),
        X.ordinal(F.lit(None).cast("string"), {"low": 0}).alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == (2.0, 4.0, None, None, None, 2, 1)


def slot_rows(spark, rows):
    return spark.createDataFrame(rows, "capacity long, occupancy double, queue_length double")


def test_null_occupancy_counts_as_full_or_stays(spark):
    df = slot_rows(spark, [(10, None, None), (10, 12.0, -1.0), (0, 5.0, 1.0), (10, float("nan"), 1.0)])
    full = ts.clean_measures(df).collect()
    assert [r.occupancy_clean for r in full] == [10.0, 10.0, 0.0, 10.0]
    assert [r.occupancy_anomaly_flag for r in full] == [0, 1, 1, 0]
    assert full[0].queue_length is None and full[1].queue_length == 0
    assert full[2].utilization is None
    assert ts.clean_measures(df, null_occupancy="keep").first().occupancy_clean is None
    with pytest.raises(ValueError):
        ts.clean_measures(df, null_occupancy="guess")


def observations(spark, rows):
    names = "record_id long, system_code string, timestamp timestamp, vehicle_type string"
    df = spark.createDataFrame(rows, names)
    return df.withColumns(
        {
            "capacity": F.lit(10).cast("long"),
            "latitude": F.lit(1.0),
            "longitude": F.lit(2.0),
            "occupancy": F.when(F.col("record_id") == 1, F.lit(float("nan"))).otherwise(F.col("record_id").cast("double")),
            "traffic_condition_nearby": F.lit(None).cast("string"),
            "queue_length": F.lit(1).cast("long"),
            "is_special_day": F.lit(0),
        }
    )


def test_slot_aggregate_modes_nan_and_null_keys(spark):
    rows = [
        (1, "a", stamp("08:00:00"), "car"),
        (2, "a", stamp("08:05:00"), "bike"),
        (3, "a", stamp("07:50:00"), None),
        (4, None, stamp("08:00:00"), "car"),
        (5, "a", None, "car"),
    ]
    out = ts.slot_aggregate(observations(spark, rows)).collect()
    assert len(out) == 1
    assert out[0].vehicle_type == "bike" and out[0].traffic_condition_nearby is None
    assert out[0].occupancy == 2.5 and out[0].record_id == 1


def test_sessions_lags_and_single_row_session(spark):
    times = ["08:00:00", "08:30:00", "09:00:00", "10:00:00"]
    df = spark.createDataFrame(
        [(i, "a", stamp(t), float(i)) for i, t in enumerate(times)],
        "record_id long, system_code string, time_slot timestamp, utilization double",
    )
    rows = (
        ts.sessionize(df)
        .transform(ts.session_progress)
        .transform(ts.lags, {"back": ("utilization", 1)})
        .transform(ts.rolling_means, {"mean2": ("utilization", 2)})
        .orderBy("time_slot")
        .collect()
    )
    assert [r.session_id for r in rows] == [1, 1, 1, 2]
    assert [r.minutes_from_previous for r in rows] == [0, 30, 30, 60]
    assert [r.session_step for r in rows] == [0, 1, 2, 0]
    assert [r.back for r in rows] == [None, 0.0, 1.0, None]
    assert [r.mean2 for r in rows] == [None, 0.0, 0.5, None]
    assert rows[3].session_progress == 0


def test_sequences_need_nine_rows(spark):
    def windows(n):
        df = spark.createDataFrame(
            [("a", 1, stamp(f"{8 + i // 2:02d}:{30 * (i % 2):02d}:00"), float(i)) for i in range(n)],
            "system_code string, session_id int, time_slot timestamp, utilization double",
        )
        return ts.sequence_windows(df, ["utilization"]).orderBy("time_slot").collect()

    assert windows(8) == []
    out = windows(9)
    assert len(out) == 2
    assert [x[0] for x in out[0].sequence] == [0, 1, 2, 3, 4, 5] and out[0].target_value == 7
