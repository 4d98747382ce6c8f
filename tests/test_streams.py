"""Streams equal their batch counterparts; late rows, replays and resets."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotline import schemas
from slotline.checks import adapters as A
from slotline.operators import spatial
from slotline.plans.features import build_clean
from slotline.session import scratch_path, stage
from slotline.sources import tables as S
from slotline.streaming import board as B
from slotline.streaming import ingest, live


@pytest.fixture(scope="module")
def slots(spark, small):
    return stage(build_clean(A.observations(spark, small)), "slots")


def write_in_order(df, path, parts, by="time_slot"):
    """Several files in time order, so that the stream sees several micro-batches."""
    rows = df.orderBy(by).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        piece = df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        piece.coalesce(1).write.mode("append").parquet(path)


def test_stateful_features_equal_batch(spark, slots):
    path = scratch_path(spark, "in")
    write_in_order(slots, path, 3)
    stream = ingest.read_files(spark, path, slots.schema, files_per_batch=1)
    out = ingest.drain(live.live_feature_stream(stream), scratch_path(spark, "out"), scratch_path(spark, "cp"))
    got = out.toPandas().sort_values(["system_code", "time_slot"]).reset_index(drop=True)
    want = live.site_history(slots).toPandas().sort_values(["system_code", "time_slot"]).reset_index(drop=True)
    assert len(got) == len(want) and not got["is_late"].any()
    for name in [*live.FEATURES, "session_step", "minutes_from_previous"]:
        a, b = got[name].astype(float), want[name].astype(float)
        assert np.allclose(a, b, equal_nan=True, atol=1e-9), name


def test_late_rows_go_aside(spark, slots):
    one = slots.where(F.col("system_code") == slots.first().system_code)
    late = one.orderBy("time_slot").limit(1)
    path = scratch_path(spark, "in")
    one.coalesce(1).write.parquet(path)
    late.coalesce(1).write.mode("append").parquet(path)
    stream = ingest.read_files(spark, path, slots.schema, files_per_batch=1)
    out = ingest.drain(live.live_feature_stream(stream), scratch_path(spark, "out"), scratch_path(spark, "cp"))
    assert out.where("is_late").count() == 1
    assert out.where("NOT is_late").count() == one.count()


def test_live_rows_see_only_the_past(spark, slots):
    edges = spatial.knn_graph(spatial.canonical_sites(slots))
    rows = live.live_features(slots, edges)
    assert rows.count() == slots.count()
    assert rows.where(F.col("neighbor_utilization_mean") > 1.0000001).count() == 0


def test_ingest_split_and_replay(spark):
    good = ("a", 1.0, 3, "low", 0, "2024-01-01 08:00:00", None, 10.0, None, None)
    rows = [
        good,
        ("a", 1.0, None, None, None, None, None, None, None, None),
        ("a", 1.0, 31, "low", 0, None, None, None, None, None),
        ("a", -1.0, 0, "low", 0, None, None, None, None, None),
        ("zzz", 1.0, 0, "low", 0, None, None, None, None, None),
        ("a", 1.0, 0, "low", 0, "noon-ish", None, None, None, None),
        ("a", 1.0, 0, "low", 2, None, None, 0.0, None, None),
        ("a", None, 0, "jam", 0, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schemas.INGEST_EVENT)
    known = spark.createDataFrame([("a",)], "system_code string")
    problems = [r.problems for r in ingest.validate(df.coalesce(1), known).collect()]
    assert sorted(problems) == sorted(
        ["", "", "queue_length", "occupancy", "unknown_key", "timestamp", "is_special_day,capacity",
         "occupancy,traffic_condition_nearby"]
    )
    path = scratch_path(spark, "in")
    df.coalesce(1).write.parquet(path)
    ok, bad, cp = (scratch_path(spark, n) for n in ("ok", "bad", "cp"))
    for _ in range(2):  # the second run finds nothing new
        stream = ingest.read_files(spark, path, schemas.INGEST_EVENT)
        ingest.split_stream(stream, known, ok, bad, cp).awaitTermination()
    valid = spark.read.parquet(ok)
    assert valid.count() == 2 and spark.read.parquet(bad).count() == 6
    assert valid.where("queue_length IS NULL OR traffic_condition_nearby IS NULL").count() == 0


def test_board_versions(spark):
    path = scratch_path(spark, "board")
    at = datetime(2024, 1, 1)
    make = lambda rows: spark.createDataFrame(rows, "k string, at timestamp, n int, v double")
    base = make([("a", at, 0, 1.0), ("b", at, 0, 2.0)])
    assert B.seed_if_empty(base, path) and not B.seed_if_empty(base, path)
    later = at + timedelta(minutes=30)
    batch = make([("a", later, 1, 5.0), ("a", later, 2, 6.0), ("c", at, 0, 3.0), ("b", at - timedelta(days=1), 9, 9.0)])
    assert B.upsert_batch(batch, path, 0, "k", ["at", "n"])
    state = lambda: {r.k: r.v for r in B.read_board(spark, path).collect()}
    assert state() == {"a": 6.0, "b": 2.0, "c": 3.0}
    assert not B.upsert_batch(make([("a", later, 3, 0.0)]), path, 0, "k", ["at", "n"])
    assert state()["a"] == 6.0
    B.reset(base, path)
    assert state() == {"a": 1.0, "b": 2.0}
    # The batch after a reset is merged, and another source's batch 0 is no replay of this one's.
    assert B.upsert_batch(make([("a", later, 3, 7.0)]), path, 1, "k", ["at", "n"])
    assert B.upsert_batch(make([("b", later, 1, 8.0)]), path, 0, "k", ["at", "n"], "other")
    assert not B.upsert_batch(make([("b", later, 9, 0.0)]), path, 0, "k", ["at", "n"], "other")
    assert state() == {"a": 7.0, "b": 8.0}


def test_fresh_checkpoints_lose_nothing(spark):
    known = spark.createDataFrame([("a",)], "system_code string")
    ok, bad, board = (scratch_path(spark, n) for n in ("ok", "bad", "board"))
    for run in range(2):
        rows = [("a", float(run), 3, "low", 0, f"2024-01-0{run + 1} 08:00:00", None, 10.0, None, None),
                ("a", float("nan"), 3, "low", 0, None, None, 10.0, None, None)]
        path = scratch_path(spark, "in")
        spark.createDataFrame(rows, schemas.INGEST_EVENT).coalesce(1).write.parquet(path)
        stream = ingest.read_files(spark, path, schemas.INGEST_EVENT)
        ingest.split_stream(stream, known, ok, bad, scratch_path(spark, "cp")).awaitTermination()
        changes = ingest.read_files(spark, path, schemas.INGEST_EVENT).where("NOT isnan(occupancy)")
        B.board_stream(changes, board, scratch_path(spark, "cp"), "system_code", ["timestamp"]).awaitTermination()
    assert sorted(r.occupancy for r in spark.read.parquet(ok).collect()) == [0.0, 1.0]
    assert {r.problems for r in spark.read.parquet(bad).collect()} == {"occupancy"} and spark.read.parquet(bad).count() == 2
    assert [r.occupancy for r in B.read_board(spark, board).collect()] == [1.0]


def test_reports_and_tables_round_trip(spark):
    rows = spark.createDataFrame([("a", float("nan"), datetime(2024, 1, 1, 8, 0, 0, 123456)), ("b", 2.5, None)],
                                 "k string, v double, t timestamp")
    encoded = S.encode_payload(rows, ["k"])
    assert '"v":null' in encoded.where("k = 'a'").first().payload_json
    back = {r.k: (r.v, r.t) for r in S.decode_payload(encoded, rows.schema).collect()}
    assert back == {"a": (None, datetime(2024, 1, 1, 8, 0, 0, 123456)), "b": (2.5, None)}
    path = scratch_path(spark, "report")
    S.write_report(rows, path)
    assert S.read_report(spark, path, rows.schema).count() == 2
    names = S.register({"some_rows": rows})
    assert spark.sql(f"SELECT count(*) AS n FROM {names[0]}").first().n == 2
