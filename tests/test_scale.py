"""Hot keys, tight spots and long runs: the split paths against plain Python, with bounds set low enough to be reached."""

import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotline.checks import adapters as A
from slotline.operators import activity, anomalies, asof, cluster, decide, figures, profile, ranks, spatial
from slotline.operators.asof import asof_join
from slotline.plans import boosted, normal, training
from slotline.plans.features import build_clean
from slotline.session import scratch_path, stage
from slotline.streaming import board as B
from slotline.streaming import ingest, keyed, live

START = datetime(2024, 1, 1)


# --- keyed state -------------------------------------------------------------


def slots_of(spark, sites):
    rng = np.random.default_rng(6)
    rows = []
    for site, times in sites.items():
        for t in times:
            occupied, queue = float(rng.uniform(0, 90)), float(rng.integers(0, 9))
            rows.append((site, t, occupied, occupied / 100, queue, occupied / 140 + queue / 1000, None, 1, int(t.hour * 2 + t.minute // 30)))
    schema = "system_code string, time_slot timestamp, occupancy_clean double, utilization double, queue_length double, parking_stress_index double, record_id long, capacity int, slot_index int"
    return spark.createDataFrame(rows, schema)


def as_streamed(spark, parts, **options):
    path = scratch_path(spark, "in")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    stream = ingest.read_files(spark, path, parts[0].schema, files_per_batch=1)
    return ingest.drain(keyed.feature_stream(stream, **options), scratch_path(spark, "out"), scratch_path(spark, "cp"))


def same_features(got, want, extra=()):
    a = got.where("NOT is_late").toPandas().sort_values(["system_code", "time_slot"]).reset_index(drop=True)
    b = want.toPandas().sort_values(["system_code", "time_slot"]).reset_index(drop=True)
    assert len(a) == len(b)
    for name in [*live.FEATURES, "session_step", "minutes_from_previous", *extra]:
        assert np.allclose(a[name].astype(float), b[name].astype(float), equal_nan=True, atol=1e-9), name


def half_hours(n, skip=()):
    return [START + timedelta(minutes=30 * i) for i in range(n) if i not in skip]


def test_a_site_with_more_rows_than_a_batch_is_parked_by_day(spark):
    """Arrow batches of 50 rows: one site sends 900 at once, shuffled, with repeats."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        slots = slots_of(spark, {"long": half_hours(900, range(100, 140)), "short": half_hours(20)})
        shuffled = slots.orderBy(F.rand(3))
        got = stage(as_streamed(spark, [shuffled.unionByName(shuffled.where("system_code = 'long' AND minute(time_slot) = 0").limit(7))]), "got")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.where("is_late").count() == 7
    same_features(got, live.site_history(slots))


def test_neighbours_live_with_the_site(spark, small):
    slots = stage(build_clean(A.observations(spark, small)), "slots")
    edges = stage(spatial.knn_graph(spatial.canonical_sites(slots)), "edges")
    third = slots.agg(F.expr("percentile_approx(time_slot, 0.33)")).first()[0]
    old, new = slots.where(F.col("time_slot") < third), slots.where(F.col("time_slot") >= third)
    want = live.live_features(slots, edges)
    same_features(as_streamed(spark, [slots], edges=edges), want, keyed.CONTEXT)
    same_features(as_streamed(spark, [new], edges=edges, history=old), want.where(F.col("time_slot") >= third), keyed.CONTEXT)


def test_silent_sites_expire(spark):
    """After 40 days without a row, with 30 allowed, a site starts anew; another site moves the stream's time on."""
    first, gap = half_hours(10), timedelta(days=40)
    parts = [
        slots_of(spark, {"a": first, "b": first}),
        slots_of(spark, {"b": [t + gap for t in first]}),
        slots_of(spark, {"b": [t + gap + timedelta(days=1) for t in first]}),
        slots_of(spark, {"a": [t + gap + timedelta(days=1) for t in first]}),
    ]
    rows = as_streamed(spark, parts, idle_days=30).where("system_code = 'a'").orderBy("time_slot").collect()
    assert [r.lag_utilization_30m is None for r in rows] == [i % 10 == 0 for i in range(20)]
    kept = as_streamed(spark, parts, idle_days=None).where("system_code = 'a'").orderBy("time_slot").collect()
    assert kept[10].lag_utilization_30m is not None


def test_templates_stand_in_for_short_histories(spark):
    slots = slots_of(spark, {"a": half_hours(60)})
    rows = live.site_history(slots).toPandas().sort_values("time_slot").reset_index(drop=True)
    tail = live.site_history(slots).where(F.col("time_slot").between(START + timedelta(minutes=30 * 57), START + timedelta(minutes=30 * 58)))
    got = as_streamed(spark, [slots.where(F.col("time_slot") == START + timedelta(minutes=30 * 59))], history=tail).first()
    assert got.lag_utilization_30m == rows.utilization[58] and got.lag_utilization_60m == rows.utilization[57]
    assert got.lag_utilization_120m == rows.lag_utilization_120m[58] and got.lag_utilization_prev_day == rows.lag_utilization_prev_day[58]
    assert got.rolling_utilization_6 == pytest.approx((rows.utilization[57] + rows.utilization[58]) / 2) and got.session_step == rows.session_step[58] + 1


# --- boards ------------------------------------------------------------------


def test_ranks_and_figures_follow_upserts(spark, small):
    board = stage(figures.with_buckets(ranks.with_bucket(decide.score_board(A.board(spark, small)))).withColumn("version", F.lit(0)), "board")
    index, told = stage(ranks.build_index(board), "index"), None
    told = stage(figures.after_changes(None, board.limit(0), board), "told")
    for turn in range(1, 4):
        changed = A.board(spark, small, {"predicted_utilization_1h": f"CAST((p_size * {turn + 2}) % 50 AS DOUBLE) / 50"})
        new = figures.with_buckets(ranks.with_bucket(decide.score_board(changed.where(F.col("system_code") % 5 == turn)))).withColumn("version", F.lit(turn))
        new = stage(new.select(*board.columns), "new")
        before = board.join(new.select("system_code"), "system_code", "left_semi")
        index = stage(ranks.index_after(index, before, new), "index")
        told = stage(figures.after_changes(told, before, new), "told")
        board = stage(activity.upsert_latest(board, new, "system_code", ["version"]), "board")
    rows = sorted(board.select("balanced_score", "system_code").collect(), key=lambda r: (-r.balanced_score, r.system_code))
    for place in (0, 7, len(rows) // 2, len(rows) - 1):
        assert ranks.rank_from_index(board, index, F.lit(rows[place].system_code)).first()[0] == place + 1
    assert ranks.rank_from_index(board, index, F.lit(-5)).first()[0] is None
    got, want = figures.snapshot(told, board).first().asDict(), profile.board_snapshot(board).first().asDict()
    assert got.pop("mean_utilization") == pytest.approx(want.pop("mean_utilization"), abs=1e-9) and got == want
    plan = ranks.rank_from_index(board, index, F.lit(3))._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan


def test_board_keeps_few_versions(spark):
    path = scratch_path(spark, "board")
    make = lambda n: spark.createDataFrame([("a", n), ("b", -n)], "k string, n int")
    for batch in range(9):
        assert B.upsert_batch(make(batch), path, batch, "k", ["n"], "one")
        assert B.upsert_batch(make(batch), path, batch, "k", ["n"], "two")
    assert len(B.versions(spark, path)) == B.KEPT_VERSIONS
    assert B.merged_until(spark, path, "one") == 8 and B.merged_until(spark, path, "two") == 8 and B.merged_until(spark, path, "three") == -1
    assert {r.k: r.n for r in B.read_board(spark, path).collect()} == {"a": 8, "b": 0}


# --- hot clients and keys ------------------------------------------------------


@pytest.mark.parametrize("block", [7, 64, 50_000])
def test_hot_client_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(activity, "BLOCK", block)
    rng = random.Random(9)
    at, rows = 0.0, []
    for i in range(700):
        at += rng.choice([0.2, 0.5, 1.0, 9.0]) if i % 90 else 61.0
        rows.append((i, "hot" if rng.random() < 0.8 else f"c{i % 3}", START + timedelta(seconds=round(at, 3))))
    frame = spark.createDataFrame(rows, "request_id int, client_host string, created_at timestamp").repartition(5)
    want, admitted = {}, {}
    for i, client, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        inside = admitted.setdefault(client, deque())
        while inside and t - inside[0] >= timedelta(seconds=10):
            inside.popleft()
        if len(inside) >= 4:
            want[i] = (False, 0, max(1, int((timedelta(seconds=10) - (t - inside[0])) / timedelta(seconds=1))))
        else:
            inside.append(t)
            want[i] = (True, 4 - len(inside), 0)
    got = activity.rate_admission(frame, limit=4, window_seconds=10).collect()
    assert {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in got} == want


@pytest.mark.parametrize("span, tries, most", [(100, 3, 12), (4, 3, 60), (3, 0, 90)])
def test_burst_without_a_lull_takes_a_round_per_span(spark, monkeypatch, span, tries, most):
    """One client, 30 requests a window, 50 blocks: a round per block would write 200 tables and more."""
    tables = []
    for name, value in {"BLOCK": 8, "SPAN": span, "TRIES": tries}.items():
        monkeypatch.setattr(activity, name, value)
    monkeypatch.setattr(activity, "stage", lambda df, label="stage": tables.append(label) or stage(df, label))
    rng, at, rows = random.Random(4), 0, []
    for i in range(400):
        at += rng.randrange(1, 660_000)
        rows.append((i, "hot", START + timedelta(microseconds=at)))
    frame = spark.createDataFrame(rows, "request_id int, client_host string, created_at timestamp").repartition(3)
    got = activity.rate_admission(frame, limit=3, window_seconds=10).collect()
    want, inside, gap = {}, deque(), timedelta(seconds=10)
    for i, _, t in rows:
        while inside and t - inside[0] >= gap:
            inside.popleft()
        if len(inside) >= 3:
            want[i] = (False, 0, max(1, (gap - (t - inside[0])) // timedelta(seconds=1)))
        else:
            inside.append(t)
            want[i] = (True, 3 - len(inside), 0)
    assert {r.request_id: (r.allowed, r.remaining, r.retry_after) for r in got} == want
    assert len(tables) <= most


@pytest.mark.parametrize("full", [3, 40, 10**6])
def test_asof_with_a_crowded_minute(spark, full):
    rng = random.Random(4)
    moment = lambda: START + timedelta(microseconds=rng.choice([0, 5, 6, 1_000, 30_000_000, rng.randrange(60_000_000)]))
    left = [(i, rng.choice(["hot", "hot", "hot", "b", None]), moment()) for i in range(300)]
    right = [(i, rng.choice(["hot", "hot", "b", None]), moment()) for i in range(200)]
    out = asof_join(
        spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "rid int, k string, t timestamp"),
        ["k"], "t", "t", {"rid": "seen", "t": "at"}, tie_break="rid", full=full,
    )
    got = {r.id: (r.seen, r.at) for r in out.collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        fit = [(u, r) for r, q, u in right if q == k and k is not None and u <= t]
        assert got[i] == ((max(fit)[1], max(fit)[0]) if fit else (None, None))


def test_full_buckets_of_asof_are_cut(spark):
    rows = spark.createDataFrame([(i, "hot", START + timedelta(milliseconds=20 * i)) for i in range(2000)], "id int, k string, t timestamp")
    side = rows.select(F.col("k").alias("_k0"), F.lit(0).cast("long").alias("_bucket"), F.col("t").alias("_at"))
    cut, _, instants = asof._cut_full(side, side.limit(0), ["_k0"], 86_400_000_000, 100)
    assert instants is None and cut.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= 100


# --- sites ---------------------------------------------------------------------


def test_sites_within_a_hair(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.uniform(0, 50, (300, 2)), 20 + rng.normal(0, 3e-9, (2500, 2)), 33 + rng.uniform(0, 1e-12, (200, 2))])
    frame = spark.createDataFrame([(f"s{i:05d}", float(a), float(b)) for i, (a, b) in enumerate(points)], "system_code string, latitude double, longitude double")
    got = {}
    for r in spatial.knn_graph(frame).collect():
        got.setdefault(r.system_code, []).append((r.distance, r.neighbor_code))
    for i in rng.choice(len(points), 200, replace=False):
        gaps = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        assert sorted(got[f"s{i:05d}"]) == sorted((float(x), f"s{j:05d}") for j, x in enumerate(gaps) if j != i)[:3]


def test_few_candidates_within_reach(spark, monkeypatch):
    """Only what lies within a radius with k + 1 sites is ranked, not the whole 7x7 block; lines, ties and piles included."""
    tables = {}
    monkeypatch.setattr(spatial, "stage", lambda df, label="stage": tables.setdefault(label, stage(df, label)))
    rng = np.random.default_rng(6)
    lattice = np.array([(80.0 + i, 5.0 + j) for i in range(9) for j in range(9)])
    line = np.column_stack([np.linspace(60, 61, 40), np.full(40, -7.0)])
    points = np.concatenate([rng.uniform(0, 50, (1500, 2)), lattice, line, np.repeat([[70.0, 70.0]], 7, axis=0), [[-900.0, 4.0]]])
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "system_code int, latitude double, longitude double")
    got = {}
    for r in spatial.knn_graph(frame).collect():
        got.setdefault(r.system_code, []).append((r.distance, r.neighbor_code))
    for i, at in enumerate(points):
        gaps = np.sqrt(((points - at) ** 2).sum(axis=1))
        assert sorted(got[i]) == sorted((float(x), j) for j, x in enumerate(gaps) if j != i)[:3]
    inside = [int((np.sqrt(((points - (r["_slat"], r["_slon"])) ** 2).sum(axis=1)) <= r["_reach"]).sum()) for r in tables["reach"].collect()]
    assert len(inside) == len(points) - 6 and min(inside) >= 4 and np.mean(inside) < 10


# --- models ----------------------------------------------------------------------


def test_tree_samples_are_the_least_hashes(spark):
    frame = spark.range(3000).select(F.col("id"), (F.col("id") * 0.5).alias("x")).repartition(4)
    got = anomalies.tree_samples(frame, ["id"], trees=12, sample=20, seed=3).collect()
    every = frame.crossJoin(spark.range(12).select(F.col("id").cast("int").alias("tree")))
    every = every.withColumn("h", F.xxhash64(F.lit(3), "tree", F.col("id").cast("string"))).toPandas()
    want = {(int(t), int(i)) for t, part in every.groupby("tree") for i in part.nsmallest(20, "h")["id"]}
    assert {(r["_tree"], r["id"]) for r in got} == want and len(got) == 240
    few = anomalies.tree_samples(spark.range(7).withColumn("x", F.lit(1.0)), ["id"], trees=3, sample=20, seed=3)
    assert few.groupBy("_tree").count().select("count").distinct().collect()[0][0] == 7


def test_kmeans_is_settled_and_the_best_start(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    frame = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    for k, fit in cluster.kmeans(frame, ["a", "b"], [2, 3], starts=6).items():
        own = ((x[:, None] - fit["centres"][None]) ** 2).sum(axis=2).argmin(axis=1)
        assert np.allclose([x[own == j].mean(axis=0) for j in range(k)], fit["centres"], atol=1e-6)
        assert fit["cost"] == min(fit["costs"]) == pytest.approx(((x - fit["centres"][own]) ** 2).sum())
        assert len(fit["costs"]) == 6
    placed = cluster.nearest(frame, ["a", "b"], np.array([[0.0, 0.0], [5.0, 0.0]])).toPandas()
    assert (placed["cluster"] == (((x - [5, 0]) ** 2).sum(axis=1) < (x**2).sum(axis=1)).astype(int)).all()


def test_products_by_piece_give_every_window(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + rng.normal(0, 0.1, 400)
    frame = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "t": np.arange(400)})).repartition(5)
    sums = normal.products(frame, ["a", "b", "c"], "y", F.when(F.col("t") < 150, 0).when(F.col("t") < 300, 1).otherwise(2), 3)
    for k, stop in enumerate((150, 300, 400)):
        design = np.column_stack([np.ones(stop), x[:stop]])
        assert np.allclose(normal.solve(np.cumsum(sums, axis=0)[k]), np.linalg.lstsq(design, y[:stop], rcond=None)[0], atol=1e-9)


def test_site_means_leave_the_own_fold_out(spark):
    rows = [("a", 0, 1.0), ("a", 0, 3.0), ("a", 1, 5.0), ("b", 1, 7.0), (None, 0, 2.0), ("c", 1, None)]
    frame = spark.createDataFrame(rows, "k string, f int, y double")
    got = {(r.k, r.f, r.y): r.site_mean for r in training.target_means(frame, "k", "y", F.col("f"), prior=2.0).collect()}
    mean = 18 / 5
    want = {("a", 0, 1.0): (5 + 2 * mean) / 3, ("a", 0, 3.0): (5 + 2 * mean) / 3, ("a", 1, 5.0): (4 + 2 * mean) / 4, ("b", 1, 7.0): mean, (None, 0, 2.0): mean, ("c", 1, None): mean}
    assert got == pytest.approx(want)


def brute_split(x, g, l1, l2):
    """(gain, feature, cut) of the best cut over all bins, by trying each."""
    shrink = lambda v: np.sign(v) * max(abs(v) - l1, 0.0)
    worth = lambda part: shrink(part.sum()) ** 2 / (len(part) + l2)
    best = (0.0, -1, -1)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            gain = worth(g[low]) + worth(g[~low]) - worth(g)
            if gain > best[0] + 1e-12:
                best = (gain, f, int(cut))
    return best


def test_one_round_equals_a_search_of_all_cuts(spark):
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.normal(size=300), rng.integers(0, 4, 300), rng.uniform(size=300)])
    y = np.where(x[:, 0] > 0.2, 1.0, -0.5) + 0.4 * x[:, 1] + rng.normal(0, 0.1, 300)
    frame = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "y"])).repartition(4)
    model = boosted.fit(frame, ["a", "b", "c"], "y", rounds=1, depth=2, step=1.0, row_share=1.0, column_share=1.0, l1=0.3, l2=2.0, bins=16)
    tree, bins = model.trees[0], model.bins(x)
    g = y.mean() - y
    gain, feature, cut = brute_split(bins, g, 0.3, 2.0)
    assert (tree.feature[0], tree.cut[0]) == (feature, cut)
    for side, node in ((bins[:, feature] <= cut, tree.low[0]), (bins[:, feature] > cut, tree.high[0])):
        assert (tree.feature[node], tree.cut[node]) == brute_split(bins[side], g[side], 0.3, 2.0)[1:]
        for part, at in ((bins[:, tree.feature[node]] <= tree.cut[node], tree.low[node]), (bins[:, tree.feature[node]] > tree.cut[node], tree.high[node])):
            own = g[side & part]
            assert tree.value[at] == pytest.approx(-np.sign(own.sum()) * max(abs(own.sum()) - 0.3, 0) / (len(own) + 2.0))


def test_boosting_learns_and_scores_alike(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 4))
    x[::17, 2] = np.nan
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0) * 0.7 + rng.normal(0, 0.05, 600)
    frame = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "d", "y"])).repartition(3)
    model = boosted.fit(frame, ["a", "b", "c", "d"], "y", rounds=23, depth=3, step=0.3)
    assert len(model.trees) == 23
    scored = boosted.score(model, frame, "p").toPandas()
    assert np.allclose(scored["p"], model.predict(scored[["a", "b", "c", "d"]].to_numpy(float)))
    assert np.mean((scored["p"] - scored["y"]) ** 2) < 0.15 * np.var(y)
