"""Distributed order, as-of, neighbour and rate operators against brute force."""

import random
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotline.operators import activity, drift, order, spatial
from slotline.operators import evaluate as ev
from slotline.operators.asof import asof_join

START = datetime(2024, 1, 1)


# --- quantiles and ranks ----------------------------------------------------


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_equal_numpy(spark, few):
    rng = np.random.default_rng(1)
    data = {
        "flat": np.full(500, 0.25),  # one value owns the group
        "mixed": np.concatenate([np.full(300, 7.0), rng.normal(0, 100, 601)]),
        "tiny": rng.uniform(0, 1e-4, 50),
        "one": np.array([-3.0]),
    }
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("flat", None), ("mixed", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.97, 1.0]
    got = {r.g: r.quantiles for r in order.exact_quantiles(df, "v", probs, ["g"], few_groups=few).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        assert np.allclose(got[g], np.quantile(vs, probs), rtol=1e-12, atol=1e-15)


def test_positions_and_dense_rank(spark):
    rng = random.Random(2)
    values = [rng.choice([0.5, -2.0, 3.25, 100.0, 0.5001]) for _ in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    placed = {r.v: r for r in order.value_positions(df, "v").collect()}
    for i, v in enumerate(sorted(set(values)), start=1):
        assert placed[v].position == i and placed[v].before == sum(x < v for x in values)
        assert placed[v].n == values.count(v) and placed[v].total_rows == 400
    ranked = order.dense_rank(df, "v", "rank").toPandas().sort_values("id")
    want = pd.Series(values).rank(method="dense", ascending=False).astype(int)
    assert ranked["rank"].tolist() == want.tolist()


def test_order_preserving_bucket(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 300), rng.normal(0, 1e6, 300), [0.0, 1e300, -1e300]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").withColumn("b", order.number_bucket("v"))
    buckets = [r.b for r in df.orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_order_bits_are_those_of_the_number(spark):
    import struct

    rng = np.random.default_rng(4)
    v = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), -float("inf")]
    v += [float(np.nextafter(2.0**k, d)) for k in range(-1070, 1024, 7) for d in (0, np.inf)] + [2.0**k for k in range(-1074, 1024)]
    v += [float(x) for x in rng.integers(0, 0x7FF0 << 48, 3000).view(np.float64)] + [-float(x) for x in rng.lognormal(0, 50, 500)]
    df = spark.createDataFrame([(x,) for x in v], "v double").withColumn("b", order.order_bits("v"))
    for r in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.b == (-bits if r.v < 0 else bits), r.v


@pytest.mark.parametrize("few", [True, False])
def test_full_buckets_are_split(spark, few, monkeypatch):
    """Values closer together than the first buckets: quantiles, positions and ranks stay exact and no window gets large."""
    monkeypatch.setattr(order, "FULL", 40)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.uniform(1000.0, 1000.0 + 1e-9, 700), rng.uniform(0, 1e-3, 700), np.full(500, 7.5), -rng.uniform(1000.0, 1000.001, 300)])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
    probs = [0.0, 0.05, 0.1, 0.33, 0.5, 0.75, 0.9, 1.0]
    assert np.allclose(order.exact_quantiles(df, "v", probs, few_groups=few).first().quantiles, np.quantile(v, probs), rtol=1e-15, atol=0)
    distinct = np.unique(v)
    counted = order.split_buckets(df.groupBy("v").count(), "v")
    assert counted.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= 40
    placed = {r.v: r.position for r in order.value_positions(df, "v").collect()}
    assert placed == {x: i + 1 for i, x in enumerate(distinct.tolist())}


# --- splits -----------------------------------------------------------------


def times(spark, n):
    return spark.createDataFrame(
        [(START + timedelta(minutes=30 * i),) for i in range(n) for _ in range(1 + i % 2)], "t timestamp"
    )


@pytest.mark.parametrize("n,windows", [(170, 0), (171, 0), (221, 1), (461, 3)])
def test_backtest_plan_sizes(spark, n, windows):
    plan = ev.backtest_plan(times(spark, n), "t").orderBy("window").collect()
    assert [r.window for r in plan] == list(range(1, windows + 1))
    if plan:
        assert plan[-1].test_end_time == START + timedelta(minutes=30 * (n - 1))
        assert plan[-1].test_start_time - plan[-1].train_end_time == timedelta(minutes=30)


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_split_positions(spark, n):
    cut = ev.split_time(times(spark, n), "t").first().split_time
    assert cut == START + timedelta(minutes=30 * (max(1, int(n * 0.8)) - 1))
    tail = ev.calibration_start(times(spark, n), "t").first().calibration_start
    assert tail == START + timedelta(minutes=30 * (n - max(1, int(n * 0.15))))


# --- as-of ------------------------------------------------------------------


def test_asof_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(4)
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}"
    at = lambda: START + timedelta(minutes=rng.randrange(0, 60 * 24 * 6, 7))
    left = [(i, key(), at()) for i in range(400)] + [(900, "hot", None), (901, None, at()), (902, "none", at())]
    right = [(i, key(), at(), None if i % 9 == 0 else float(i)) for i in range(300)] + [(901, "hot", None, 1.0)]
    # Several right rows at one instant, and one equal to a left instant.
    right += [(500 + i, "hot", left[0][2], float(i)) for i in range(3)]
    ldf = spark.createDataFrame(left, "id int, k string, t timestamp")
    rdf = spark.createDataFrame(right, "rid int, k string, at timestamp, v double")
    got = {
        r.id: (r.found, r.value)
        for r in asof_join(ldf, rdf, ["k"], "t", "at", {"rid": "found", "v": "value"}, "rid", 6 * 3600).collect()
    }
    assert len(got) == len(left)
    for i, k, t in left:
        fits = [r for r in right if k and t and r[1] == k and r[2] and r[2] <= t]
        best = max(fits, key=lambda r: (r[2], r[0])) if fits else None
        assert got[i] == ((best[0], best[3]) if best else (None, None)), (i, k, t)


# --- neighbours -------------------------------------------------------------


def brute_neighbours(sites, k):
    out = {}
    for s, x, y in sites:
        near = sorted((np.hypot(a - x, b - y), o) for o, a, b in sites if o != s)[:k]
        inverse = [1 / max(d, 1e-6) for d, _ in near]
        for (dist, o), w in zip(near, inverse):
            out[(s, o)] = (dist, w / sum(inverse))
    return out


def layouts():
    rng = np.random.default_rng(5)
    spread = [(f"s{i:03d}", *map(float, rng.uniform(0, 1, 2))) for i in range(60)]
    dense = [(f"d{i:03d}", *map(float, 0.5 + rng.normal(0, 1e-4, 2))) for i in range(60)]
    far = [("far1", 50.0, 50.0), ("far2", -80.0, 3.0)]
    piled = [(f"p{i:02d}", 0.25, 0.25) for i in range(12)]
    line = [(f"l{i}", float(i), 0.0) for i in range(9)]
    return {
        "spread": spread, "dense and far": dense + far, "piled": piled + spread[:5], "line": line,
        "few": spread[:3], "two": spread[:2], "same place": piled,
    }


@pytest.mark.parametrize("name", list(layouts()))
def test_knn_equals_brute_force(spark, name):
    sites = layouts()[name]
    df = spark.createDataFrame(sites, "system_code string, latitude double, longitude double")
    got = {(r.system_code, r.neighbor_code): (r.distance, r.weight) for r in spatial.knn_graph(df).collect()}
    want = brute_neighbours(sites, 3)
    assert set(got) == set(want)
    for edge, pair in want.items():
        assert np.allclose(got[edge], pair, atol=1e-9)


def test_jittered_duplicates_are_one_site(spark):
    rows = [("a", 1.0, 1.0), ("a", 1.0 + 1e-9, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "system_code string, latitude double, longitude double")
    edges = spatial.knn_graph(spatial.canonical_sites(df)).toPandas()
    assert len(edges) == 6
    assert np.allclose(edges.groupby("system_code")["weight"].sum(), 1.0)


# --- requests ---------------------------------------------------------------


def limiter(rows, limit, seconds):
    state, out = {}, {}
    for rid, client, at in sorted(rows, key=lambda r: (r[2], r[0])):
        queue = state.setdefault(client, deque())
        while queue and (at - queue[0]).total_seconds() >= seconds:
            queue.popleft()
        if len(queue) >= limit:
            left = seconds - (at - queue[0]).total_seconds()
            out[rid] = (False, 0, max(1, int(left)))
        else:
            queue.append(at)
            out[rid] = (True, limit - len(queue), 0)
    return out


def test_rate_admission_equals_replay(spark):
    rng = random.Random(6)
    rows, rid = [], 0
    for client, gap in (("busy", 3), ("calm", 45), ("bursty", 1)):
        at = START
        for i in range(250):
            step = 0 if rng.random() < 0.15 else rng.randrange(1, 2 * gap)
            at += timedelta(seconds=step + (90 if client == "bursty" and i % 50 == 0 else 0))
            rows.append((rid, client, at))
            rid += 1
    rows += [(9000 + i, "edge", START + timedelta(hours=1, seconds=s)) for i, s in enumerate([-60, 0, 59, 60, 120])]
    df = spark.createDataFrame(rows, "request_id int, client_host string, created_at timestamp")
    got = {
        r.request_id: (r.allowed, r.remaining, r.retry_after)
        for r in activity.rate_admission(df, limit=4, window_seconds=60).collect()
    }
    assert got == limiter(rows, 4, 60)


# --- drift ------------------------------------------------------------------


def pandas_psi(a, b, bins=10):
    edges = np.unique(np.quantile(a, np.linspace(0, 1, bins + 1)))
    if len(edges) < 3:
        return 0.0
    share = lambda v: pd.cut(pd.Series(v), edges, include_lowest=True).value_counts(normalize=True, sort=False)
    r, c = share(a).clip(lower=1e-6), share(b).clip(lower=1e-6)
    return float(((c - r) * np.log(c / r)).sum())


def test_psi_cases(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(0, 1, 800), np.concatenate([rng.normal(0.4, 1.2, 300), [99.0, -99.0]])
    steps_a, steps_b = rng.integers(0, 4, 800).astype(float), rng.integers(0, 6, 302).astype(float)
    frame = [(True, x, 1.0, float(s), float(x)) for x, s in zip(map(float, a), steps_a)]
    frame += [(False, x, 2.0, float(s), None) for x, s in zip(map(float, b), steps_b)]
    df = spark.createDataFrame(frame, "ref boolean, v double, constant double, steps double, one_sided double")
    got = {
        r.feature: r for r in drift.drift_scores(df, ["v", "constant", "steps", "one_sided"], F.col("ref")).collect()
    }
    assert abs(got["v"].psi - pandas_psi(a, b)) < 1e-9
    assert abs(got["steps"].psi - pandas_psi(steps_a, steps_b)) < 1e-9
    assert got["constant"].psi == 0 and got["one_sided"].psi == 0
    assert got["v"].reference_rows == 800 and got["v"].recent_rows == 302
    assert abs(got["v"].recent_mean - b.mean()) < 1e-9
    same = df.where("ref").unionByName(df.where("ref").withColumn("ref", F.lit(False)))
    assert abs(drift.drift_scores(same, ["v"], F.col("ref")).first().psi) < 1e-12
