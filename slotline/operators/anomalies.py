"""Isolation-forest scores: trees from bounded samples, scoring as a map over all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators.order import exact_quantiles
from slotline.session import stage

SPARE = 4  # expected rows below a sample's bound, as a multiple of the sample
TREE_SCHEMA = "tree int, node int, feature int, cut double, low int, high int, depth double, size int"


def mean_path(n) -> np.ndarray:
    """Average depth of an unsuccessful search among n points (isolation-forest normalisation)."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def _grow(features: list[str], seed: int, sample: int):
    """Build one isolation tree from one sample (a few hundred rows)."""
    path = mean_path(np.arange(sample + 1))

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["_tree"].iloc[0])
        data = sample.sort_values("_h")[features].to_numpy(float)
        rng = np.random.default_rng([seed, tree])
        deepest = int(np.ceil(np.log2(max(len(data), 2))))
        nodes, todo = [], [(0, np.arange(len(data)), 0)]
        made = 1
        while todo:
            node, idx, depth = todo.pop()
            part = data[idx]
            spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(idx) > 1 else []
            if depth >= deepest or len(spread) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, depth + float(path[len(idx)]), len(idx)))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            below = part[:, f] <= cut
            if below.all():
                below = part[:, f] < part[:, f].max()
            nodes.append((tree, node, f, cut, made, made + 1, 0.0, len(idx)))
            todo += [(made, idx[below], depth + 1), (made + 1, idx[~below], depth + 1)]
            made += 2
        return pd.DataFrame(
            nodes, columns=["tree", "node", "feature", "cut", "low", "high", "depth", "size"]
        )

    return run


def isolation_trees(
    df: DataFrame,
    features: Sequence[str],
    identity: Sequence[str],
    trees: int = fixed.ANOMALY_TREES,
    sample: int = fixed.ANOMALY_SAMPLE,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Tree nodes. Every tree has its own sample: the ``sample`` rows with the smallest hash of the tree and their identity."""
    drawn = tree_samples(df.select(*features, *[c for c in identity if c not in features]), identity, trees, sample, seed)
    return drawn.groupBy("_tree").applyInPandas(_grow(list(features), seed, sample), TREE_SCHEMA)


def tree_samples(df: DataFrame, identity: Sequence[str], trees: int, sample: int, seed: int = fixed.SEED) -> DataFrame:
    """Rows of each tree's sample with ``_tree`` and ``_h``: bottom-``sample`` by hash, exactly, for all trees in one pass.

    Each row works out its hash for all trees and goes only to those where it lies below a bound that ``SPARE`` times the wanted rows are expected to
    meet. Should a tree get too few, the bound is raised and the pass repeated; any bound that is met by enough rows gives the same sample.
    """
    n = df.count()
    hashed = lambda t: F.xxhash64(F.lit(seed), t, *[F.col(c).cast("string") for c in identity])
    share = min(1.0, SPARE * sample / max(n, 1))
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    while True:
        bound = min((1 << 63) - 1, -(1 << 63) + int(share * ((1 << 64) - 1)))
        hits = F.filter(F.transform(every, lambda t: F.struct(t.alias("tree"), hashed(t).alias("h"))), lambda x: x["h"] <= F.lit(bound))
        near = stage(df.withColumn("_hit", F.explode(hits)).select(*df.columns, F.col("_hit.tree").alias("_tree"), F.col("_hit.h").alias("_h")), "near")
        short = near.groupBy("_tree").count().agg(F.count(F.lit(1)).alias("trees"), F.min("count").alias("least")).first()
        if share >= 1.0 or (short["trees"] == trees and short["least"] >= min(sample, n)):
            break
        share = min(1.0, 4 * share)
    order = Window.partitionBy("_tree").orderBy("_h", *df.columns)
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).drop("_n")


def _forest_arrays(nodes: list) -> tuple:
    """Rectangular node arrays [tree, node]."""
    trees = 1 + max(r["tree"] for r in nodes)
    width = 1 + max(r["node"] for r in nodes)
    feature = np.full((trees, width), -1)
    low, high = np.zeros((trees, width), int), np.zeros((trees, width), int)
    cut, depth = np.zeros((trees, width)), np.zeros((trees, width))
    for r in nodes:
        at = (r["tree"], r["node"])
        feature[at], cut[at], low[at], high[at], depth[at] = r["feature"], r["cut"], r["low"], r["high"], r["depth"]
    return feature, cut, low, high, depth


def isolation_scores(
    df: DataFrame,
    features: Sequence[str],
    identity: Sequence[str],
    trees: int = fixed.ANOMALY_TREES,
    sample: int = fixed.ANOMALY_SAMPLE,
    seed: int = fixed.SEED,
    output: str = "anomaly_score",
) -> DataFrame:
    """Anomaly score in (0, 1] for every row, higher is more isolated.

    The forest has at most ``trees * (2 * sample - 1)`` nodes whatever the data size; it is fetched
    once and broadcast. Scoring is a vectorised column function without a shuffle.
    """
    names = list(features)
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names})
    inputs = [f"_f_{c}" for c in names]
    nodes = isolation_trees(filled.select(*inputs, *identity), inputs, identity, trees, sample, seed).collect()
    if not nodes:
        return df.withColumn(output, F.lit(None).cast("double"))
    shared = df.sparkSession.sparkContext.broadcast(_forest_arrays(nodes))
    drawn = float(mean_path(max(r["size"] for r in nodes if r["node"] == 0)))

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        feature, cut, low, high, depth = shared.value
        for columns in parts:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for t in range(len(feature)):
                at = np.zeros(len(x), int)
                while True:
                    f = feature[t, at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    v = x[rows, np.where(inner, f, 0)]
                    step = np.where(v <= cut[t, at], low[t, at], high[t, at])
                    at = np.where(inner, step, at)
                total += depth[t, at]
            yield pd.Series(np.power(2.0, -(total / len(feature)) / max(drawn, 1e-12)))

    return filled.withColumn(output, scored(*[F.col(c) for c in inputs])).drop(*inputs)


def flag_above_quantile(
    df: DataFrame, score: str, share: float = fixed.ANOMALY_SHARE, output: str = "anomaly_flag"
) -> DataFrame:
    """1 where the score lies strictly above the exact (1 - share) quantile."""
    cut = exact_quantiles(df, score, [1.0 - share], few_groups=True).select(F.col("quantiles")[0]).scalar()
    return df.withColumn(output, (F.col(score) > cut).cast("int"))


def detect_anomalies(
    df: DataFrame,
    identity: Sequence[str] = ("system_code", "time_slot"),
    features: Sequence[str] = tuple(fixed.ANOMALY_FEATURES),
    reason: Column | None = None,
    **settings,
) -> DataFrame:
    """Flagged rows with score and reason, most anomalous first.

    Scores are worked out once and written with their rows: the quantile reads them several times.
    """
    scored = stage(isolation_scores(df, features, identity, **settings), "scores")
    return (
        flag_above_quantile(scored, "anomaly_score")
        .where(F.col("anomaly_flag") == 1)
        .withColumn("anomaly_reason", X.anomaly_reason() if reason is None else reason)
        .orderBy(F.desc("anomaly_score"), *identity)
    )
