"""Second-order boosted trees on histograms, with L1 and L2 penalties in leaves and gains.

Numbers are cut once into bins at their quantiles. Each level of a tree is one pass: every task sums gradients and row weights by (node, feature, bin), the
sums are combined, and a running sum over the bins of each (node, feature) gives the gain of every cut. Only the best cut of each node comes to the
driver. Rows keep their prediction of the trees up to the last written table and work out the few trees since then on the way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline import fixed
from slotline.operators.order import exact_quantiles
from slotline.session import stage

BINS = 64
WRITTEN = 10  # rounds between tables with written predictions


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1. Rows with a bin up to ``cut`` go low."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    low: list[int] = field(default_factory=lambda: [0])
    high: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for column, first in ((self.feature, -1), (self.cut, 0), (self.low, 0), (self.high, 0), (self.value, 0.0)):
            column.append(first)
        return len(self.value) - 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, low, high = (np.array(x) for x in (self.feature, self.cut, self.low, self.high))
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            step = np.where(bins[rows, np.where(inner, f, 0)] <= cut[at], low[at], high[at])
            at = np.where(inner, step, at)

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosted:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]

    def bins(self, values: np.ndarray) -> np.ndarray:
        return _binned(values, self.edges)

    def predict(self, values: np.ndarray) -> np.ndarray:
        bins = self.bins(values)
        return self.base + sum((t.values(bins) for t in self.trees), np.zeros(len(bins)))


def _binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of edges below each value; unknown values are in the first bin."""
    return np.column_stack([np.searchsorted(e, np.nan_to_num(values[:, j], nan=-np.inf), side="left") for j, e in enumerate(edges)]).astype(np.uint8)


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct inner quantiles of every feature; ``bins`` - 1 at most."""
    long = rows.select([F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "feature", "value")
    found = exact_quantiles(long, "value", [i / bins for i in range(1, bins)], ["feature"], few_groups=True)
    known = {r["feature"]: np.unique(r["quantiles"]) for r in found.collect()}  # one row per feature
    return [known.get(c, np.zeros(0)) for c in features]


def _shrunk(total: Column, l1: float) -> Column:
    return F.signum(total) * F.greatest(F.abs(total) - l1, F.lit(0.0))


def best_cuts(sums: DataFrame, l1: float, l2: float, least_weight: float) -> DataFrame:
    """Per node the cut with the greatest gain from sums (node, feature, bin, g, h): feature, bin, gain, and the sums below it and in all.

    Ties go to the smaller feature, then the smaller bin. A node whose best gain is not positive still has a row.
    """
    part = Window.partitionBy("node", "feature")
    below = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.select(
        "node", "feature", "bin", F.sum("g").over(below).alias("gl"), F.sum("h").over(below).alias("hl"), F.sum("g").over(part).alias("gt"), F.sum("h").over(part).alias("ht")
    )
    worth = lambda g, h: _shrunk(g, l1) * _shrunk(g, l1) / (h + F.lit(l2))
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    allowed = (F.col("hl") >= least_weight) & (hr >= least_weight)
    gain = F.when(allowed, worth(F.col("gl"), F.col("hl")) + worth(gr, hr) - worth(F.col("gt"), F.col("ht"))).otherwise(F.lit(-1.0))
    row = F.struct("feature", "bin", "gain", "gl", "hl", "gt", "ht")
    return run.withColumn("gain", gain).groupBy("node").agg(F.min_by(row, F.struct(-F.col("gain"), F.col("feature"), F.col("bin"))).alias("b")).select("node", "b.*")


def fit(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    rounds: int = fixed.BOOST_SETTINGS["rounds"],
    depth: int = fixed.BOOST_SETTINGS["depth"],
    step: float = fixed.BOOST_SETTINGS["step"],
    row_share: float = fixed.BOOST_SETTINGS["row_share"],
    column_share: float = float(fixed.BOOST_SETTINGS["column_share"]),
    l1: float = fixed.BOOST_PENALTIES["l1"],
    l2: float = fixed.BOOST_PENALTIES["l2"],
    least_weight: float = fixed.BOOST_PENALTIES["least_weight"],
    bins: int = BINS,
    seed: int = fixed.SEED,
) -> Boosted:
    """Boosted regression trees for squared errors. Rows without a label are left out; unknown features count as smallest.

    A tree sees the rows whose hash of (row, round) lies below ``row_share``, whatever their partition, and a drawn share of the columns.
    """
    names = list(features)
    known = rows.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))
    edges = bin_edges(known, names, bins)

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = _binned(frame[names].to_numpy(float), edges)
            yield pd.DataFrame({"y": frame["_y"], "own": frame["_own"], "bins": [r.tobytes() for r in told], "pred": 0.0})

    own = F.xxhash64(*[F.col(c).cast("double") for c in names], F.col(label).cast("double"), F.monotonically_increasing_id())
    narrow = known.select(F.col(label).cast("double").alias("_y"), own.alias("_own"), *[F.col(c).cast("double").alias(c) for c in names])
    table = stage(narrow.mapInPandas(cut_up, "y double, own long, bins binary, pred double"), "binned")
    base = table.agg(F.avg("y")).first()[0]
    if base is None:
        raise ValueError("no labelled rows")
    rng = np.random.default_rng(seed)
    trees: list[Tree] = []
    fresh: list[Tree] = []  # since the table was written

    def matrix(frame: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(frame["bins"]), np.uint8).reshape(len(frame), len(names))

    def sums_of(tree: Tree, since: list[Tree], open_: list[int], columns: list[int], turn: int) -> DataFrame:
        place = np.full(len(tree.value), -1)
        place[open_] = np.arange(len(open_))

        def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shape = (len(open_), len(columns), bins)
            g, h = np.zeros(math.prod(shape)), np.zeros(math.prod(shape))
            for frame in frames:
                x = matrix(frame)
                drawn = (frame["own"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
                at = place[tree.nodes(x)]
                use = (at >= 0) & ((drawn >> np.uint64(40)) < np.uint64(int(row_share * (1 << 24))))
                x, at = x[use], at[use]
                error = frame["pred"].to_numpy(float)[use] + base + sum((t.values(x) for t in since), np.zeros(len(x))) - frame["y"].to_numpy(float)[use]
                for j, c in enumerate(columns):
                    cell = (at * len(columns) + j) * bins + x[:, c]
                    g += np.bincount(cell, error, len(g))
                    h += np.bincount(cell, minlength=len(h))
            full = np.flatnonzero(h)
            node, rest = np.divmod(full, len(columns) * bins)
            yield pd.DataFrame({"node": np.array(open_)[node], "feature": np.array(columns)[rest // bins], "bin": rest % bins, "g": g[full], "h": h[full]})

        parts = table.mapInPandas(one, "node int, feature int, bin int, g double, h double")
        return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))

    def leaf(g: float, h: float) -> float:
        return -step * math.copysign(max(abs(g) - l1, 0.0), g) / (h + l2)

    for turn in range(rounds):
        columns = sorted(rng.choice(len(names), max(1, round(column_share * len(names))), replace=False).tolist())
        tree, open_ = Tree(), [0]
        for _ in range(depth):
            split = []
            for r in best_cuts(sums_of(tree, list(fresh), open_, columns, turn), l1, l2, least_weight).collect():  # one row per open node
                node = r["node"]
                if r["gain"] <= 0:
                    tree.value[node] = leaf(r["gt"], r["ht"])
                    continue
                tree.feature[node], tree.cut[node] = r["feature"], r["bin"]
                tree.low[node], tree.high[node] = tree.add(), tree.add()
                tree.value[tree.low[node]] = leaf(r["gl"], r["hl"])
                tree.value[tree.high[node]] = leaf(r["gt"] - r["gl"], r["ht"] - r["hl"])
                split += [tree.low[node], tree.high[node]]
            open_ = split
            if not open_:
                break
        trees.append(tree)
        fresh.append(tree)
        if len(fresh) == WRITTEN and turn + 1 < rounds:
            since = list(fresh)

            def moved(frames: Iterator[pd.DataFrame], since: list[Tree] = since) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    x = matrix(frame)
                    yield frame.assign(pred=frame["pred"] + sum((t.values(x) for t in since), np.zeros(len(x))))

            table = stage(table.mapInPandas(moved, table.schema), "boosted")
            fresh.clear()
    return Boosted(names, edges, float(base), trees)


def score(model: Boosted, rows: DataFrame, output: str) -> DataFrame:
    """``rows`` with the model's prediction; a vectorised column function without a shuffle."""

    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.column_stack([c.to_numpy(float) for c in columns])))

    return rows.withColumn(output, scored(*[F.col(c).cast("double") for c in model.features]))
