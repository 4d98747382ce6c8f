"""Linear models from sums of products that are kept per piece of time.

The rows are read once: each piece of time (between the ends of two training spans) leaves the sums of products of its features and label. Prefix sums over the
pieces give every training span's normal equations, so no span is read again however many windows there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.functions import columns as X
from slotline.operators import evaluate as ev
from slotline.session import stage


def products(rows: DataFrame, features: Sequence[str], label: str, piece: Column, pieces: int) -> np.ndarray:
    """Sums of products of (1, features, label) per piece: an array [piece, i, j]. Rows with a null or NaN among these are left out.

    Each task leaves one row per piece; their entries are added up by place, so no task or driver holds more than a fixed number of matrices.
    """
    names = [*features, label]
    width = len(names) + 1

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((pieces, width, width))
        for frame in frames:
            x = np.column_stack([np.ones(len(frame)), frame[names].to_numpy(float)])
            at = frame["_piece"].to_numpy(int)
            whole = ~np.isnan(x).any(axis=1)
            for p in np.unique(at[whole]):
                part = x[whole & (at == p)]
                total[p] += part.T @ part
        yield pd.DataFrame({"_piece": np.arange(pieces), "_sums": [t.ravel() for t in total]})

    narrow = rows.select(piece.cast("int").alias("_piece"), *[F.col(c).cast("double").alias(c) for c in names]).where(F.col("_piece") < pieces)
    parts = narrow.mapInPandas(one, "_piece int, _sums array<double>").select("_piece", F.posexplode("_sums").alias("_at", "_v"))
    out = np.zeros((pieces, width * width))
    for r in parts.groupBy("_piece", "_at").agg(F.sum("_v").alias("v")).collect():  # pieces x width x width numbers
        out[r["_piece"], r["_at"]] = r["v"]
    return out.reshape(pieces, width, width)


def solve(total: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Intercept and weights of the least squares fit behind summed products; ``ridge`` holds the weights back, not the intercept."""
    left, right = total[:-1, :-1].copy(), total[:-1, -1]
    left[np.arange(1, len(left)), np.arange(1, len(left))] += ridge
    return np.linalg.lstsq(left, right, rcond=None)[0]


def rolling_linear(
    table: DataFrame, features: Sequence[str], label: str = "target_utilization_1h", time: str = "target_time_slot", ridge: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """Rolling-origin backtest of a linear model: metrics per window, and the fitted weights."""
    rows = stage(table.select(time, label, *features), "rows")
    plan = ev.backtest_plan(rows, time).orderBy("window").collect()  # at most one row per window
    spans = ["window", "train_end_time", "test_start_time", "test_end_time"]
    ends = [F.lit(w["train_end_time"]) for w in plan]
    piece = reduce(lambda a, end: a + (F.col(time) > end).cast("int"), ends, F.lit(0))
    upto = np.cumsum(products(rows, features, label, piece, len(plan)), axis=0) if plan else []
    tested, fits = None, []
    for w, total in zip(plan, upto):
        fit = solve(total, ridge)
        fits.append((w["window"], [float(v) for v in fit]))
        told = reduce(lambda a, p: a + F.lit(float(p[1])) * F.col(p[0]), zip(features, fit[1:]), F.lit(float(fit[0])))
        part = rows.where(F.col(time).between(F.lit(w["test_start_time"]), F.lit(w["test_end_time"]))).select(
            *[F.lit(w[c]).alias(c) for c in spans], F.col(label), X.clip(told).alias("_told")
        )
        tested = part if tested is None else tested.unionByName(part)
    weights = table.sparkSession.createDataFrame(fits, "window int, weights array<double>")
    if tested is None:
        return ev.backtest_plan(rows, time).limit(0), weights
    return ev.metrics_table(tested, label, "_told", spans).withColumn("model", F.lit("Rolling Linear")), weights
