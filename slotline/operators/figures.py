"""Headline figures of a board kept by differences: an upsert retracts the old rows of its keys and adds the new ones.

Counts and sums live in a small table by risk band and availability; sums are decimals, so that retracting gives back exactly what was added.
The leading rows are found through rank indexes (``ranks``), which say which bucket of scores to read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.functions import columns as X
from slotline.operators import ranks

MONEY = "decimal(38,12)"
LEADERS = {"best_option": "balanced_score", "most_congested": "predicted_utilization_1h"}


def _bucket(score: str) -> str:
    return f"{score}_bucket"


def with_buckets(board: DataFrame) -> DataFrame:
    for score in LEADERS.values():
        board = ranks.with_bucket(board, score, _bucket(score))
    return board


def cells(board: DataFrame, sign: int = 1) -> DataFrame:
    """(kind, band, low, bucket, n, total): counts and sums by band and availability, and counts by score bucket."""
    low = F.coalesce(X.low_availability(), F.lit(False))
    none = F.lit(None)
    known = F.col("predicted_utilization_1h").cast(MONEY)
    parts = board.groupBy(F.col("risk_band").alias("band"), low.alias("low")).agg(
        (F.lit(sign) * F.count(F.lit(1))).alias("n"), (F.lit(sign) * F.count("predicted_utilization_1h")).alias("known"),
        (F.lit(sign) * F.coalesce(F.sum(known), F.lit(0))).cast(MONEY).alias("total"),
    )
    out = parts.select(F.lit("band").alias("kind"), "band", "low", none.cast("long").alias("bucket"), "n", "known", "total")
    for name, score in LEADERS.items():
        counted = ranks.build_index(board, _bucket(score))
        out = out.unionByName(
            counted.select(
                F.lit(name).alias("kind"), none.cast("string").alias("band"), none.cast("boolean").alias("low"), F.col(_bucket(score)).alias("bucket"),
                (F.lit(sign) * F.col("n")).alias("n"), F.lit(0).cast("long").alias("known"), F.lit(0).cast(MONEY).alias("total"),
            )
        )
    return out


def folded(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("kind", "band", "low", "bucket").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("total").cast(MONEY).alias("total"))
    return sums.where(F.col("n") != 0)


def after_changes(figures: DataFrame | None, before: DataFrame, after: DataFrame) -> DataFrame:
    """Figures once the rows ``before`` are gone and the rows ``after`` are there; only these are counted."""
    change = cells(before, -1).unionByName(cells(after))
    return folded(change if figures is None else figures.unionByName(change))


def snapshot(figures: DataFrame, board: DataFrame, key: str = "system_code") -> DataFrame:
    """The board's headline figures (as ``profile.board_snapshot``); of the board only the leading buckets are read."""
    bands = figures.where(F.col("kind") == "band")
    critical, high = F.col("band") == "Critical", F.col("band").isin("Critical", "High")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    out = bands.agg(
        count(F.lit(True)).alias("systems"),
        F.coalesce(F.try_divide(F.sum("total").cast("double"), F.sum("known")), F.lit(0.0)).alias("mean_utilization"),
        count(critical).alias("critical_systems"),
        count(high).alias("high_risk_systems"),
        count(F.col("low")).alias("low_availability_systems"),
    )
    for name, score in LEADERS.items():
        top = figures.where(F.col("kind") == name).agg(F.max("bucket")).scalar()
        first = board.where(F.col(_bucket(score)) == top).agg(F.min_by(key, F.struct(-F.col(score), F.col(key)))).scalar()
        out = out.withColumn(name, first)
    return out
