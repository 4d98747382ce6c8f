"""A rank index beside a board: rows counted per score bucket, kept by the differences of each upsert.

The rank of one key is the counts of the buckets above its own plus the rows ahead of it inside that bucket, so a board is neither sorted nor scanned for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.operators.order import SHIFTS, number_bucket


def with_bucket(board: DataFrame, score: str = "balanced_score", bucket: str = "score_bucket") -> DataFrame:
    """The board with the bucket of its score; null scores have none."""
    return board.withColumn(bucket, F.when(~F.isnan(score), number_bucket(score, SHIFTS[0])))


def build_index(board: DataFrame, bucket: str = "score_bucket") -> DataFrame:
    """(bucket, n): rows of a bucketed board per bucket."""
    return board.where(F.col(bucket).isNotNull()).groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))


def index_after(index: DataFrame, before: DataFrame, after: DataFrame, bucket: str = "score_bucket") -> DataFrame:
    """The index once the rows ``before`` (old rows of the changed keys) are retracted and the rows ``after`` added.

    Only the changed rows are counted; the index itself has a bounded number of rows, whatever the board.
    """
    count = lambda rows, sign: build_index(rows, bucket).select(bucket, (F.lit(sign) * F.col("n")).alias("n"))
    both = index.unionByName(count(before, -1)).unionByName(count(after, 1))
    return both.groupBy(bucket).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def rank_from_index(
    board: DataFrame, index: DataFrame, row_key: Column, score: str = "balanced_score", key: str = "system_code", bucket: str = "score_bucket"
) -> DataFrame:
    """Position of one key, best score first and equal scores by key; one row, null if the key has no score."""
    mine = board.where(F.col(key) == row_key).agg(F.max(score).alias("s"), F.max(bucket).alias("b"))
    own_score, own_bucket = mine.select("s").scalar(), mine.select("b").scalar()
    above = F.coalesce(index.agg(F.sum(F.when(F.col(bucket) > own_bucket, F.col("n")))).scalar(), F.lit(0))
    ahead = (F.col(score) > own_score) | ((F.col(score) == own_score) & (F.col(key) < row_key))
    # The board is kept with its buckets, so that only files that may hold this bucket are read.
    beside = board.where(F.col(bucket) == own_bucket).agg(F.count_if(ahead)).scalar()
    return mine.select(F.when(F.col("s").isNotNull(), above + beside + 1).cast("long").alias("recommendation_rank"))
