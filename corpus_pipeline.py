"""The corpus pipeline: quality, line dedup, near-duplicates, mixing and packing, each stage over what the one before kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from slotline.llm import lines, mixing, ngram_join, packing, quality
from slotline.llm.common import table
from slotline.session import bound_batches, scratch_path

#: One set of executors serves all stages, and what a batch took of their memory is seldom given back; so batches are smaller than those of one operator alone.
BATCH_BYTES = 4 << 20


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.without_repeats(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs)


def _in_small_batches(stage):
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", _in_small_batches(good_documents)),
    ("line dedup", _in_small_batches(distinct_lines)),
    ("n-gram Jaccard join", _in_small_batches(distinct_documents)),
    ("mixing sources to target weights", _in_small_batches(mixed_documents)),
    ("best-fit packing", _in_small_batches(packed_sequences)),
]

#: No SQL: a trained classifier decides what the later stages see. Each stage is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of what the stages keep of ``documents``.

    Null, empty and blank texts have no lines and no words: they pass the line and near-duplicate stages untouched, are sized 0 in the mix, and
    become one piece with the end id, unless the classifier rejects them. Repeated rows are one row from the near-duplicate stage on, except those without words;
    the mix may take a row twice. Null ids and sources are values like others. Without documents there are no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
