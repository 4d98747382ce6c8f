"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotline.llm import (
    fill_middle, fingerprints, lines, mixing, neighbours, ngram_join, packing, page_text, personal, quality, secrets, sharding, turns,
)
from slotline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secrets(spark, folder):
    return secrets.report(table(spark, folder, "documents"))


@query
def op2_personal(spark, folder):
    return personal.report(table(spark, folder, "documents"))


@query
def op3_sharding(spark, folder):
    return sharding.report(table(spark, folder, "documents"))


@query
def op4_fingerprints(spark, folder):
    return fingerprints.report(table(spark, folder, "documents"))


@query
def op5_lines(spark, folder):
    return lines.report(table(spark, folder, "documents"))


@query
def op6_packing(spark, folder):
    return packing.report(table(spark, folder, "documents"))


@query
def op7_mixing(spark, folder):
    return mixing.report(table(spark, folder, "documents"))


@query
def op8_ngram_join(spark, folder):
    return ngram_join.report(table(spark, folder, "documents"))


@query
def op9_neighbours(spark, folder):
    return neighbours.report(table(spark, folder, "embeddings"))


@query
def op10_quality(spark, folder):
    return quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op11_fill_middle(spark, folder):
    return fill_middle.report(table(spark, folder, "documents"))


SQL["op11_fill_middle"] = fill_middle.REPORT_SQL


@query
def op12_page_text(spark, folder):
    return page_text.report(table(spark, folder, "pages"))


@query
def op13_turns(spark, folder):
    return turns.report(table(spark, folder, "conversations"))
