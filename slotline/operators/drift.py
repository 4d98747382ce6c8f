"""Population stability and the drift report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline import fixed
from slotline.functions import columns as X
from slotline.operators.order import LISTED, SHIFTS, cut, order_bits, select_ranks, wanted_buckets
from slotline.session import stage


def drift_scores(
    df: DataFrame,
    features: Sequence[str],
    reference: Column,
    bins: int = fixed.PSI_BINS,
    floor: float = fixed.PSI_FLOOR,
) -> DataFrame:
    """PSI, means and row counts per feature; ``reference`` tells reference rows from recent ones.

    Bin edges are the reference's exact quantiles with repeats removed; fewer than three
    leave nothing to compare (0). Values outside the reference range are in no bin and do not count
    towards the shares. A bin that is empty on both sides adds nothing.

    Two scans: the first counts both sides per feature and bucket of leading bits, the second looks only at the values of
    buckets in which an edge may lie. All other buckets fall into one bin as a whole.
    """
    rows = (
        df.where(reference.isNotNull())
        .select(reference.alias("_ref"), *[F.col(c).cast("double").alias(c) for c in features])
        .unpivot(["_ref"], list(features), "feature", "_v")
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_bits", order_bits("_v"))
        .withColumn("_bucket", cut("_bits", SHIFTS[0]))
    )
    cells = stage(
        rows.groupBy("feature", "_ref", "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_sum"), F.max("_v").alias("_v")),
        "cells",
    )
    probabilities = [i / bins for i in range(bins + 1)]
    # An edge lies in a bucket that holds a wanted rank, or between two of them that follow each other.
    first = cells.where("_ref").select("feature", "_bucket", F.col("_n").alias("_in"))
    near = wanted_buckets(first, probabilities, ["feature"])
    spans = near.select("feature", F.col("_bucket").alias("_from"), F.when(F.col("_next_wanted"), F.col("_next")).otherwise(F.col("_bucket")).alias("_to"))
    inside = F.col("_bucket").between(F.col("_from"), F.col("_to"))
    # At most two spans per probability and feature.
    looked = stage(cells.join(F.broadcast(spans), "feature").where(inside).select("feature", "_bucket").distinct(), "looked")
    listed = F.broadcast(looked) if looked.count() <= LISTED else looked
    values = stage(
        rows.join(listed, ["feature", "_bucket"]).groupBy("feature", "_ref", "_bucket", "_bits", "_v").agg(F.count(F.lit(1)).alias("_n")), "values"
    )
    edges = select_ranks(
        values.where("_ref").select("feature", "_v", "_bits", "_n"), first, probabilities, ["feature"], "_q", few_groups=True
    ).select("feature", F.array_sort(F.array_distinct("_q")).alias("_edges"))
    parts = cells.join(looked, ["feature", "_bucket"], "left_anti").select("feature", "_ref", "_v", "_n", "_sum").unionByName(
        values.select("feature", "_ref", "_v", "_n", (F.col("_v") * F.col("_n")).alias("_sum"))
    )
    # Right-closed bins, the lowest edge in the first; no bin outside the edges.
    places = " ".join(f"WHEN _v <= get(_edges, {i}) THEN {i}" for i in range(1, bins + 1))
    side = lambda c, ref: F.sum(F.when(F.col("_ref") if ref else ~F.col("_ref"), F.col(c)))
    # One row per feature column: the size is fixed by the call.
    binned = (
        parts.join(F.broadcast(edges), "feature", "left")
        .withColumn("_bin", F.expr(f"CASE WHEN _v < get(_edges, 0) THEN NULL {places} END"))
        .groupBy("feature", "_bin")
        .agg(
            F.max(F.size("_edges")).alias("_edge_count"),
            side("_sum", True).alias("_rv"),
            side("_sum", False).alias("_cv"),
            F.coalesce(side("_n", True), F.lit(0)).alias("_r"),
            F.coalesce(side("_n", False), F.lit(0)).alias("_c"),
        )
    )
    inside = Window.partitionBy("feature", F.col("_bin").isNull())
    share = lambda c: F.greatest(F.try_divide(F.col(c), F.sum(c).over(inside)), F.lit(floor))
    total = lambda c: F.sum(c).over(inside)
    scored = binned.select(
        "*", share("_r").alias("_rs"), share("_c").alias("_cs"), (total("_c") > 0).alias("_seen")
    )
    term = F.when(
        F.col("_bin").isNotNull() & F.col("_seen"),
        (F.col("_cs") - F.col("_rs")) * F.ln(F.col("_cs") / F.col("_rs")),
    )
    usable = (F.max("_edge_count") >= 3) & (F.sum("_r") > 0) & (F.sum("_c") > 0)
    return scored.groupBy("feature").agg(
        F.when(usable, F.coalesce(F.sum(term), F.lit(0.0))).otherwise(0.0).alias("psi"),
        F.try_divide(F.sum("_rv"), F.sum("_r")).alias("train_mean"),
        F.try_divide(F.sum("_cv"), F.sum("_c")).alias("recent_mean"),
        F.sum("_r").alias("reference_rows"),
        F.sum("_c").alias("recent_rows"),
    )


def drift_report(df: DataFrame, features: Sequence[str], reference: Column) -> DataFrame:
    """Drift rows with their level, largest PSI first."""
    return (
        drift_scores(df, features, reference)
        .withColumn("drift_level", X.drift_level("psi"))
        .orderBy(F.desc("psi"), "feature")
    )


def drift_record(
    df: DataFrame, features: Sequence[str], time: str, split: Column, rows: DataFrame | None = None
) -> DataFrame:
    """The report as one nested row. The feature list is as long as ``features``.

    ``rows`` are drift rows that were worked out before (``drift_report``); without them they are worked out here.
    """
    if rows is None:
        rows = drift_report(df, features, F.col(time) <= split)
    item = F.struct(
        (-F.round("psi", 6)).alias("order"),
        F.col("feature"),
        F.round("psi", 6).alias("psi"),
        F.col("drift_level"),
        F.round("train_mean", 6).alias("train_mean"),
        F.round("recent_mean", 6).alias("recent_mean"),
    )
    counted = df.agg(
        F.count_if(F.col(time) <= split).alias("reference_rows"),
        F.count_if(F.col(time) > split).alias("recent_rows"),
    )
    listed = rows.agg(F.array_sort(F.collect_list(item)).alias("f")).select(
        F.transform("f", lambda x: x.dropFields("order"))
    )
    return counted.select(
        split.alias("train_period_end"),
        "reference_rows",
        "recent_rows",
        listed.scalar().alias("features"),
    )


def drift_decision(report: DataFrame, threshold: float = fixed.DRIFT_CUTS[0], force: bool = False) -> DataFrame:
    """One row: worst PSI, severity, feature count and whether to retrain."""
    worst = F.coalesce(F.max("psi"), F.lit(0.0))
    return report.agg(
        worst.alias("max_psi"),
        F.count(F.lit(1)).alias("features_monitored"),
        F.coalesce(F.bool_or(F.col("psi") >= threshold), F.lit(False)).alias("breached"),
    ).select(
        "max_psi",
        "features_monitored",
        X.drift_level("max_psi", fixed.DRIFT_SEVERITIES).alias("severity"),
        (F.col("breached") | F.lit(force)).alias("retrain"),
    )
