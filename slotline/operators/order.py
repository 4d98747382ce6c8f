"""Global order without a global task: distinct-value positions, exact quantiles, dense ranks.

Values are first counted (combined on the map side, so a value that repeats in a third of all rows
becomes one row), then placed in buckets that preserve order: the leading bits of the number. Buckets that are too full are split
by further bits. Positions inside a bucket come from a window over that bucket; the positions before a bucket come from a table with one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline.session import stage


def order_bits(value: str | Column) -> Column:
    """The bits of a double as a whole number in the same order: sign, then exponent, then fraction. Infinite values have their place, both zeros share one.

    Asked of the JVM once per row; the result is not worked out again where several expressions use it. NaN has no place and must be left out.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.abs(v)).cast("long")
    return F.when(v < 0, -bits).otherwise(bits)


#: Bits that a refinement leaves out of a bucket: first all but sign, exponent and 8 bits of the fraction, then 12 fewer at a time.
SHIFTS = (44, 32, 20, 8, 0)
FULL = 65_536  # distinct values that one window sorts; fuller buckets are split further


def number_bucket(value: str, shift: int = SHIFTS[0]) -> Column:
    """Order-preserving bucket of a number, fixed by the value alone: its leading bits."""
    return F.shiftright(order_bits(value), shift)


def time_bucket(value: str, seconds: int = 86_400) -> Column:
    """Order-preserving bucket of an instant: one per day by default."""
    return F.floor(F.unix_micros(F.col(value).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def value_positions(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    bucket: Column | None = None,
) -> DataFrame:
    """Distinct non-null values per group with their place in ascending order.

    Adds ``n`` (rows with the value), ``position`` (1-based among distinct values), ``before`` (rows with a
    smaller value), ``total_rows`` and ``total_values``.
    """
    groups = list(groups)
    present = F.col(value).isNotNull()
    if df.schema[value].dataType.typeName() in ("double", "float"):
        present = present & ~F.isnan(value)
    counted = df.where(present).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    if bucket is None:
        counted = split_buckets(counted, value, groups)
    else:
        counted = counted.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*groups, "_bucket").orderBy(value)
    local = counted.withColumns(
        {
            "_position": F.row_number().over(inside),
            "_before": F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            - F.col("n"),
        }
    )
    # One row per bucket: buckets are split only while they are full, so there are few of them beside the values.
    per_bucket = counted.groupBy(*groups, "_bucket").agg(
        F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_values")
    )
    across = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    lower = across.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *groups,
        "_bucket",
        F.coalesce(F.sum("_rows").over(lower), F.lit(0)).alias("_rows_below"),
        F.coalesce(F.sum("_values").over(lower), F.lit(0)).alias("_values_below"),
        F.sum("_rows").over(across).alias("total_rows"),
        F.sum("_values").over(across).alias("total_values"),
    )
    return local.join(offsets, [*groups, "_bucket"]).select(
        *groups,
        value,
        "n",
        (F.col("_values_below") + F.col("_position")).alias("position"),
        (F.col("_rows_below") + F.col("_before")).alias("before"),
        "total_rows",
        "total_values",
    )


def split_buckets(counted: DataFrame, value: str, groups: Sequence[str] = (), full: int | None = None) -> DataFrame:
    """``counted`` (distinct values) with ``_bucket``, the least bits of its bucket; no bucket holds more than ``full`` values.

    Buckets start from the leading bits and only those that are too full are split by 12 more bits, four times at most. Buckets of all depths are
    disjoint intervals of the same order.
    """
    full = FULL if full is None else full
    groups = list(groups)
    rows = stage(counted.withColumn("_bits", order_bits(value)).withColumn("_bucket", cut("_bits", SHIFTS[0])), "counted")
    for shift in SHIFTS[1:]:
        heavy = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_values")).where(F.col("_values") > full)
        if heavy.isEmpty():
            break
        marks = heavy.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_heavy"))
        same = F.col("_bucket") == F.col("_heavy")
        for i, g in enumerate(groups):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        # A heavy bucket stands for more than ``full`` values, so the list is that much shorter than the table.
        split = F.when(F.col("_heavy").isNotNull(), cut("_bits", shift)).otherwise(F.col("_bucket"))
        rows = stage(rows.join(marks, same, "left").withColumn("_bucket", split).select(*rows.columns), "counted")
    return rows.drop("_bits")


def cut(bits: str, shift: int) -> Column:
    return F.shiftleft(F.shiftright(bits, shift), shift)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    groups: Sequence[str] = (),
    output: str = "quantiles",
    few_groups: bool = False,
) -> DataFrame:
    """Linear-interpolation quantiles per group as an array column, by radix refinement.

    A pass counts rows per bucket of leading bits; the counts tell which buckets hold the wanted ranks, and only rows of those are looked at again, by 12 more
    bits at a time, until a bucket holds few rows or one value. Wanted buckets are two per probability and group at most. With ``few_groups``
    (the caller knows the groups: models, feature columns, none) they are broadcast up to ``LISTED`` of them; otherwise they are joined by size.
    """
    groups = list(groups)
    present = F.col(value).isNotNull()
    if df.schema[value].dataType.typeName() in ("double", "float"):
        present = present & ~F.isnan(value)
    rows = df.where(present).select(*groups, F.col(value).cast("double").alias("_v")).withColumn("_bits", order_bits("_v"))
    first = rows.groupBy(*groups, cut("_bits", SHIFTS[0]).alias("_bucket")).agg(F.count(F.lit(1)).alias("_in"))
    return select_ranks(rows, first, probabilities, groups, output, few_groups)


LISTED = 100_000


def _wanted(probabilities: Sequence[float]) -> tuple[list[str], str, str]:
    """SQL for the place of each probability, the ranks beside these places, and whether a bucket holds one of them."""
    spots = [f"CAST({float(p)!r} AS DOUBLE) * (_total - 1)" for p in probabilities]
    ranks = ", ".join(f"CAST({side}({s}) AS BIGINT)" for s in spots for side in ("floor", "ceil"))
    return spots, ranks, f"exists(array({ranks}), r -> r >= _below AND r < _below + _in)"


def wanted_buckets(first: DataFrame, probabilities: Sequence[float], groups: Sequence[str]) -> DataFrame:
    """Rows of ``first`` (groups, _bucket, _in) that hold a wanted rank, with ``_below``, ``_total``, the next bucket and whether that one is wanted too."""
    across = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    order = across.orderBy("_bucket")
    lower = order.rowsBetween(Window.unboundedPreceding, -1)
    counts = first.withColumns({"_below": F.coalesce(F.sum("_in").over(lower), F.lit(0)), "_total": F.sum("_in").over(across)})
    marked = counts.withColumn("_wanted", F.expr(_wanted(probabilities)[2]))
    marked = marked.withColumns({"_next": F.lead("_bucket").over(order), "_next_wanted": F.coalesce(F.lead("_wanted").over(order), F.lit(False))})
    return marked.where("_wanted").drop("_wanted")


def select_ranks(
    rows: DataFrame, first: DataFrame, probabilities: Sequence[float], groups: Sequence[str], output: str, few_groups: bool
) -> DataFrame:
    """Quantiles of ``rows`` (groups, _v, _bits) from the counts ``first`` (groups, _bucket, _in) of the first pass."""
    groups = list(groups)
    spots, ranks, holds = _wanted(probabilities)
    wanted = stage(wanted_buckets(first, probabilities, groups).drop("_next", "_next_wanted"), "wanted")
    inside = rows
    for depth, shift in enumerate(SHIFTS):
        listed = F.broadcast(wanted) if few_groups and wanted.count() <= LISTED else wanted
        keys = listed.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b"), "_below", "_total")
        same = cut("_bits", shift) == F.col("_b")
        for i, g in enumerate(groups):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        drop = [f"_g{i}" for i in range(len(groups))]
        near = inside.join(keys, same).drop(*drop)
        last = depth == len(SHIFTS) - 1
        if last or wanted.agg(F.max("_in")).first()[0] is None or wanted.agg(F.max("_in")).first()[0] <= FULL:
            break
        # Equal values fall together on the map side, so what is looked at again shrinks at once.
        inside = stage(near.groupBy(*groups, "_v", "_bits", "_b", "_below", "_total").agg(_rows_of(near)), "inside")
        finer = inside.groupBy(*groups, "_b", "_total", cut("_bits", SHIFTS[depth + 1]).alias("_bucket")).agg(F.sum("_n").alias("_in"), F.min("_below").alias("_base"))
        part = Window.partitionBy(*groups, "_b").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        finer = finer.withColumn("_below", F.col("_base") + F.coalesce(F.sum("_in").over(part), F.lit(0)))
        wanted = stage(finer.where(holds).select(*groups, "_bucket", "_in", "_below", "_total"), "wanted")
        inside = inside.select(*groups, "_v", "_bits", "_n")
    counted = near.groupBy(*groups, "_b", "_below", "_total", "_v").agg(_rows_of(near))
    upto = Window.partitionBy(*groups, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        counted.withColumn("_end", F.col("_below") + F.sum("_n").over(upto))
        .withColumn(
            "_rank",
            F.expr(f"explode(filter(array_distinct(array({ranks})), r -> r >= _end - _n AND r < _end))"),
        )
        .groupBy(*groups)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),  # one entry per rank
            F.max("_total").alias("_total"),
        )
    )
    low = [f"_at[CAST(floor({s}) AS BIGINT)]" for s in spots]
    high = [f"_at[CAST(ceil({s}) AS BIGINT)]" for s in spots]
    values = [f"{lo} + ({hi} - {lo}) * ({s} - floor({s}))" for lo, hi, s in zip(low, high, spots)]
    return found.select(*groups, F.expr(f"array({', '.join(values)})").alias(output))


def _rows_of(df: DataFrame) -> Column:
    return (F.sum("_n") if "_n" in df.columns else F.count(F.lit(1))).alias("_n")


def row_numbers(df: DataFrame, order: Sequence[Column], output: str = "row_no") -> DataFrame:
    """``df``, written once, with its place in ``order`` from 0. Equal rows are told apart by their scan position.

    A range exchange and a sort inside its partitions place each row there; the sizes of the partitions, one row each, give the rest.
    """
    tie = F.monotonically_increasing_id()
    sorted_ = df.withColumn("_tie", tie).repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie")).drop("_tie")
    placed = stage(sorted_.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")).select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(output, F.col("_before") + inside).drop("_part", "_at", "_before")


def dense_rank(df: DataFrame, score: str, output: str, bucket: Column | None = None) -> DataFrame:
    """Dense rank of every row by ``score``, highest first, over the whole table.

    Equal scores share one row of the rank table, so the join back is many-to-one and a popular
    score can be split by the adaptive skew join.
    """
    ranks = value_positions(df, score, (), bucket).select(
        F.col(score).alias("_score"),
        (F.col("total_values") - F.col("position") + 1).cast("int").alias(output),
    )
    return df.join(ranks, F.col(score) == F.col("_score"), "left").drop("_score")
