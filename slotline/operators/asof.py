"""As-of join: for each left row the latest right row at or before it, per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotline.session import stage


FULL = 200_000  # rows of one key that one task takes in order
WIDTHS = (3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
LISTED = 100_000


def _start(us: Column, width: int) -> Column:
    return (F.floor(us / F.lit(width)) * F.lit(width)).cast("long")


def _same(df: DataFrame, other: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, n: a & df[n].eqNullSafe(other[n]), names, F.lit(True))


def _cut_full(asked: DataFrame, found: DataFrame, names: list[str], span: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Both sides with shorter buckets where a key has more than ``limit`` rows in one; a bucket is named by its first microsecond.

    Buckets of all lengths are disjoint and in order, so the rest of the join needs no change. Instants that are too full by themselves come third, if there
    are any: at most one for each ``limit`` rows.
    """
    for width in [*[w for w in WIDTHS if w < span], 0]:
        both = asked.select(*names, "_bucket").unionByName(found.select(*names, "_bucket"))
        full = both.groupBy(*names, "_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).drop("_n")
        full = stage(full, "full")
        if full.isEmpty():
            return asked, found, None
        if not width:
            return asked, found, full
        marks = full.select(*[F.col(n).alias(f"_f{n}") for n in names], F.col("_bucket").alias("_full"))
        marks = F.broadcast(marks) if marks.count() <= LISTED else marks
        same = F.col("_bucket") == F.col("_full")
        for n in names:
            same = same & F.col(n).eqNullSafe(F.col(f"_f{n}"))
        finer = F.when(F.col("_full").isNotNull(), _start(F.unix_micros(F.col("_at").cast("timestamp")), width)).otherwise(F.col("_bucket"))
        asked, found = (d.join(marks, same, "left").withColumn("_bucket", finer).select(*d.columns) for d in (asked, found))
    raise AssertionError("the last width is 0")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    right_columns: dict[str, str],
    tie_break: str | None = None,
    bucket_seconds: int = 86_400,
    full: int = FULL,
) -> DataFrame:
    """Left-outer as-of join. ``right_columns`` maps right column -> output column.

    Rows are spread over (key, time bucket), so a key that owns a large share of all rows
    is still split into many tasks. Buckets that hold more than ``full`` rows by a first count are cut into shorter ones, down to
    single instants if need be; left rows of one instant have one answer, which is looked up for the instant and joined to them. What crosses a bucket boundary is only the newest right
    row of each earlier bucket: it is found by a combinable aggregation, carried forward over
    the per-key list of buckets (one row per key and bucket) and put in front of the bucket's rows.
    Among right rows at one instant the largest ``tie_break`` wins.
    """
    span = bucket_seconds * 1_000_000

    def bucket_of(time: str):
        return _start(F.unix_micros(F.col(time).cast("timestamp")), span)

    payload = F.struct(*[F.col(src).alias(out) for src, out in right_columns.items()])
    # A null key equals no key: such right rows are no match, such left rows stay without one.
    usable = F.col(right_time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    found = right.where(usable).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        bucket_of(right_time).alias("_bucket"),
        F.col(right_time).alias("_at"),
        (F.col(tie_break) if tie_break else F.lit(0)).alias("_tie"),
        payload.alias("_right"),
    )
    asked = left.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        bucket_of(left_time).alias("_bucket"),
        F.col(left_time).alias("_at"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    names = [f"_k{i}" for i in range(len(keys))]
    asked, found, instants = _cut_full(asked, found, names, span, full)

    no_left = F.lit(None).cast(asked.schema["_left"].dataType)
    crowded = None
    if instants is not None:
        # Of the right rows of one instant only the one with the largest tie is ever the answer, and its left rows share one.
        thick = found.join(F.broadcast(instants), _same(found, instants, [*names, "_bucket"]), "left_semi")
        one = thick.groupBy(*names, "_bucket", "_at").agg(F.max_by("_right", F.struct("_tie")).alias("_right"), F.max("_tie").alias("_tie"))
        found = found.join(F.broadcast(instants), _same(found, instants, [*names, "_bucket"]), "left_anti").unionByName(one)
        crowded = asked.join(F.broadcast(instants), _same(asked, instants, [*names, "_bucket"]), "left_semi")
        asked = asked.join(F.broadcast(instants), _same(asked, instants, [*names, "_bucket"]), "left_anti").unionByName(
            crowded.groupBy(*names, "_bucket").agg(F.min("_at").alias("_at")).withColumn("_left", no_left).select(*asked.columns)
        )
    newest = found.groupBy(*names, "_bucket").agg(
        F.max_by("_right", F.struct("_at", "_tie")).alias("_right")
    )
    needed = asked.select(*names, "_bucket").distinct()
    blank = F.lit(None).cast(found.schema["_right"].dataType)
    earlier = Window.partitionBy(*names).orderBy(F.col("_bucket").asc_nulls_first())
    carried = (
        newest.select(*names, "_bucket", "_right", F.lit(False).alias("_needed"))
        .unionByName(needed.select(*names, "_bucket", blank.alias("_right"), F.lit(True).alias("_needed")))
        .groupBy(*names, "_bucket")
        .agg(F.first("_right", ignorenulls=True).alias("_own"), F.bool_or("_needed").alias("_needed"))
        .withColumn(
            "_right",
            F.last("_own", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)),
        )
        .where(F.col("_needed") & F.col("_right").isNotNull())
    )

    no_time = F.lit(None).cast(asked.schema["_at"].dataType)
    no_tie = F.lit(None).cast(found.schema["_tie"].dataType)
    shape = [*names, "_bucket", "_at", "_side", "_tie", "_left", "_right"]
    rows = (
        carried.select(*names, "_bucket", no_time.alias("_at"), F.lit(0).alias("_side"),
                       no_tie.alias("_tie"), no_left.alias("_left"), "_right")
        .select(*shape)
        .unionByName(found.select(*names, "_bucket", F.col("_at"), F.lit(1).alias("_side"), "_tie",
                                  no_left.alias("_left"), "_right").select(*shape))
        .unionByName(asked.select(*names, "_bucket", "_at", F.lit(2).alias("_side"), no_tie.alias("_tie"),
                                  "_left", blank.alias("_right")).select(*shape))
    )
    in_order = (
        Window.partitionBy(*names, "_bucket")
        .orderBy(F.col("_at").asc_nulls_first(), "_side", "_tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answered = rows.withColumn("_right", F.last("_right", ignorenulls=True).over(in_order)).where(F.col("_side") == 2)
    if crowded is not None:
        answered = stage(answered, "answered")
        shared = answered.where(F.col("_left").isNull()).select(*[F.col(n).alias(f"_s{n}") for n in [*names, "_bucket"]], F.col("_right").alias("_shared"))
        hit = reduce(lambda a, n: a & F.col(n).eqNullSafe(F.col(f"_s{n}")), [*names, "_bucket"], F.lit(True))
        joined = crowded.join(F.broadcast(shared), hit, "left").select("_left", F.col("_shared").alias("_right"))
        answered = answered.where(F.col("_left").isNotNull()).select("_left", "_right").unionByName(joined)
    return answered.select("_left.*", *[F.col(f"_right.{out}").alias(out) for out in right_columns.values()])
