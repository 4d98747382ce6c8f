"""Pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slotline.session import Staging

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> Column:
    """The top-level column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def wrapped(df: DataFrame, **more: Column) -> DataFrame:
    """Whole rows as one column ``row`` beside further columns, so that no name of the rows' own can clash with those."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def unwrapped(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The rows that ``wrapped`` took in, with the columns of ``like``; ``changed`` columns take the place of the rows' own."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in like.columns])


def row_key(id_column: Column, text: Column) -> Column:
    """A non-null key that is equal for repeated rows: same id, same text (by a 64-bit hash, which parts texts of one id)."""
    told = F.when(id_column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), id_column.cast("string")))
    return F.concat(told, F.lit("."), F.hex(F.xxhash64(text)))


def number_rows(df: DataFrame, order: list[Column], held: Staging, name: str) -> DataFrame:
    """``df`` with ``row_no``, 0 to n - 1 in ``order``, written under ``held``.

    A range exchange and a sort inside its partitions give each row its place there; partition sizes (one row
    per partition, a bounded table) give the offset. Rows that are equal in ``order`` are spread by their scan
    position, so a value that fills a third of the table does not sit in one task.
    """
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, F.col("_tie"))
        .sortWithinPartitions(*order, F.col("_tie"))
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = held.keep(placed, name)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("row_no", F.col("_before") + inside)
        .drop("_part", "_at", "_before")
    )


def bounded_join(df: DataFrame, small: DataFrame, on: str, rows: int, limit: int = 50_000, salts: int = 64) -> DataFrame:
    """Left join with a table of ``rows`` rows that is unique in ``on`` (nulls match nulls).

    Up to ``limit`` rows it is broadcast; beyond, each row is repeated per salt and ``df`` is spread over the
    salts, so a value with a third of all rows is dealt to ``salts`` tasks.
    """
    if rows <= limit:
        side = small.withColumnRenamed(on, "_on")
        return df.join(F.broadcast(side), F.col(on).eqNullSafe(F.col("_on")), "left").drop("_on")
    side = small.withColumnRenamed(on, "_on").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    hit = F.col(on).eqNullSafe(F.col("_on")) & (F.col("_salt") == F.col("_copy"))
    return spread.join(side, hit, "left").drop("_on", "_salt", "_copy")


def spans_text(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined; spans are structs (start, kind, stop)."""
    names = F.array(*[F.lit(k) for k in kinds])
    told = F.transform(
        F.array_sort(spans),
        lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")
        ),
    )
    return F.array_join(told, ",")


SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("stop", T.IntegerType())]
    )
)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def located(text: Column, matches: Column, pattern: str, kind: int, keep) -> Column:
    """Places, in code points, of those ``matches`` of ``pattern`` that pass ``keep``.

    ``matches`` are what ``regexp_extract_all`` found; ``split`` by the same pattern gives the texts
    between them, so one running sum gives every place.
    """

    def step(seen, x):
        start = seen["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))
        found = F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(seen["found"], F.array(span))).otherwise(
            seen["found"]
        )
        return F.struct(stop.alias("at"), found.alias("found"))

    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), no_spans().alias("found"))
    return F.when(F.size(matches) > 0, F.aggregate(parts, zero, step, lambda s: s["found"])).otherwise(no_spans())
