"""Mix of sources to target weights with hash-threshold histograms.

Each row has a reproducible hash of its id and text. Sizes are summed by source and leading hash digit; the
digit at which the running sum crosses the source's budget holds the threshold, and only the rows of that one
bucket per source are summed again by the next digit, until it holds one row. Rows below the threshold
are taken; nothing is sorted. A budget above the source's size takes every row once and then a second time below the
threshold, so thresholds are nested: a larger budget keeps all rows of a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotline.llm.common import WORD, bounded_join, number_rows, unwrapped, wrapped
from slotline.session import Staging

BITS = 12
DIGITS = 10  # five of the hash, five that part rows whose id and text are equal
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(id_column: Column, text: Column, seed: int) -> Column:
    """The row's hash digits, most significant first, as one array of ``DIGITS`` numbers below 2**BITS."""
    own = F.xxhash64(F.lit(seed), id_column.cast("string"), id_column.isNull(), text)
    tie = F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id())
    half = DIGITS // 2
    mask = F.lit((1 << BITS) - 1)
    return F.array(
        *[
            F.shiftrightunsigned(x, 64 - BITS * (i + 1)).bitwiseAND(mask).cast("int")
            for x in (own, tie)
            for i in range(half)
        ]
    )


def budgets(sizes: DataFrame, held: Staging, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source (in code point order, null last) its target: ``share`` of all sizes by weight, at most ``most`` times its size.

    What a source cannot take is shared again by weight among the others until none is above. Every round is one
    aggregate over the table of sources; two numbers come to the driver.
    """
    ordered = number_rows(sizes, [F.col("source").asc_nulls_last()], held, "sources")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ordered.withColumn("weight", F.element_at(turn, (F.col("row_no") % len(weights) + 1).cast("int"))).withColumn(
        "cap", F.col("source_size") * F.lit(most)
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    goal, level = share * total, 0.0
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("cap")
        row = ranked.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        raised = (goal - row["fixed"]) / row["open"]
        if raised <= level:
            break
        level = raised
    return ranked.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame, sources: int, held: Staging) -> DataFrame:
    """Per source ``passes`` (whole passes over it, 0 or 1) and ``cut``: rows with digits below ``cut`` are taken once more.

    ``rows`` has source, size and digits. The boundary bucket is refined digit by digit until it holds a single row,
    which is taken when that brings the source nearer to its budget.
    """
    open_ = targets.select(
        "source",
        F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0).alias("passes"),
        F.when(F.col("target") >= F.col("source_size"), F.col("target") - F.col("source_size")).otherwise(F.col("target")).alias("left"),
        F.array().cast("array<int>").alias("prefix"),
    )
    inside, found = rows, None
    running = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("source").orderBy(F.desc("digit"))
    for depth in range(DIGITS):
        counted = inside.groupBy("source", F.element_at("digits", depth + 1).alias("digit")).agg(
            F.sum("size").alias("sum"), F.count(F.lit(1)).alias("rows")
        )
        histogram = bounded_join(counted, open_, "source", sources).withColumn("before", F.coalesce(F.sum("sum").over(running), F.lit(0)))
        # The boundary is the last bucket that starts at or below what is left; of buckets without words the first.
        boundary = (
            histogram.filter(F.col("before") <= F.col("left"))
            .withColumn("_last", F.row_number().over(last))
            .filter("_last = 1")
            .select(
                "source",
                "passes",
                (F.col("left") - F.col("before")).alias("left"),
                F.concat("prefix", F.array("digit")).alias("prefix"),
                "sum",
                "rows",
            )
        )
        boundary = held.keep(boundary, f"boundary{depth}")
        done = (F.col("rows") <= 1) | (F.col("sum") <= F.col("left"))
        take = F.when(F.col("sum") <= F.col("left"), True).otherwise(F.col("left") * 2 >= F.col("sum"))
        settled = boundary.filter(done if depth < DIGITS - 1 else F.lit(True)).select("source", "passes", "prefix", take.alias("take"))
        found = settled if found is None else found.unionByName(settled)
        if depth == DIGITS - 1:
            break
        refine = boundary.filter(~done)
        if refine.isEmpty():
            break
        open_ = refine.select("source", "passes", "left", "prefix")
        marked = bounded_join(inside, refine.select("source", F.element_at("prefix", -1).alias("_digit")), "source", sources)
        inside = held.keep(
            marked.filter(F.element_at("digits", depth + 1) == F.col("_digit")).select("source", "size", "digits"), f"inside{depth}"
        )
    return found


def taken_times(digits: Column, passes: Column, prefix: Column, take: Column) -> Column:
    """How often a row is taken, from its digits and its source's threshold."""
    own = F.slice(digits, F.lit(1), F.size(prefix))
    below = (own < prefix) | ((own == prefix) & take)
    return F.coalesce(passes + F.when(below, 1).otherwise(0), F.lit(0)).cast("int")


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` as id, source, size, source_size, target and ``times`` (0, 1 or 2 times the whole row).

    Null texts have size 0 and null sources are one source, the last. Rows with equal id and text are told apart by
    their scan position, which only decides how many of such copies are taken. Empty tables give no rows. A row without
    words is taken with its bucket and changes no sum. Other columns are not read.
    """
    held = Staging(docs.sparkSession, "mixing")
    narrow = held.keep(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            words(F.col(text_col)).alias("size"),
            place(F.col(id_col), F.col(text_col), seed).alias("digits"),
        ),
        "rows",
    )
    targets, cuts, sources = plan(narrow, held)
    marked = bounded_join(bounded_join(narrow, targets, "source", sources), cuts, "source", sources)
    times = taken_times(F.col("digits"), F.col("passes"), F.col("prefix"), F.col("take"))
    return marked.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", times.alias("times")
    )


def plan(narrow: DataFrame, held: Staging) -> tuple[DataFrame, DataFrame, int]:
    """Targets and thresholds for rows with source, size and digits, and the number of sources."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = held.keep(budgets(sizes, held), "targets")
    sources = targets.count()
    return targets, thresholds(narrow.select("source", "size", "digits"), targets, sources, held), sources


def mixed_rows(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` itself, each row as often as the mix takes it, with unchanged columns."""
    held = Staging(docs.sparkSession, "mixing")
    marked = wrapped(docs, source=F.col(source_col), size=words(F.col(text_col)), digits=place(F.col(id_col), F.col(text_col), seed))
    narrow = held.keep(marked.drop("row"), "rows")
    _, cuts, sources = plan(narrow, held)
    joined = bounded_join(marked.drop("size"), cuts, "source", sources)
    times = taken_times(F.col("digits"), F.col("passes"), F.col("prefix"), F.col("take"))
    copies = joined.withColumn("copy", F.explode(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), times)))
    return unwrapped(copies, docs)


def report(docs: DataFrame) -> DataFrame:
    m = mix(docs)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "source")
