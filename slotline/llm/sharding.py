"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Row numbers come from the order of (id, size, checksum); the permutation sends row number to a position,
position % shards is the shard and position // shards the slot, so row counts differ by one at most and every
place can be computed from the row number and the row count alone, in both directions (``position``,
``row_number_of``).

The permutation works on pairs (left, right) with left < a and right < b, where a = ceil(sqrt(n)) and
b = ceil(n / a). a * b is n or a little more; a position of n or more is permuted again (cycle walking) until it
is below n. Fewer than a of the a * b pairs lie outside, so ``STEPS`` walks are never used up in practice:
for n < STEPS**2 they cannot be, and beyond it the chance is below STEPS**-STEPS a row; the query would stop, not go wrong.
Round functions are cubes modulo a prime in 64-bit integers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import number_rows
from slotline.session import Staging

PRIME = 2_147_483_647
ROUNDS = 6
STEPS = 64
SEED = 20_240_229


def round_keys(seed: int = SEED) -> list[tuple[int, int]]:
    """One (shift, factor) per round, by a linear congruence."""
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        shift = x = (x * 48_271 + 11) % PRIME
        factor = x = (x * 48_271 + 11) % PRIME
        keys.append((shift, factor or 1))
    return keys


def sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, -(-max(n, 1) // a)


def _mix(x: Column, shift: Column, factor: Column) -> Column:
    t = (x + shift) % F.lit(PRIME)
    return ((t * t % F.lit(PRIME)) * t % F.lit(PRIME)) * factor % F.lit(PRIME)


def _once(x: Column, n: int, keys: list[tuple[int, int]], back: bool) -> Column:
    """One pass through all rounds, the last first when ``back``."""
    a, b = sides(n)
    shifts, factors = (F.array(*[F.lit(k[i]).cast("long") for k in keys]) for i in (0, 1))
    sign = F.lit(-1 if back else 1)

    def at_round(pair: Column, i: Column) -> Column:
        left, right = pair["left"], pair["right"]
        mixed = sign * _mix(F.when(i % 2 == 0, left).otherwise(right), F.element_at(shifts, i), F.element_at(factors, i))
        return F.struct(
            F.when(i % 2 == 0, left).otherwise(F.pmod(left + mixed, F.lit(a).cast("long"))).alias("left"),
            F.when(i % 2 == 0, F.pmod(right + mixed, F.lit(b).cast("long"))).otherwise(right).alias("right"),
        )

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    pair = F.struct((x % F.lit(a)).cast("long").alias("left"), F.floor(x / F.lit(a)).cast("long").alias("right"))
    return F.aggregate(rounds, pair, at_round, lambda p: p["left"] + p["right"] * F.lit(a))


def _walk(x: Column, n: int, seed: int, back: bool) -> Column:
    keys = round_keys(seed)
    # Step 1 always permutes; a later one only what is still outside.
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        x,
        lambda at, i: F.when((i > 1) & (at < F.lit(n)), at).otherwise(_once(at, n, keys, back)),
    )
    return F.nullif(F.when(walked < F.lit(n), walked).otherwise(F.lit(-1).cast("long")), F.lit(-1).cast("long"))


def position(row_no: Column, n: int, seed: int = SEED) -> Column:
    """Place of a row number in the shuffled order of ``n`` rows."""
    return _walk(row_no.cast("long"), n, seed, back=False)


def row_number_of(place: Column, n: int, seed: int = SEED) -> Column:
    """Inverse of ``position``."""
    return _walk(place.cast("long"), n, seed, back=True)


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Per row: id, ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``, ``shard`` and ``slot``.

    Only these narrow columns are exchanged, once, by range. Null ids come first, null texts count as empty; rows that are
    equal in id, size and checksum get neighbouring row numbers (which of them gets which makes no difference);
    an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    order = [F.col("id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    numbered = number_rows(narrow, order, Staging(docs.sparkSession, "sharding"), "rows")
    n = numbered.count()
    ended = F.coalesce(position(F.col("row_no"), n, seed), F.raise_error(F.lit("a cycle walk did not end")).cast("long"))
    placed = numbered.withColumn("at", ended)
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        (F.col("at") % shards).cast("int").alias("shard"),
        F.floor(F.col("at") / shards).cast("long").alias("slot"),
    )


def report(docs: DataFrame, shards: int = 40) -> DataFrame:
    placed = shard(docs, shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
