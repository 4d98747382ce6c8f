"""Document fingerprints by consistent weighted sampling.

A document is its words (lower case) with their counts as weights. For every sample d, a word of weight w has
r, c ~ Gamma(2, 1) and b ~ U(0, 1), all functions of (word, d) alone; with t = floor(ln w / r + b) its value is
ln a = ln c - r (t - b) - r, and the word with the least value gives the sample (word, t). Two documents agree in a
sample with a probability equal to their generalised Jaccard similarity, sum of minima over sum of maxima of the weights.

A sample's value and its identity are packed in one 64-bit number, so a fingerprint is the element-wise minimum over the words: an
aggregation of fixed-width buffers in generated code. A text and its edited form are scored together, since they share most words.

a is exponential with rate w, so the least of a document of total weight W is below DEPTH / W in all samples but for a chance of e^-DEPTH each. A
bound of a from below that needs no logarithm leaves out the words that are above; a sample whose least value is at most DEPTH / W has lost
nothing by that, and a document with any other sample is scored again from all its words.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import WORD, number_rows, row_key
from slotline.session import Staging

SAMPLES, LANE = 64, 4
DEPTH, STEPS = 24.0, 1024
SIGN_BITS, VALUE_SCALE, VALUE_SHIFT = 20, 2.0**35, 64.0
SEPARATOR = r"[\x20\x09-\x0D]+"
U21 = (1 << 21) - 1


def _uniform(bits: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(U21)) + F.lit(0.5)) * F.lit(1.0 / (U21 + 1))


def _bits(name: str, shift: int) -> Column:
    return F.shiftrightunsigned(F.col(name), shift).bitwiseAND(F.lit(U21))


def _step(product: Column) -> Column:
    """The step of a product of two 21-bit numbers."""
    return F.shiftright(product, 42 - STEPS.bit_length() + 1).cast("int")


def _table(values: list[float], up: bool) -> Column:
    """A constant array, rounded to one side."""
    rounded = [(math.ceil if up else math.floor)(v * 1e4) / 1e4 for v in values]
    return F.split(F.lit(",".join(f"{v:.4f}" for v in rounded)), ",").cast("array<double>")


def terms(text: Column) -> Column:
    return F.transform(
        F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != ""), lambda w: F.xxhash64(w)
    )


def _draws(first: Column, second: Column) -> tuple[Column, Column, Column, Column]:
    """r, ln c and b of (word, sample) from its two hashes; what is left of the second is the word's identity in the sample."""
    r = -F.log(_uniform(first, 0) * _uniform(first, 21))
    c = F.log(-F.log(_uniform(first, 42) * _uniform(second, 0)))
    return r, c, _uniform(second, 21), F.shiftrightunsigned(second, 42)


def _packed(log_weight: Column, r: Column, c: Column, b: Column, identity: Column) -> Column:
    """Value and identity of (word, t) in one number. ln 0 is null, so a word that one side lacks leaves that side alone."""
    t = F.floor(log_weight / r + b)
    value = c - r * (t - b) - r
    sign = identity.bitwiseXOR(t * F.lit(40_503)).bitwiseAND(F.lit((1 << SIGN_BITS) - 1))
    return F.shiftleft(_scaled(value), SIGN_BITS) + sign


def _scaled(value: Column) -> Column:
    return ((value + F.lit(VALUE_SHIFT)) * F.lit(VALUE_SCALE)).cast("long")


def _identity(least: Column) -> Column:
    return F.coalesce(least.bitwiseAND(F.lit((1 << 16) - 1)), F.lit(-1)).cast("int")


def _logs(counts: list[str]) -> list[Column]:
    return [F.when(F.col(c) == 1, F.lit(0.0)).otherwise(F.log(F.col(c).cast("double"))).alias(f"_l{j}") for j, c in enumerate(counts)]


def sample(words: DataFrame, key: str, counts: list[str], samples: int = SAMPLES, lane: int = LANE) -> DataFrame:
    """Per ``key`` one array of samples for every column of ``counts``, from rows (key, word, counts...).

    Each row is repeated per lane of a few samples, so that one row's arithmetic is a short generated method. ``words`` must lie
    together by ``key``; nothing is exchanged.
    """
    rows = words.select(key, "word", *_logs(counts), F.explode(F.sequence(F.lit(0), F.lit(samples // lane - 1))).alias("_lane"))
    hashed = rows.select(
        key,
        "_lane",
        *[f"_l{j}" for j in range(len(counts))],
        *[F.xxhash64("word", F.col("_lane") * (2 * lane) + F.lit(2 * i + h)).alias(f"_h{i}{h}") for i in range(lane) for h in (0, 1)],
    )
    drawn = hashed.select(
        key,
        "_lane",
        *[f"_l{j}" for j in range(len(counts))],
        *[x.alias(f"_{n}{i}") for i in range(lane) for n, x in zip("rcbi", _draws(F.col(f"_h{i}0"), F.col(f"_h{i}1")), strict=True)],
    )
    cells = [(i, j) for i in range(lane) for j in range(len(counts))]
    packed = {(i, j): _packed(F.col(f"_l{j}"), *[F.col(f"_{n}{i}") for n in "rcbi"]) for i, j in cells}
    least = drawn.groupBy(key, "_lane").agg(*[F.min(packed[i, j]).alias(f"_m{i}_{j}") for i, j in cells])
    lanes = least.select(
        key, "_lane", *[F.array(*[_identity(F.col(f"_m{i}_{j}")) for i in range(lane)]).alias(f"_s{j}") for j in range(len(counts))]
    )
    gathered = lanes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_lane", *[f"_s{j}" for j in range(len(counts))]))).alias("_all"))
    return gathered.select(key, *[F.flatten(F.col(f"_all._s{j}")).alias(f"samples_{j}") for j in range(len(counts))])


def sample_near(words: DataFrame, key: str, counts: list[str], limits: list[str], samples: int = SAMPLES) -> DataFrame:
    """What ``sample`` gives, from the words that can have a value up to a limit, and ``sure``: whether all least values are.

    ``limits`` are the limits of ln a for each column of ``counts``, by ``key``, on every row; null where the counts add up to 0.
    ln a >= ln c - r s - ln w, where s is 1 - b for weight 1 and 1 for any other; r and ln c are bounded by tables over equal steps
    of the products that they are logarithms of.
    """
    sides = range(len(counts))
    rows = words.select(key, "word", *counts, *limits, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_d"))
    logs = _logs(counts)
    # A little more than the limit, so that rounding leaves out nothing that is within it.
    reach = F.greatest(*[F.col(x) + log for x, log in zip(limits, logs, strict=True)]) + F.lit(1e-6)
    single = F.when(F.greatest(*counts) == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    kept = [key, "_d", *limits, *[f"_l{j}" for j in sides]]
    rows = rows.select(key, "word", "_d", *limits, *logs, reach.alias("_reach"), single.alias("_single"))
    hashed = rows.select(*kept, "_reach", "_single", *[F.xxhash64("word", F.col("_d") * 2 + F.lit(h)).alias(f"_h{h}") for h in (0, 1)])
    most_r = _table([31.0, *[-math.log(k / STEPS) for k in range(1, STEPS + 1)]], up=True)
    least_c = _table([math.log(-math.log((k + 1) / STEPS)) for k in range(STEPS - 1)] + [-99.0, -99.0], up=False)
    at_r = _step(_bits("_h0", 0) * _bits("_h0", 21))
    at_c = _step((_bits("_h0", 42) + F.lit(1)) * (_bits("_h1", 0) + F.lit(1)))
    close = least_c[at_c] - most_r[at_r] * (F.lit(1.0) - _uniform(F.col("_h1"), 21) * F.col("_single")) <= F.col("_reach")
    # The partition's number keeps the filter above the hashes, which would else be taken again for each mention of them.
    near = hashed.select(*kept, "_h0", "_h1", (close & (F.spark_partition_id() >= 0)).alias("_close")).where("_close")
    drawn = near.select(*kept, *[x.alias(f"_{n}") for n, x in zip("rcbi", _draws(F.col("_h0"), F.col("_h1")), strict=True)])
    packed = [_packed(F.col(f"_l{j}"), *[F.col(f"_{n}") for n in "rcbi"]) for j in sides]
    least = drawn.groupBy(key, "_d").agg(*[F.min(packed[j]).alias(f"_m{j}") for j in sides], *[F.max(x).alias(x) for x in limits])
    held = [
        F.col(x).isNull() | F.coalesce(F.shiftright(f"_m{j}", SIGN_BITS) < _scaled(F.col(x)), F.lit(False)) for j, x in enumerate(limits)
    ]
    told = least.select(key, "_d", *[_identity(F.col(f"_m{j}")).alias(f"_s{j}") for j in sides], functools.reduce(Column.__and__, held).alias("_sure"))
    gathered = told.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("_d", *[f"_s{j}" for j in sides]))).alias("_all"), F.min("_sure").alias("_sure")
    )
    return gathered.select(
        key, *[F.col(f"_all._s{j}").alias(f"samples_{j}") for j in sides], (F.col("_sure") & (F.size("_all") == F.lit(samples))).alias("sure")
    )


def likeness(left: Column, right: Column) -> Column:
    """Share of equal samples, an estimate of the generalised Jaccard similarity; 1 for two texts without words."""
    same = F.aggregate(F.zip_with(left, right, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(left)


def as_text(samples: Column) -> Column:
    """Four hexadecimal digits per sample; ``-`` where the text has no words."""
    return F.array_join(F.transform(samples, lambda x: F.when(x < 0, F.lit("-")).otherwise(F.lpad(F.hex(x), 4, "0"))), "")


def report(docs: DataFrame, depth: float = DEPTH) -> DataFrame:
    """Fingerprints of every text and of its edited form, with the likeness to it and to the next document.

    Documents follow each other by (id, content hash), nulls first; repeated rows (same id and text) are one document whose result
    each of them gets. A null text is empty, a text without words has the empty fingerprint, an empty table gives no rows. Other
    columns are not read.

    The texts are exchanged once, by document, and the borrowed beginnings (a quarter of that) once more; words never leave
    the task that split them.
    """
    held = Staging(docs.sparkSession, "fingerprints")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(row_key(F.col("doc_id"), text).alias("key"), "doc_id", text.alias("text"))
    listed = keyed.select("key", "doc_id", F.length("text").alias("n")).groupBy("key", "doc_id", "n").agg(F.count(F.lit(1)).alias("copies"))
    numbered = held.keep(number_rows(listed, [F.col("doc_id").asc_nulls_first(), F.col("key")], held, "order"), "numbered")
    total = numbered.count()
    following = numbered.select(
        F.col("key").alias("for_key"), F.pmod(F.col("row_no") + 1, F.lit(max(total, 1))).alias("row_no"), F.floor(F.col("n") / 4).cast("int").alias("borrowed")
    )
    links = following.join(numbered.select("row_no", "key"), "row_no")
    texts = keyed.select("key", "text").dropDuplicates(["key"])
    pieces = texts.join(links, "key").select(F.col("for_key").alias("key"), F.left("text", F.col("borrowed")).alias("piece"))
    pairs = texts.join(pieces, "key")
    cut = F.length("text") - F.floor(F.length("text") / 4).cast("int")
    pairs = pairs.select("key", "text", F.concat(F.left("text", cut), F.col("piece")).alias("edited"))
    told = pairs.select("key", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    empty = F.array_repeat(F.lit(-1), SAMPLES)
    found = [F.coalesce("samples_0", empty).alias("own"), F.coalesce("samples_1", empty).alias("edited")]
    quick = sample_near(_words(pairs, cut, depth), "key", ["a", "b"], ["x_a", "x_b"])
    sampled = held.keep(
        told.join(quick, "key", "left").select("key", "n_chars", "edited_sha256", *found, F.coalesce("sure", F.lit(True)).alias("sure")), "samples"
    )
    unsure = sampled.where(~F.col("sure")).select("key")
    if not unsure.isEmpty():
        again = sample(_words(pairs.join(unsure, "key", "left_semi"), cut, depth), "key", ["a", "b"])
        whole = held.keep(unsure.join(again, "key", "left").select("key", *found), "again")
        sampled = sampled.where("sure").drop("sure").unionByName(sampled.drop("own", "edited", "sure").join(whole, "key"))
    after = links.select(F.col("for_key").alias("key"), F.col("key").alias("next_key"))
    likes = (
        sampled.join(after, "key")
        .join(sampled.select(F.col("key").alias("next_key"), F.col("own").alias("next_own")), "next_key")
        .select(
            "key",
            "n_chars",
            "edited_sha256",
            as_text(F.col("own")).alias("fingerprint"),
            as_text(F.col("edited")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("edited")).alias("near_edited"),
            likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        )
    )
    # Each input row gets its document's result; rows are spread before a document that repeats is filled in.
    return numbered.select("key", "doc_id", "copies").join(likes, "key").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("_copy", "key", "copies")


def _words(pairs: DataFrame, cut: Column, depth: float) -> DataFrame:
    """Per (key, word) its counts in the text and in the edited text, which are equal up to ``cut``, and ln(depth / words) of both texts."""
    # What both forms share ends at a separator; the word that the cut runs through belongs to what differs.
    whole = pairs.select("key", "text", "edited", F.left("text", cut).alias("kept"))
    stub = F.length(F.regexp_extract(F.reverse("kept"), f"^{WORD}", 0))
    whole = whole.withColumn("shared", F.length("kept") - stub)
    rest = F.lit(2**31 - 1)
    parts = {"both": F.left("text", F.col("shared")), "own": F.substring("text", F.col("shared") + 1, rest), "other": F.substring("edited", F.col("shared") + 1, rest)}
    split = whole.select("key", *[terms(part).alias(name) for name, part in parts.items()])
    each = split.select("key", *[F.size(name).alias(f"n_{name}") for name in parts], F.posexplode(F.concat(*parts)).alias("at", "word"))
    a, b = F.col("n_both") + F.col("n_own"), F.col("n_both") + F.col("n_other")
    in_a, in_b = F.col("at") < a, (F.col("at") < F.col("n_both")) | (F.col("at") >= a)
    # Limits go through the aggregation: worked out after it, they would be taken again for each sample of a word.
    limits = [F.when(n > 0, F.log(F.lit(depth) / n)).alias(name) for n, name in ((a, "x_a"), (b, "x_b"))]
    counted = each.select("key", "word", in_a.cast("int").alias("a"), in_b.cast("int").alias("b"), *limits).groupBy("key", "word")
    return counted.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("x_a").alias("x_a"), F.max("x_b").alias("x_b"))
