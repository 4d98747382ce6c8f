"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of one character class (hexadecimal digits, or the base64 alphabet in both
spellings). A window slides over it; the counts of its characters are updated by the one that enters and
the one that leaves, and the sum of c * log2(c) over the counts follows. Windows whose entropy is at least the
class's threshold are joined into spans. An allow-list of patterns suppresses candidates that look random but are
not secret: addresses, UUIDs, alphabets in order, marked examples and words without digits.

Everything is a column function: one pass over the text, no shuffle. Entropies are compared as whole numbers
(c * log2(c) in units of 2**-20), so equal counts give equal decisions everywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import SPANS, located, no_spans, spans_text

# The base patterns and the smallest lengths. Looking behind or ahead only skips places where no
# match can start; the matches are those of the plain patterns.
ASSIGN = (
    "(?=[pPsStTaA])(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "(?<![0-9a-f])[0-9a-f]{16,}"
ASSIGN_LEAST = 12

KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]
URL = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D\"'<>]+"
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|abcdefghijklmnop|0123456789abcdef|1234567890",
    r"^[^0-9]*$",
    r"^[0-9]*$",
]


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    alphabet: str
    pattern: str
    window: int
    bits: float


CLASSES = [
    EntropyClass("entropy_hex", "0123456789abcdefABCDEF", "(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", 20, 3.0),
    EntropyClass(
        "entropy_base64",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-",
        "(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{24,}",
        24,
        4.0,
    ),
]


def weight(count: int) -> int:
    return round(count * math.log2(count) * 2**20) if count else 0


def limit(c: EntropyClass) -> int:
    """A window passes when the sum of its weights is at most this."""
    return math.floor(c.window * (math.log2(c.window) - c.bits) * 2**20)


def entropy_spans(symbols: Column, c: EntropyClass, kind: int) -> Column:
    """Spans inside one candidate, from 0: joined windows that pass. ``symbols`` are places in the alphabet."""
    weights = F.array(*[F.lit(weight(i)) for i in range(c.window + 1)])
    size = len(c.alphabet)

    def bump(counts, at, by):
        changed = F.array(F.element_at(counts, at) + F.lit(by))
        return F.concat(F.slice(counts, F.lit(1), at - 1), changed, F.slice(counts, at + 1, F.lit(size)))

    def weigh(count):
        return F.element_at(weights, count + 1)

    def slide(s, i):
        """State before symbol i (from 1): counts and sum of the last window - 1 or fewer symbols."""
        full = i >= c.window
        first = i - c.window  # place of the window's first symbol, from 0
        enters = F.element_at(symbols, i)
        leaves = F.element_at(symbols, F.greatest(first + 1, F.lit(1)))
        was = F.element_at(s["counts"], enters)
        total = s["total"] + weigh(was + 1) - weigh(was)
        had = F.element_at(s["counts"], leaves) + F.when(leaves == enters, 1).otherwise(0)
        grown = bump(s["counts"], enters, 1)
        passes = full & (total <= F.lit(limit(c)))
        joins = passes & (s["until"] >= first)
        ends = passes & ~joins & (s["until"] > 0)
        closed = F.struct(s["since"].alias("start"), F.lit(kind).alias("kind"), s["until"].alias("stop"))
        return F.struct(
            F.when(full, bump(grown, leaves, -1)).otherwise(grown).alias("counts"),
            F.when(full, total + weigh(had - 1) - weigh(had)).otherwise(total).alias("total"),
            F.when(passes & ~joins, first).otherwise(s["since"]).alias("since"),
            F.when(passes, i).otherwise(s["until"]).alias("until"),
            F.when(ends, F.concat(s["found"], F.array(closed))).otherwise(s["found"]).alias("found"),
        )

    def finish(s):
        last = F.struct(s["since"].alias("start"), F.lit(kind).alias("kind"), s["until"].alias("stop"))
        return F.when(s["until"] > 0, F.concat(s["found"], F.array(last))).otherwise(s["found"])

    zero = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"),
        F.lit(0).alias("total"),
        F.lit(0).alias("since"),
        F.lit(0).alias("until"),
        no_spans().alias("found"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.size(symbols)), zero, slide, finish)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``spans`` (array of start, kind, stop; code points, stop exclusive) and ``matched`` texts.

    Kinds are indexes into ``KINDS``. A null or empty text has no spans; repeated rows give repeated results; other
    columns are not read, so their names do not matter. A text's length is not limited: memory is one row.
    """
    patterns = [ASSIGN, ACCESS, HEX] + [f"{URL}|{c.pattern}" for c in CLASSES]
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(patterns)]
    )
    text = F.col("text")

    def long_enough(hit):
        return F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST

    def candidate(hit):
        bad = hit.rlike(f"^{URL}")
        for p in ALLOWED:
            bad = bad | hit.rlike(p)
        return ~bad

    base = [
        located(text, F.col("m0"), ASSIGN, 0, long_enough),
        located(text, F.col("m1"), ACCESS, 1, lambda hit: F.lit(True)),
        located(text, F.col("m2"), HEX, 2, lambda hit: F.lit(True)),
    ]

    def more(at, c):
        tokens = located(text, F.col(f"m{at}"), patterns[at], at, candidate)

        def inside(t):
            token = F.substring(text, t["start"] + 1, t["stop"] - t["start"])
            symbols = F.transform(F.split(token, ""), lambda x: F.instr(F.lit(c.alphabet), x))
            return F.transform(
                F.flatten(F.transform(F.array(symbols), lambda bound: entropy_spans(bound, c, at))),
                lambda s: F.struct(
                    (s["start"] + t["start"]).alias("start"), s["kind"].alias("kind"), (s["stop"] + t["start"]).alias("stop")
                ),
            )

        return F.flatten(F.transform(tokens, inside))

    added = [more(k + len(base), c) for k, c in enumerate(CLASSES)]
    placed = found.select(
        "id", "text", F.array_sort(F.concat(*base, *added).cast(SPANS)).alias("spans")
    )
    return placed.select(
        F.col("id").alias(id_col),
        "spans",
        F.transform("spans", lambda s: F.substring(text, s["start"] + 1, s["stop"] - s["start"])).alias("matched"),
    )


def report(docs: DataFrame) -> DataFrame:
    """The query's digest columns from ``scan``: counts and hash of the base kinds, and all spans."""
    scanned = scan(docs)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return scanned.select(
        F.col("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(base, KINDS), 256).alias("base_sha256"),
        spans_text(F.col("spans"), KINDS).alias("spans"),
        F.size(F.filter("spans", lambda s: s["kind"] >= 3)).cast("long").alias("n_entropy"),
    )
