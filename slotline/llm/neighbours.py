"""Approximate nearest neighbours with a forest of hash prefixes.

Vectors are dealt into blocks. In a block every tree keeps the vectors' hash strings (one bit per random
hyperplane) in a sorted array. A query descends in each tree to its longest matching prefix; then all trees ascend
together, one bit at a time, and what shares the shorter prefix joins the candidates, until there are enough. Candidates are compared by
exact cosine. The best of all blocks are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotline.session import Staging

TREES, BITS, SEED = 32, 48, 5
BLOCK = 16_384
SHARE = 0.7  # candidates asked for, as a share of a block; more come when a prefix holds more
BEST = 5


def hyperplanes(width: int, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(width, trees * bits)).astype("float32")


def codes(vectors: np.ndarray, planes: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """Hash strings as integers, first bit highest: one row per tree."""
    signs = (vectors.astype("float32") @ planes > 0).reshape(len(vectors), trees, bits)
    powers = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    return np.ascontiguousarray((signs @ powers).T)


class Forest:
    """Sorted hash strings of one block of unit vectors."""

    def __init__(self, unit: np.ndarray, trees: int = TREES, bits: int = BITS) -> None:
        self.trees, self.bits, self.rows = trees, bits, len(unit)
        self.planes = hyperplanes(unit.shape[1], trees, bits)
        own = codes(unit, self.planes, trees, bits)
        self.order = np.argsort(own, axis=1, kind="stable")
        self.sorted = np.take_along_axis(own, self.order, axis=1)

    def ranges(self, asked: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end place, per tree and query, of the strings that share ``depth`` leading bits."""
        shift = self.bits - depth
        low = (asked >> shift) << shift
        high = low + (np.int64(1) << shift)
        first = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, low)])
        end = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, high)])
        return first, end

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """Per query a mask over the block: what the trees hold at the deepest common depth with ``wanted`` rows."""
        asked = codes(queries, self.planes, self.trees, self.bits)
        wanted = min(wanted, self.rows)
        masks = np.zeros((len(queries), self.rows), bool)
        open_ = np.arange(len(queries))
        for depth in range(self.bits, -1, -1):
            first, end = self.ranges(asked[:, open_], depth)
            # Distinct candidates cannot be more than the ranges together, so nothing is marked before that suffices.
            reach = np.minimum((end - first).sum(axis=0), self.rows) >= wanted
            for k in np.flatnonzero(reach):
                q = open_[k]
                for t in range(self.trees):
                    masks[q, self.order[t, first[t, k] : end[t, k]]] = True
            enough = np.zeros(len(open_), bool)
            enough[reach] = masks[open_[reach]].sum(axis=1) >= wanted
            open_ = open_[~enough]
            if not len(open_):
                break
        yield from masks


def _array(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def search(
    vectors: DataFrame, queries: DataFrame, best: int = BEST, share: float = SHARE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per row of ``queries`` its ``best`` nearest rows of ``vectors`` found: query_id, rank, vec_id, score.

    Nulls, zero vectors and vectors that hold null or non-finite components take no part, and a query never finds the rows of its own id. Equal
    vectors are searched once: each class carries its ids in order, as many as an answer can hold, which is exact. Ties go to the smaller
    id. Only vectors of equal width are compared. Repeated rows (same id, same vector) count once; empty tables give no rows.
    """
    held = Staging(vectors.sparkSession, "neighbours")
    components = F.col("vector")

    def usable(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        good = F.forall(components, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        return df.filter(F.col("id").isNotNull() & components.isNotNull() & good & F.exists(components, lambda x: x != 0)).distinct()

    # Map-side: a class keeps its smallest ids, one more than an answer holds since the query's own may be among them.
    listed = usable(vectors)
    salted = listed.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = Window.partitionBy("vector", "_salt").orderBy("id")
    cut = salted.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= best + 1)
    classes = cut.groupBy("vector").agg(F.slice(F.array_sort(F.collect_set("id")), 1, best + 1).alias("ids"))
    classes = held.keep(classes, "classes")
    asked = held.keep(usable(queries).groupBy("vector").agg(F.collect_set("id").alias("ids")), "asked")
    blocks = max(1, -(-classes.count() // block))
    rows = classes.select(
        F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int").alias("block"), F.size("vector").alias("width"), "vector", "ids", F.lit(False).alias("query")
    )
    questions = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.size("vector").alias("width"), "vector", "ids", F.lit(True).alias("query")
    )

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own, ask = frame[~frame["query"]], frame[frame["query"]]
        out: list[tuple] = []
        if len(own) and len(ask):
            base, wanted = _array(own["vector"]), _array(ask["vector"])
            norms = np.sqrt((base * base).sum(axis=1))
            unit = base / norms[:, None]
            lengths = np.sqrt((wanted * wanted).sum(axis=1))
            forest = Forest(unit)
            ids, asks = own["ids"].tolist(), ask["ids"].tolist()
            for lo in range(0, len(wanted), 256):
                part = wanted[lo : lo + 256]
                masks = forest.candidates(part / lengths[lo : lo + 256, None], max(best + 1, int(share * len(base))))
                for k, mask in enumerate(masks, lo):
                    at = np.flatnonzero(mask)
                    near = unit[at] @ (wanted[k] / lengths[k])
                    keep = at[near >= np.partition(near, -min(len(at), best + 1))[-min(len(at), best + 1)] - 1e-9]
                    dots = (base[keep] * wanted[k]).sum(axis=1) / (norms[keep] * lengths[k])
                    for q in asks[k]:
                        found = sorted((-s, i) for s, c in zip(dots.tolist(), keep) for i in ids[c] if i != q)[:best]
                        out.extend((q, i, -s) for s, i in found)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    told = rows.unionByName(questions).groupBy("block", "width").applyInPandas(answer, "query_id long, vec_id long, score double")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id"))
    ranked = told.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(last))
    return ranked.filter(F.col("rank") <= best).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
