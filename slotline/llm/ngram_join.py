"""Exact Jaccard join of documents by word shingles, as a metric-space join.

Level one: every shingle is a pivot (the set that holds it alone). A document lies equally near to all its shingles; a fixed order of
pivots breaks the tie, so its Voronoi region is that of its first shingle. The triangle inequality tells how far a partner's region
can be: with at least 75 % in common, two documents share one of their first n - ceil(0.75 n) + 1 shingles, so replicating a document to the
regions of these keeps every pair together. The order puts shingles that are frequent in a sample last, which keeps regions small; any order is exact.

Level two: bitmaps connect the members of a region that can be alike to clusters (``linking``); inside a cluster documents are pivots, and rings of
their exact distances are the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import unwrapped, wrapped
from slotline.llm.linking import bitmap, distinct, link, listed, mixed, shared_regions
from slotline.session import Staging, free_shuffles

WORDS, PERCENT = 5, 75
SAMPLE, SEEN, FREQUENT = 16, 3, 200_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_KEPT = 150_000


class WordHashes(dict):
    """64-bit hashes of words; emptied when full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a whole text (lower case A-Z; words between ASCII white space)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        # The count of words keeps short sequences apart from each other and from whole shingles.
        total = (h * _MULTIPLIERS[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))
        return mixed(np.array([total])).view(np.int64)
    total = np.zeros(len(h) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        total += h[k : len(h) - WORDS + 1 + k] * _MULTIPLIERS[k]
    return distinct(mixed(total)).view(np.int64)


def digest(elements: np.ndarray) -> int:
    """64-bit content hash of a set, the item of all documents with that set."""
    return int(np.array([xxhash.xxh3_64_intdigest(np.sort(elements).tobytes())], np.uint64).view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _summaries(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(id, content, size, item, prefix, marks) per row; ``frequent`` holds sample-frequent shingles, the most frequent last.

    Ids pass through Python as texts, which changes none of them.
    """
    known = np.argsort(frequent)
    ordered = frequent[known]
    kind = docs.schema["id"].dataType

    def rank(elements: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ordered, elements)
        hit = (at < len(ordered)) & (ordered[np.minimum(at, max(len(ordered) - 1, 0))] == elements) if len(ordered) else np.zeros(len(elements), bool)
        return np.where(hit, known[np.minimum(at, max(len(ordered) - 1, 0))] + 1 if len(ordered) else 0, 0)

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            sizes, items, prefixes, marks = [], [], [], []
            for text in frame["text"]:
                s = shingles(text, hashes)
                sizes.append(len(s))
                items.append(digest(s))
                prefixes.append(s[np.lexsort((s, rank(s)))][: prefix_length(len(s))] if len(s) else s)
                marks.append(bitmap(s) if len(s) else b"")
            yield pd.DataFrame({"id": frame["id"], "content": frame["content"], "marks": marks, "size": np.array(sizes, np.int32), "item": np.array(items, np.int64), "prefix": prefixes})

    schema = "id string, content long, size int, item long, prefix array<long>, marks binary"
    named = docs.select(F.col("id").cast("string").alias("id"), "text", F.xxhash64("text").alias("content"))
    return named.mapInPandas(one, schema).withColumn("id", F.col("id").cast(kind))


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles of one row in ``SAMPLE`` that come up ``SEEN`` times or more, rarest first, at most ``FREQUENT``.

    Only the order of pivots depends on this; a shingle that it misses costs time, never a link.
    """

    def all_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for frame in frames:
            found = [shingles(t, hashes) for t in frame["text"]]
            yield pd.DataFrame({"shingle": np.concatenate(found) if found else np.zeros(0, np.int64)})

    part = docs.filter(F.pmod(F.xxhash64("id", F.length("text")), F.lit(SAMPLE)) == 0).select("text")
    counted = part.mapInPandas(all_of, "shingle long").groupBy("shingle").count().filter(F.col("count") >= SEEN)
    top = counted.orderBy(F.desc("count"), "shingle").limit(FREQUENT).collect()
    return np.array([r["shingle"] for r in reversed(top)], np.int64)


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(item, text) of the ``chosen`` (item, id, content); only these texts leave the scan."""
    wanted = chosen.select("item", F.col("id").alias("_id"), F.col("content").alias("_content"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_content"))
    return docs.join(listed(wanted), same).select("item", "text").dropDuplicates(["item"])


def _sets_of(texts: list[str]) -> list[np.ndarray]:
    hashes = WordHashes()
    return [shingles(t, hashes) for t in texts]


def classes(docs: DataFrame, held: Staging, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, item (its set) and root (its component, as an item; null without words)."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = held.keep(_summaries(plain, _frequent(plain)), "summaries")
    told = held.keep(rows.select("id", F.col("size").cast("long").alias("n_shingles"), "item"), "rows")
    # Copies of a set fall together in the grouped minimum; from here on sets are worked on, not rows.
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "content")).alias("at")
    own = [F.first(c).alias(c) for c in ("marks", "prefix")]
    one = held.keep(rows.filter("size > 0").groupBy("item").agg(first, F.min("size").alias("size"), *own), "sets")
    held.drop("summaries")
    chosen = one.select("item", "at.id", "at.content")

    def texts_of(items: DataFrame) -> DataFrame:
        return _texts(plain, chosen.join(items, "item"))

    prefixes = one.agg(F.sum(F.size("prefix"))).first()[0] or 0
    members = held.keep(shared_regions(one.select(F.explode("prefix").alias("region"), "item"), prefixes), "members")
    free_shuffles(docs.sparkSession)
    if members.isEmpty():
        return told.withColumn("root", F.when(F.col("n_shingles") > 0, F.col("item")))
    roots = link(members, one.select("item", "size", "marks"), texts_of, _sets_of, percent, held)
    joined = told.join(roots.select(F.col("node").alias("item"), "root"), "item", "left")
    return joined.withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "item")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id that links reach.

    Rows without words are linked with nothing and are their own component, also with a null id; null ids take part but are never the
    smallest unless all of a component are null; repeated rows are equal texts. Other columns are not read.
    """
    held = Staging(docs.sparkSession, "ngrams")
    found = held.keep(classes(docs, held, id_col, text_col), "classes")
    smallest = found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least"))
    named = found.join(smallest, "root", "left")
    return named.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of every component; of repeated rows one. Rows without words stay."""
    held = Staging(docs.sparkSession, "ngrams")
    found = held.keep(classes(docs, held, id_col, text_col), "classes")
    linked = found.filter(F.col("root").isNotNull())
    smallest = linked.groupBy("root").agg(F.min("id").alias("least"))
    gone = held.keep(linked.join(smallest, "root").filter(~F.col("id").eqNullSafe(F.col("least"))).select(F.col("id").alias("gone")).distinct(), "gone")
    # The smallest id itself may come up in several rows; only then are whole rows compared.
    again = linked.join(gone.withColumnRenamed("gone", "id"), "id", "left_anti").groupBy("root").count().filter("count > 1").isEmpty()
    rows = wrapped(docs, id=F.col(id_col))
    kept = rows.join(F.broadcast(gone) if gone.count() <= 200_000 else gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti")
    return unwrapped(kept if again else kept.dropDuplicates(["id"]), docs)
