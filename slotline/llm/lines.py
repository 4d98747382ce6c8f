"""Fuzzy line deduplication by MinHash over character shingles.

Lines are compared in lower case with white space joined. Every distinct line gets minima of hashed character shingles, cut into
bands; lines that agree in a band are compared exactly (Jaccard similarity of the shingle sets, 0.75 or more), and distributed union-find joins
them. One line of every component stays: the first, by document and place.

Recall of the banding for two lines of similarity s is 1 - (1 - s**ROWS)**BANDS: 0.996 at 0.75, 0.9992 at 0.8.
Equal lines need no banding: they are one item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import row_key, unwrapped, wrapped
from slotline.llm.linking import bitmap, distinct, link, listed, mixed, shared_regions
from slotline.session import Staging, free_shuffles

SHINGLE, BANDS, ROWS, PERCENT, SEED = 8, 10, 3, 75, 17
CHUNK = 64_000  # characters hashed at a time; their hashes fit into a core's cache
WRITTEN = 2_000_000  # characters whose lines are handed over at a time

NO_BANDS = np.zeros(0, np.int64)


def normal(line: str) -> str:
    return " ".join(line.split()).lower()


def item_of(line: str) -> int:
    """64-bit content hash of a normalised line."""
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of the lines, and where each line's begin; a shorter line is one shingle."""
    padded = [x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines]
    sizes = np.array([len(x) - SHINGLE + 1 for x in padded])
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    rolled = np.zeros(len(codes) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * np.uint64(1_000_003) + codes[k : len(codes) - SHINGLE + 1 + k]
    starts = np.concatenate([[0], np.cumsum(sizes + SHINGLE - 1)[:-1]])
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(sizes.sum()) + np.repeat(starts - firsts, sizes)
    return mixed(rolled[at]), firsts


def band_keys(lines: list[str]) -> np.ndarray:
    """One row of ``BANDS`` 64-bit keys per line."""
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    hashes, firsts = shingle_hashes(lines)
    least, product = np.empty((BANDS * ROWS, len(lines)), np.uint64), np.empty_like(hashes)
    for k, factor in enumerate(factors):
        np.multiply(hashes, factor, out=product)
        np.minimum.reduceat(product, firsts, out=least[k])
    least >>= np.uint64(32)
    keys = np.empty((len(lines), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(lines), b + 1, np.uint64)
        for r in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[b * ROWS + r])
        keys[:, b] = key
    return keys.view(np.int64)


def in_chunks(lines: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in lines:
        part.append(x)
        size += len(x)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _spread(docs: DataFrame) -> DataFrame:
    """(key, id, place, item, bands) of every line that is not blank; a document without any has one row, at place -1.

    Ids pass through Python as texts, which changes none of them. A line that comes up again in a run of documents has its bands once.
    """
    kind = docs.schema["id"].dataType

    def handed(rows: list[tuple], lines: list[str]) -> pd.DataFrame:
        distinct = list(dict.fromkeys(x for x in lines if x))
        own = dict(zip(distinct, (row for part in in_chunks(distinct) for row in band_keys(part))))
        items = {x: item_of(x) for x in distinct} | {"": 0}
        frame = pd.DataFrame(rows, columns=["key", "id", "place"])
        return frame.assign(id=frame["id"].astype(object), item=[items[x] for x in lines], bands=[own.pop(x, NO_BANDS) for x in lines])

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, lines, size = [], [], 0
        for frame in frames:
            for key, doc, text in zip(frame["key"], frame["id"], frame["text"]):
                before = len(rows)
                for place, line in enumerate((text or "").split("\n")):
                    line = normal(line)
                    if line:
                        rows.append((key, doc, place))
                        lines.append(line)
                        size += len(line)
                    if size >= WRITTEN:
                        yield handed(rows, lines)
                        rows, lines, size, before = [], [], 0, -1
                if len(rows) == before:
                    rows.append((key, doc, -1))
                    lines.append("")
        if rows:
            yield handed(rows, lines)

    named = docs.select("key", F.col("id").cast("string").alias("id"), "text")
    spread = named.mapInPandas(one, "key string, id string, place int, item long, bands array<long>")
    return spread.withColumn("id", F.col("id").cast(kind))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item, text) of wanted lines (key, place, item): the documents that hold one are read again, the others are not sent anywhere."""
    places = wanted.groupBy(F.col("key").alias("_key")).agg(F.collect_list("place").alias("places"))
    picked = docs.join(listed(places), F.col("key") == F.col("_key")).select("text", "places")

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = {}
            for text, places in zip(frame["text"], frame["places"]):
                split = text.split("\n")
                for p in places:
                    line = normal(split[p])
                    found[item_of(line)] = line
            yield pd.DataFrame({"item": np.array(list(found), np.int64), "text": pd.Series(list(found.values()), dtype=object)})

    return picked.mapInPandas(one, "item long, text string").dropDuplicates(["item"])


def sets_of(lines: list[str]) -> list[np.ndarray]:
    sets = []
    for part in in_chunks(lines):
        hashes, firsts = shingle_hashes(part)
        ends = np.append(firsts[1:], len(hashes))
        sets += [distinct(hashes[a:b]).view(np.int64) for a, b in zip(firsts, ends)]
    return sets


def _sketched(texts: DataFrame) -> DataFrame:
    """(item, size, marks) of lines (item, text): size and bitmap of their shingle sets."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, marks = [], []
            for part in in_chunks(frame["text"].tolist()):
                sets = sets_of(part)
                sizes += map(len, sets)
                marks += map(bitmap, sets)
            yield pd.DataFrame({"item": frame["item"], "size": np.array(sizes, np.int32), "marks": marks})

    return texts.mapInPandas(one, "item long, size int, marks binary")


def marked(docs: DataFrame, held: Staging, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, places, kept) of every document: the places of its lines that are not blank, and of those that stay."""
    plain = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = held.keep(_spread(plain), "lines")
    lines = every.filter("place >= 0")
    told = lines.filter(F.size("bands") > 0)
    spread = told.select(F.explode("bands").alias("region"), "item")
    members = held.keep(shared_regions(spread, told.count() * BANDS), "members")
    # Null ids come last, so that a line with a known document is kept rather.
    order = F.struct(F.col("id").isNull().alias("n"), "id", "key", "place")
    firsts = held.keep(lines.groupBy("item").agg(F.min(order).alias("at")), "firsts")
    free_shuffles(docs.sparkSession)
    roots = None
    if not members.isEmpty():
        wanted = firsts.join(members.select("item").distinct(), "item").select("item", "at.key", "at.place")
        texts = held.keep(_texts(plain, held.keep(wanted, "wanted")), "texts")
        sketches = held.keep(_sketched(texts), "sketches")
        roots = link(members, sketches, lambda items: texts.join(items, "item"), sets_of, PERCENT, held)
    if roots is not None:
        rooted = firsts.join(roots.select(F.col("node").alias("item"), "root"), "item", "left")
        firsts = rooted.groupBy(F.coalesce("root", "item").alias("root")).agg(F.min("at").alias("at"))
    # Each component names the place that it keeps; documents, not components, meet in the join.
    kept = firsts.select("at.key", "at.place").groupBy("key").agg(F.collect_list("place").alias("kept"))
    own = every.groupBy("key").agg(F.first("id").alias("id"), F.collect_set(F.when(F.col("place") >= 0, F.col("place"))).alias("places"))
    nothing = F.array().cast("array<int>")
    return own.join(kept, "key", "left").withColumn("kept", F.coalesce("kept", nothing))


def report(docs: DataFrame) -> DataFrame:
    """Per document: its lines that are not blank, those kept, the places (from 0) of those dropped, and what is left of the text.

    Null, empty and blank texts have no lines, and zeros. Repeated rows (same id and text) are one document here, so a line of theirs that is the first of its component stays
    in each of them. Blank lines stay where they are. Other columns are not read.
    """
    held = Staging(docs.sparkSession, "lines")
    dropped = F.array_sort(F.array_except("places", "kept"))
    found = marked(docs, held).withColumn("dropped", dropped)
    return found.select(
        F.col("id").alias("doc_id"), F.size("places").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), "dropped"
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text; documents of which no line is left go, documents that never had one stay.

    ``n_chars``, where there is such a column, follows the new text.
    """
    held = Staging(docs.sparkSession, "lines")
    found = marked(docs, held, id_col, text_col)
    drops = found.select(F.col("key").alias("dropped_key"), F.array_except("places", "kept").alias("drop")).filter(F.size("drop") > 0)
    drops = held.keep(drops, "drops")
    keyed = wrapped(docs, key=row_key(F.col(id_col), F.col(text_col)), text=F.col(text_col))
    small = drops.count() <= 200_000 and drops.agg(F.sum(F.size("drop"))).first()[0] or 0
    joined = keyed.join(F.broadcast(drops) if 0 < small <= 2_000_000 else drops, F.col("key") == F.col("dropped_key"), "left")
    left = F.filter(F.split("text", "\n", -1), lambda line, at: ~F.array_contains(F.col("drop"), at))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    changed = joined.withColumn("left", text).filter(F.col("drop").isNull() | F.col("left").rlike(r"\S"))
    columns = {text_col: F.col("left")}
    if "n_chars" in docs.columns:
        n_chars = F.col("row").getField("n_chars")
        columns["n_chars"] = F.when(F.col("drop").isNull(), n_chars).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return unwrapped(changed, docs, **columns)
