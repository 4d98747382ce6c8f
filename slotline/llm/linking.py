"""Links between sets that are alike, found region by region, and the connected components they form.

A region is a group of items that share a key (a shingle, a band). Regions with the same members are one. What moves grows with the memberships, never with
the pairs: members meet once in a region, each with a bitmap of its set, and tasks rule out by bitmaps which of them can be alike. Those that can be are connected to clusters,
one row per item, and only their texts move, once, to where their cluster is settled exactly.

There items are pivots in turn. A pivot's exact distances to the members that are not connected yet come from one pass over their elements; those near enough are
connected and become pivots next, so a group of copies takes one pass. Jaccard distance is a metric, so two items whose distances to an earlier
pivot differ by more than the threshold are no link: only the ring around a pivot is compared with it.

Groups beyond ``CELL`` members are cut into chunks. Each chunk, with a few members that all of them have, is connected by itself first; then only what is outside the largest component
of a group meets the other chunks, so a large group of copies is dealt once, not squared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.session import Staging

FEW = 500_000  # links that one task may join
LEAST_BITS, MOST_BITS = 128, 1 << 16  # of a bitmap; larger sets than that may meet in vain
CELL = 2048  # members of a chunk; a task compares those of one or two
LOAD = 500_000  # characters of a chunk
COMMON = 16  # members, at most about, that all chunks of a group have in common
SMALL = 24  # members of a group whose pairs are listed at once with those of other groups
PIVOTS = 3  # pivots whose distances are kept as rings
BLOCK = 1 << 16  # pairs whose bitmaps are compared at once
PART = 500_000  # memberships that one task sorts
SHORT = 200_000  # rows of a list that is broadcast


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The values of ``x``, sorted, each once; for short arrays this takes a fraction of the time of ``np.unique``."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of links (a, b) and the smallest node that each is connected with, by minima and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(links: DataFrame, held: Staging, name: str, few: int = FEW) -> DataFrame:
    """(node, root) for every node of links (a, b): the smallest node that it is connected with.

    Large-star and small-star steps in turn; each shortens all paths, and every step is a grouped minimum and a join. Links of
    a bounded number (``few``) are joined by one task instead, with the same result.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = held.keep(edges.distinct(), f"{name}edges")
    if edges.limit(few + 1).count() <= few:

        def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [(f["a"].to_numpy(), f["b"].to_numpy()) for f in frames if len(f)]
            if parts:
                nodes, root = _roots(*(np.concatenate(x) for x in zip(*parts)))
                yield pd.DataFrame({"node": nodes, "root": root})

        return edges.coalesce(1).mapInPandas(one, "node long, root long")
    before, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = held.keep(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}{turn}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, turn = now, turn + 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def listed(rows: DataFrame) -> DataFrame:
    """``rows`` for a join: broadcast when they are few by count, else left to a shuffle."""
    return F.broadcast(rows) if rows.limit(SHORT + 1).count() <= SHORT else rows


def shared_regions(spread: DataFrame, rows: int) -> DataFrame:
    """(group, item), distinct, of the regions of ``spread`` (region, item; about ``rows`` of them) that hold more than one item.

    Alike items share many regions, and regions with the same members ask for the same pairs: a group is named by a hash of its members, so
    these become one. Two different groups under one name would be one larger group, which loses nothing.
    """

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(f["region"].to_numpy(), f["item"].to_numpy()) for f in frames if len(f)]
        if not parts:
            return
        region, item = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.argsort(region)
        region, item = region[order], item[order]
        again = region[1:] == region[:-1]
        several = np.append(again, False) | np.append(False, again)
        region, item = region[several], item[several]
        order = np.lexsort((item, region))
        region, item = region[order], item[order]
        first = np.append(True, (region[1:] != region[:-1]) | (item[1:] != item[:-1]))[: len(region)]
        region, item = region[first], item[first]
        if not len(region):
            return
        starts = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        counts = np.diff(np.append(starts, len(region)))
        names = mixed(np.add.reduceat(mixed(item.view(np.uint64)), starts) + counts.astype(np.uint64)).view(np.int64)
        wanted = np.zeros(len(starts), bool)
        wanted[np.unique(names, return_index=True)[1]] = True
        wanted = np.repeat(wanted & (counts > 1), counts)
        yield pd.DataFrame({"group": np.repeat(names, counts)[wanted], "item": item[wanted]})

    return spread.select("region", "item").repartition(rows // PART + 1, "region").mapInPandas(one, "group long, item long").distinct()


def bitmap(elements: np.ndarray) -> bytes:
    """Bits in which each element marks one: a power of two of them, at least the elements up to ``MOST_BITS``."""
    width = min(max(LEAST_BITS, 1 << (len(elements) - 1).bit_length()), MOST_BITS)
    bits = np.zeros(width, bool)
    bits[elements.view(np.uint64) % np.uint64(width)] = True
    return np.packbits(bits).tobytes()


class Bitmaps:
    """Sizes and bitmaps of sets, and which pairs of them can be alike.

    Every bit that only one of two sets marks stands for an element the other lacks, so they share at most
    their size less those bits: no pair that is alike enough is ruled out. Of bitmaps of different width the wider is folded.
    """

    def __init__(self, sizes: np.ndarray, marks: list[bytes], percent: int) -> None:
        self.sizes, self.percent = sizes.astype(np.int64), percent
        self.widths = np.fromiter(map(len, marks), np.int64, len(marks)) // 8
        self.at, self.rows = {}, {}
        wider, rows = np.zeros(0, np.int64), None
        for w in np.unique(self.widths)[::-1].tolist():
            own = np.flatnonzero(self.widths == w)
            found = np.frombuffer(b"".join([marks[k] for k in own]), np.uint64).reshape(-1, w)
            if rows is not None:
                found = np.concatenate([found, np.bitwise_or.reduce(rows.reshape(len(rows), -1, w), axis=1)])
            wider, rows = np.concatenate([own, wider]), found
            self.at[w] = np.zeros(len(marks), np.int64)
            self.at[w][wider] = np.arange(len(wider))
            self.rows[w] = rows

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, m = self.sizes[i], self.sizes[j]
        out = np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent
        width = np.minimum(self.widths[i], self.widths[j])
        for w in np.unique(width[out]).tolist():
            here = np.flatnonzero(out & (width == w))
            at, rows = self.at[w], self.rows[w]
            for k in range(0, len(here), BLOCK):
                some = here[k : k + BLOCK]
                x, y = rows[at[i[some]]], rows[at[j[some]]]
                both = x & y
                alone = [np.bitwise_count(z ^ both).sum(axis=1, dtype=np.int64) for z in (x, y)]
                most = np.minimum(n[some] - alone[0], m[some] - alone[1])
                out[some] = most * 100 >= (n[some] + m[some] - most) * self.percent
        return out


def connected(roots: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Per member one that it is connected with. ``near`` tells which others a member reaches; members with equal ``roots`` are connected already."""
    out, rest = np.zeros(len(roots), np.int64), np.arange(len(roots))
    while len(rest):
        first = rest[0]
        here = roots[rest] == roots[first]
        queue, rest = [rest[here]], rest[~here]
        out[queue[0]] = first
        while queue:
            for p in queue.pop():
                if not len(rest):
                    return out
                hit = near(p, rest)
                if hit.any():
                    here = np.isin(roots[rest], roots[rest[hit]])
                    out[rest[here]] = first
                    queue.append(rest[here])
                    rest = rest[~here]
    return out


def whole_cells(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by ``cell``, a few whole cells at a time, and where each begins and the last ends."""

    def told(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        cell = rows["cell"].to_numpy()
        return rows, np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])

    kept: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        cell = frame["cell"].to_numpy()
        if kept and kept[-1]["cell"].iloc[-1] != cell[-1] or cell[0] != cell[-1]:
            end = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
            yield told([*kept, frame.iloc[:end]] if end else kept)
            kept = []
            frame = frame.iloc[end:]
        kept.append(frame)
    if kept:
        yield told(kept)


def as_links(a: list[np.ndarray], b: list[np.ndarray]) -> pd.DataFrame:
    """Links (a, b), as few as connect the same."""
    nodes, roots = _roots(np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)]))
    return pd.DataFrame({"a": nodes[nodes != roots], "b": roots[nodes != roots]})


def by_bitmaps(percent: int):
    """Links of cells of (cell, item, root, size, marks) between those that can be alike."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, ends in whole_cells(frames):
            item, root = rows["item"].to_numpy(), rows["root"].to_numpy()
            maps = Bitmaps(rows["size"].to_numpy(), rows["marks"].tolist(), percent)
            starts, counts = ends[:-1], np.diff(ends)
            a, b = [], []
            for n in np.unique(counts[(counts > 1) & (counts <= SMALL)]).tolist():
                low, high = np.triu_indices(n, 1)
                i, j = (np.add.outer(starts[counts == n], k).ravel() for k in (low, high))
                hit = maps.possible(i, j)
                a.append(item[i[hit]])
                b.append(item[j[hit]])
            for start, n in zip(starts[counts > SMALL], counts[counts > SMALL]):
                found = connected(root[start : start + n], lambda p, rest: maps.possible(np.full(len(rest), start + p), start + rest))
                a.append(item[start : start + n])
                b.append(item[start + found])
            yield as_links(a, b)

    return one


class Ring:
    """Sets of one cell; ``near`` tells which of ``rest`` a pivot is linked with."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.lengths = np.fromiter(map(len, sets), np.int64, len(sets))
        self.starts = np.cumsum(self.lengths) - self.lengths
        known, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.mine = np.zeros(len(known), bool)
        self.percent, self.epsilon, self.away = percent, 1 - percent / 100, []

    def near(self, pivot: int, rest: np.ndarray) -> np.ndarray:
        n, m = self.lengths[pivot], self.lengths[rest]
        out = np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent
        for far in self.away:
            # Unknown distances (nan) rule nothing out.
            out &= ~(np.abs(far[rest] - far[pivot]) > self.epsilon + 1e-6)
        asked = rest[out]
        if not len(asked):
            return out
        lengths = m[out]
        before = np.cumsum(lengths) - lengths
        own = self.codes[self.starts[pivot] : self.starts[pivot] + n]
        self.mine[own] = True
        at = np.arange(lengths.sum()) + np.repeat(self.starts[asked] - before, lengths)
        shared = np.add.reduceat(self.mine[self.codes[at]], before, dtype=np.int64)
        self.mine[own] = False
        together = n + lengths - shared
        if len(self.away) < PIVOTS:
            far = np.full(len(self.lengths), np.nan)
            far[asked], far[pivot] = 1 - shared / together, 0.0
            self.away.append(far)
        out[out] = shared * 100 >= together * self.percent
        return out


def by_sets(sets_of: Callable[[list[str]], list[np.ndarray]], percent: int):
    """Links of cells of (cell, item, root, text) between those whose sets of elements, none empty, are alike."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, ends in whole_cells(frames):
            item, root = rows["item"].to_numpy(), rows["root"].to_numpy()
            a, b = [], []
            for start, end in zip(ends[:-1], ends[1:]):
                if end - start > 1:
                    found = connected(root[start:end], Ring(sets_of(rows["text"].iloc[start:end].tolist()), percent).near)
                    a.append(item[start:end])
                    b.append(item[start + found])
            yield as_links(a, b)

    return one


def _chunks(n: str, load: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / CELL), F.ceil(F.col(load) / LOAD), F.lit(1)).cast("int")


def linked(members: DataFrame, payload: DataFrame, compare, held: Staging, name: str) -> DataFrame:
    """(node, root) of the items that ``compare`` connects in their groups.

    ``members`` has distinct rows (group, item, load), ``payload`` what ``compare`` reads, one row per item.
    """

    def met(cells: DataFrame) -> DataFrame:
        placed = cells.join(payload, "item").repartition("cell").sortWithinPartitions("cell")
        return placed.mapInPandas(compare, "a long, b long")

    def labelled(links: DataFrame, turn: str) -> DataFrame:
        out = held.keep(components(links, held, f"{name}{turn}-"), f"{name}labels{turn}")
        held.drop(*[x for x in held.paths if x.startswith(f"{name}{turn}-")])
        return out

    sized = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("l"))
    large = held.keep(sized.select("group", "n", _chunks("n", "l").alias("chunks")).filter("chunks > 1"), f"{name}large")
    # A few members of a large group, fewer than a chunk's own, are in each of its chunks, which connects copies across the chunks.
    common = F.coalesce(F.pmod(F.xxhash64("item", F.lit(2)), F.col("n")) < F.least(F.lit(COMMON), F.col("n") / (4 * F.col("chunks"))), F.lit(False))
    chunk = F.pmod(F.xxhash64("item"), F.coalesce("chunks", F.lit(1))).cast("int")
    chunks = F.when(common, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))
    cells = members.join(listed(large), "group", "left").withColumn("chunk", F.explode(chunks))
    cells = cells.select("item", F.col("item").alias("root"), F.xxhash64("group", "chunk").alias("cell"))
    labels = labelled(met(cells), "1")
    if large.isEmpty():
        return labels
    # Groups of several chunks: what is outside the largest component meets all chunks.
    again = members.join(listed(large.select("group")), "group").join(labels.withColumnRenamed("node", "item"), "item", "left")
    again = held.keep(again.withColumn("root", F.coalesce("root", "item")), f"{name}again")
    tally = again.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("l"))
    ends = tally.groupBy("group").agg(F.max(F.struct("n", "l", "root")).alias("most"), F.sum("n").alias("n"), F.sum("l").alias("l"))
    ends = ends.select("group", F.col("most.root").alias("main"), F.col("most.n").alias("n1"), F.col("most.l").alias("l1"), (F.col("n") - F.col("most.n")).alias("n2"), (F.col("l") - F.col("most.l")).alias("l2"))
    ends = ends.filter("n2 > 0").select("group", "main", _chunks("n1", "l1").alias("c1"), _chunks("n2", "l2").alias("c2"))
    placed = again.join(listed(held.keep(ends, f"{name}ends")), "group").withColumn("inside", F.col("root") == F.col("main"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("item", F.lit(1)), F.when(F.col("inside"), F.col("c1")).otherwise(F.col("c2"))).cast("int"))

    def cell(kind: int, x: Column, y: Column) -> Column:
        return F.xxhash64("group", F.lit(kind), x, y)

    def upto(count: str) -> Column:
        return F.sequence(F.lit(0), F.col(count) - 1)

    outside = F.transform(upto("c1"), lambda k: cell(0, k, F.col("chunk")))
    others = F.transform(F.filter(upto("c2"), lambda k: k != F.col("chunk")), lambda k: cell(1, F.least(k, F.col("chunk")), F.greatest(k, F.col("chunk"))))
    own = F.transform(upto("c2"), lambda k: cell(0, F.col("chunk"), k))
    cells = placed.select("item", "root", F.explode(F.when(F.col("inside"), own).otherwise(F.concat(outside, others))).alias("cell"))
    known = labels.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return labelled(met(cells).unionByName(known), "2")


def link(members: DataFrame, sketches: DataFrame, texts_of, sets_of, percent: int, held: Staging) -> DataFrame:
    """(node, root) of all items that are linked: those that share a group of ``members`` (group, item) and are alike, to ``percent`` at least.

    ``sketches`` has (item, size, marks) of every member, ``texts_of`` gives (item, text) for items, ``sets_of`` the distinct elements of texts.
    """
    clusters = linked(members.withColumn("load", F.lit(0)), sketches, by_bitmaps(percent), held, "near")
    texts = held.keep(texts_of(clusters.select(F.col("node").alias("item"))), "clustered")
    told = clusters.select(F.col("root").alias("group"), F.col("node").alias("item"))
    told = told.join(texts.select("item", F.length("text").cast("long").alias("load")), "item")
    return linked(told, texts, by_sets(sets_of, percent), held, "links")
