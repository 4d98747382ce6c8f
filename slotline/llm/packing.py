"""Best-fit packing of tokenised documents by swap-based local search.

Documents are tokenised where they lie; from then on only (document, piece, length) rows move. Pieces are packed in
groups of bounded size: best fit, longest first, then a local search among underfull bins. A fuller bin takes a piece from an
emptier one, or exchanges one for one or two for one with it; each step raises the sum of squared fills, so that bins
empty, and it goes on until no bin can be saved or no step is left. Bins that stay underfull are dissolved with a few full ones, and their pieces meet those of other groups
in the next level, until one group is left or a level no longer helps.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotline.session import Staging

CAPACITY, GROUP = 4096, 4096
UNDERFULL = 128  # a bin with at least this part of the capacity free is packed again on the next level
WIDER = 16  # times that a group grows over the levels, by two each
REOPENED = 3  # full bins that go on to the next level with each underfull one
STUCK = 0.98  # the levels end when hardly a piece found its place in the last one
END = 1
PARTNERS = 12
WORDS_KEPT, LONGEST_KEPT = 200_000, 64

#: Letters that composition leaves alone and that have one lower case, then marks that the tokenizer keeps apart from letters.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?|#$%&*()\"-]*)")


class Words(dict):
    """Token ids of white-space separated words as little-endian bytes.

    The tokenizer never joins text across a space or a line break, so a text's ids are those of its words, one after the other.
    Words seen once wait in ``rare``; the second time they move here. Each table is emptied when it is full, so memory is bounded
    whatever the vocabulary, and a flood of rare words does not wash out the frequent ones. A plain word with marks behind it is looked up
    as the word and the marks, in lower case, which is how the tokenizer parts it. A plain word in lower case is asked of the tokenizer's model
    directly, in the letters that the model knows, where that is found to be all that the tokenizer does.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self[""] = b""
        self.rare: dict[str, bytes] = {}
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.parts = tokenizer.encode, tokenizer.model.tokenize
        self.spelled = self.spelling(tokenizer)

    def spelling(self, tokenizer) -> dict[int, str] | None:
        """Every plain letter as the model is given it, or None if the tokenizer does more to plain words than that."""
        if tokenizer.pre_tokenizer is None:
            return None
        given = {c: tokenizer.pre_tokenizer.pre_tokenize_str(c) for c in _LETTERS}
        if any(len(pieces) != 1 for pieces in given.values()):
            return None
        spelled = {ord(c): pieces[0][0] for c, pieces in given.items()}
        trials = [*_LETTERS, _LETTERS, _LETTERS[::-1], *(a + b for a in _LETTERS for b in "aeßé")]
        same = all(self.encode(t, add_special_tokens=False).ids == [x.id for x in self.parts(t.translate(spelled))] for t in trials)
        return spelled if same else None

    def __missing__(self, word: str) -> bytes:
        ids = self.rare.pop(word, None)
        if ids is not None:
            if len(self) >= WORDS_KEPT:
                self.clear()
                self[""] = b""
            self[word] = ids
            return ids
        simple = _SIMPLE.fullmatch(word)
        if simple and (simple[2] or not word.islower()):
            ids = self[simple[1].lower()] + self[simple[2]]
        elif simple and self.spelled:
            ids = np.array([x.id for x in self.parts(word.translate(self.spelled))], "<u4").tobytes()
        else:
            ids = np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self.rare) >= WORDS_KEPT:
                self.rare.clear()
            self.rare[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        spaced = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return b"".join(map(self.__getitem__, spaced.split(" ")))


@lru_cache(2)
def words_of(path: str) -> Words:
    """The table of this worker process, which serves many tasks."""
    return Words(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: uid, doc_id, piece, start, length, ids_crc32. A null text is empty: only the end id.

    ``vocabulary`` is the tokenizer file; by default every task asks the installed vocabularies for it.
    """
    kind = docs.schema[id_col].dataType

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = words_of(vocabulary or default_vocabulary())
        end = END.to_bytes(4, "little")
        step = 4 * capacity
        for frame in frames:
            rows = []
            for uid, doc, text in zip(frame["uid"], frame["doc_id"], frame["text"]):
                ids = words.ids(text or "") + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    rows.append((uid, doc, k // step, k // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["uid", "doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": object})

    # Ids pass through Python as texts, which changes none of them.
    named = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    cut_up = named.mapInPandas(cut, "uid long, doc_id string, piece int, start long, length long, ids_crc32 long")
    return cut_up.withColumn("doc_id", F.col("doc_id").cast(kind))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that still has room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect_left(rooms, (n, -1))
        if at == len(rooms):
            bins.append([int(i)])
            room, b = capacity - n, len(bins) - 1
        else:
            room, b = rooms.pop(at)
            bins[b].append(int(i))
            room -= n
        if room:
            insort(rooms, (room, b))
    return bins


def _exchange(a: np.ndarray, b: np.ndarray, room: int) -> tuple[int, list[int], list[int]]:
    """Best step that fills ``b`` by at most ``room`` from ``a``: (gain, places in a that go, places in b that come)."""
    best = (0, [], [])
    fits = np.flatnonzero(a <= room)
    if len(fits):
        i = fits[np.argmax(a[fits])]
        best = (int(a[i]), [int(i)], [])
    if len(b) and best[0] < room:
        gain = a[:, None] - b[None, :]
        gain = np.where((gain > best[0]) & (gain <= room), gain, 0)
        if gain.any():
            i, j = np.unravel_index(np.argmax(gain), gain.shape)
            best = (int(gain[i, j]), [int(i)], [int(j)])
    if len(a) > 1 and len(b) and best[0] < room:
        p, q = np.triu_indices(len(a), 1)
        gain = (a[p] + a[q])[:, None] - b[None, :]
        gain = np.where((gain > best[0]) & (gain <= room), gain, 0)
        if gain.any():
            i, j = np.unravel_index(np.argmax(gain), gain.shape)
            best = (int(gain[i, j]), [int(p[i]), int(q[i])], [int(j)])
    return best


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, enough: int = 1) -> list[list[int]]:
    """Exchange between underfull bins while that raises the sum of squared fills, until the fewest bins possible are left.

    Every fuller bin meets the emptiest ones and those just below it (``PARTNERS`` of each kind) in a pass; where such a pass finds no step, one
    in which every bin meets all emptier ones with ``enough`` room follows, and the search ends when that finds none either.
    """
    least = -(-int(lengths.sum()) // capacity)
    held = [np.array(b) for b in bins]
    fill = [int(lengths[b].sum()) for b in held]
    alive = len(held)
    moved, thorough = True, False
    while (moved or not thorough) and alive > least:
        thorough = not moved
        moved = False
        order = sorted((b for b in range(len(held)) if 0 < fill[b] < capacity), key=lambda b: fill[b])
        for place in range(len(order) - 1, 0, -1):
            target = order[place]
            below = order[:place]
            for victim in [b for b in below if capacity - fill[b] >= enough] if thorough else dict.fromkeys(below[:PARTNERS] + below[-PARTNERS:]):
                while 0 < fill[victim] <= fill[target] < capacity:
                    a, b = held[victim], held[target]
                    gain, out, into = _exchange(lengths[a], lengths[b], capacity - fill[target])
                    if not gain:
                        break
                    held[victim] = np.concatenate([np.delete(a, out), b[into]])
                    held[target] = np.concatenate([np.delete(b, into), a[out]])
                    fill[victim] -= gain
                    fill[target] += gain
                    alive -= fill[victim] == 0
                    moved = True
                if fill[target] == capacity or alive == least:
                    break
            if alive == least:
                break
    return [b.tolist() for b in held if len(b)]


def fill_bins(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity, max(1, capacity // UNDERFULL))


def pack(rows: DataFrame, held: Staging, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Sequence and offset of every piece, from rows (uid, piece, length) with unique (uid, piece)."""
    schema = "uid long, piece int, length long, grp long, bin int, offset long, again boolean"
    enough = max(1, capacity // UNDERFULL)

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = frame["length"].to_numpy()
        number, offset, again = np.zeros(len(frame), np.int32), np.zeros(len(frame), np.int64), np.zeros(len(frame), bool)
        bins = [np.array(b) for b in fill_bins(lengths, capacity)]
        for k, at in enumerate(bins):
            number[at] = k
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
        under = [k for k, at in enumerate(bins) if capacity - lengths[at].sum() >= enough]
        # Long pieces alone find no partners on the next level, so full bins of many pieces go there with them.
        full = sorted(set(range(len(bins))) - set(under), key=lambda k: (-len(bins[k]), k))
        for k in [*under, *full[: REOPENED * len(under)]]:
            again[bins[k]] = True
        return frame.assign(grp=key[0], bin=number, offset=offset, again=again)

    todo, level, done = rows.select("uid", "piece", "length"), 0, []
    left = todo.count()
    while True:
        # What is left is little, so it meets in larger groups.
        groups = max(1, -(-left // (group * min(1 << level, WIDER))))
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64("uid", "piece", F.lit(level)), F.lit(groups)))
        packed = held.keep(dealt.groupBy("grp").applyInPandas(one, schema), f"level{level}")
        again = packed.filter("again")
        count = again.count() if groups > 1 else 0
        last = groups == 1 or not count or (count > STUCK * left and 1 << level >= WIDER)
        placed = packed if last else packed.filter("not again")
        number = F.lit(level << 56) + F.shiftleft(F.col("grp"), 20) + F.col("bin")
        done.append(placed.select("uid", "piece", number.alias("sequence_id"), "offset"))
        if last:
            break
        todo, left, level = again.select("uid", "piece", "length"), count, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def report(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Empty and null texts are one piece with the end id only; repeated rows are packed each by itself; longer documents are cut
    at whole capacities and in no other place; an empty table gives no rows. Other columns are not read.
    """
    held = Staging(docs.sparkSession, "packing")
    rows = held.keep(pieces(docs, vocabulary, capacity), "pieces")
    placed = pack(rows, held, capacity)
    return rows.join(placed, ["uid", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
