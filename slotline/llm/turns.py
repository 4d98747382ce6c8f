"""Repair of the turn structure of conversations as shortest paths, found by the auction algorithm.

The rows of a conversation, in order, span a lattice of nodes (rows done, state): before anything (0), after the system row (1), after a user row (2), after
an assistant row (3). Keep, rerole, delete and insert are its arcs, with whole-number costs. The auction algorithm keeps a price per node, never more than
the cheapest arc plus the price behind it, and a path from an origin: the path grows along an arc that its last node's price pays for exactly;
where none is, the price rises to the cheapest arc and the path shrinks by that node. Prices stay between origins, which are taken every ``STRIDE`` rows from the
end, and a path ends where it meets a converged price. An arc whose cost is the difference of two converged prices is tight; tracing
tight arcs by the least initial gives the cheapest edits that come first in ASCII order.

Rows are numbered over the whole table and worked on in blocks of equal size, whatever the conversations in them. A conversation cut by a block's edge is
joined from its segments: their state-to-state costs give each segment the prices behind it, then its edits. The digest
of a repaired conversation is a running SHA-256, so each conversation's texts pass one task as a stream, in order and without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import number_rows
from slotline.session import Staging

BLOCK = 2048  # rows of a block
STRIDE = 32  # rows between origins
SPACE = " \t\n\x0b\x0c\r"
RATES = 20
#: Fixed values of the damage: remainder -> what happens to the row.
DROP, EMPTY, STRIP, REPEAT, USER = range(5)
DELETE, REROLE, INSERT, CUT_SHORT = 2, 1, 5, 5
NEVER = 1 << 40
STATES = 4
#: The state that an inserted or reroled row leads to, from each state.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: Costs of reaching an allowed end from each state by inserting rows behind the last.
CLOSING = (0, 2 * INSERT, INSERT, 0)
CLOSING_EDITS = ("", "II", "I", "")
S, U, A, OTHER = range(4)
FINE, MUST_GO, TRUNCATED = range(3)
#: (state, initial) -> state after keeping the row.
KEEP = {(0, S): 1, (0, U): 2, (1, U): 2, (2, A): 3, (3, U): 2}


class Lattice:
    """Prices of a segment's nodes; ``codes`` has one byte per row, initial + 4 * fault, and ``exits`` the prices behind the segment by state."""

    def __init__(self, codes: bytes, exits: tuple[int, ...]) -> None:
        self.codes, self.n = codes, len(codes)
        self.price = [0] * (STATES * self.n) + list(exits)
        self.done = bytearray(STATES * self.n) + bytearray(b"\1" * STATES)
        layer = self.n
        while layer:
            start = max(0, layer - STRIDE)
            # Every way on leads through the converged layer, so its least price is a valid first price before it.
            floor = min(self.price[STATES * layer : STATES * (layer + 1)])
            self.price[STATES * start : STATES * layer] = [floor] * (STATES * (layer - start))
            for state in range(STATES):
                self.converge(STATES * start + state)
            layer = start

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(initial, node, cost) of the edits at a node, in ASCII order."""
        row, state = divmod(node, STATES)
        initial, fault = self.codes[row] % 4, self.codes[row] // 4
        behind = node - state + STATES
        out = [("D", behind + state, DELETE), ("I", node - state + NEXT[state], INSERT)]
        if fault != MUST_GO:
            more = CUT_SHORT if fault == TRUNCATED else 0
            kept = KEEP.get((state, initial))
            if kept is not None:
                out.append(("K", behind + kept, more))
            out.append(("R", behind + NEXT[state], REROLE + more))
        return out

    def converge(self, origin: int) -> None:
        """Auction from ``origin`` until its price is the cost of its cheapest way out."""
        price, done, path = self.price, self.done, [origin]
        while not done[path[-1]]:
            node = path[-1]
            least, best = NEVER * 4, -1
            for _, to, cost in self.arcs(node):
                if price[to] + cost < least:
                    least, best = price[to] + cost, to
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best)
        for node in path:
            done[node] = 1

    def trace(self, state: int) -> tuple[str, int]:
        """Cheapest edits from the first row on, the least in ASCII order, and the state they end in."""
        node, edits = state, []
        while node < STATES * self.n:
            for letter, to, cost in self.arcs(node):
                if self.price[to] + cost == self.price[node]:
                    if not self.done[to]:
                        self.converge(to)
                        if self.price[to] + cost != self.price[node]:
                            continue
                    edits.append(letter)
                    node = to
                    break
        return "".join(edits), node - STATES * self.n


@lru_cache(1 << 14)
def _solved(codes: bytes) -> tuple[int, str]:
    lattice = Lattice(codes, CLOSING)
    edits, state = lattice.trace(0)
    return lattice.price[0], edits + CLOSING_EDITS[state]


def solve(codes: bytes) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    if len(codes) <= 64:
        return _solved(codes)
    return _solved.__wrapped__(codes)


def crossing(codes: bytes) -> np.ndarray:
    """Costs of passing a segment from each state (rows) to each (columns). States 0 and 1 are left by inserting or keeping a row only, so ways into them are plain sums."""
    n, out = len(codes), np.full((STATES, STATES), NEVER, np.int64)
    out[0, 0] = out[1, 1] = DELETE * n
    for c in codes:
        if c % 4 == S and c // 4 != MUST_GO:
            out[0, 1] = min(out[0, 1], DELETE * (n - 1) + (CUT_SHORT if c // 4 == TRUNCATED else 0))
    for end in (2, 3):
        out[:, end] = Lattice(codes, tuple(0 if s == end else NEVER for s in range(STATES))).price[:STATES]
    return out


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) after the damage; nulls in the key, in roles and in texts are one space."""

    def told(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.pmod(F.crc32(F.concat(told(conv), F.lit(":"), told(turn))), F.lit(RATES))
    changed = F.when(fate == EMPTY, F.lit("")).when(fate == STRIP, F.regexp_replace(told(text), "[.!?]", "")).otherwise(told(text))
    spoken = F.when(fate == USER, F.lit("user")).otherwise(told(role))
    times = F.when(fate == DROP, 0).when(fate == REPEAT, 2).otherwise(1)
    copies = F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), times)
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), spoken.alias("role"), changed.alias("text"), copies.alias("copies"))
    return out.select("conv", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def _narrow(numbered: DataFrame) -> DataFrame:
    """What the lattice needs of a row: conv as text, turn, code without duplicates, digest of role and text."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(F.length(bare) == 0, MUST_GO).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(OTHER)
    return numbered.select(
        F.floor(F.col("row_no") / BLOCK).alias("block"), "row_no", F.col("conv").cast("string").alias("conv"), F.col("conv").isNull().alias("no_conv"), F.col("turn").cast("string").alias("turn"),
        initial.alias("initial"), fault.alias("fault"), F.sha2(F.concat_ws("\0", "role", "text"), 256).alias("said"),
    )


_SEGMENT = (
    "conv string, no_conv boolean, block long, whole boolean, rows long, first_turn string, last_turn string, turns long, blank long, duplicate long, truncated long,"
    " illegal long, first_initial int, last_initial int, codes binary, cost long, audit string, crossing array<long>"
)
_ILLEGAL = ~np.array([[(i, j) in ((S, U), (U, A), (A, U)) for j in range(4)] for i in range(4)])


def _segments(rows: pd.DataFrame, firsts: pd.DataFrame) -> pd.DataFrame:
    """One row per conversation of a block; the first and the last one may go on outside it."""
    rows = rows.sort_values("row_no", ignore_index=True)
    known = set(firsts["row_no"])
    conv, missing = rows["conv"].to_numpy(object), rows["no_conv"].to_numpy(bool)
    turn = [None if t is None or t != t else t for t in rows["turn"]]
    initial = rows["initial"].to_numpy(np.int64)
    fault = rows["fault"].to_numpy(np.int64)
    blank = fault == MUST_GO
    again = ~blank & np.array([r not in known for r in rows["row_no"]], bool)
    fault = np.where(again, MUST_GO, fault)
    codes = (initial + 4 * fault).astype(np.uint8).tobytes()
    edges = [k for k in range(1, len(rows)) if missing[k] != missing[k - 1] or (not missing[k] and conv[k] != conv[k - 1])]
    out = []
    for start, stop in zip([0, *edges], [*edges, len(rows)]):
        part = slice(start, stop)
        whole = start > 0 and stop < len(rows)
        told = [t for t in turn[part] if t is not None]
        code = codes[part]
        cost, audit = solve(code) if whole else (None, None)
        out.append((
            None if missing[start] else conv[start], bool(missing[start]), rows["block"].iloc[0], whole, stop - start, told[0] if told else None, told[-1] if told else None, len(dict.fromkeys(told)),
            int(blank[part].sum()), int(again[part].sum()), int((fault[part] == TRUNCATED).sum()), int(_ILLEGAL[initial[start : stop - 1], initial[start + 1 : stop]].sum()),
            initial[start], initial[stop - 1], code, cost, audit, None if whole else crossing(code).ravel().tolist(),
        ))
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _SEGMENT.split(", ")])
    return frame.astype({"cost": "Int64"})


def _behind(_: tuple, segments: pd.DataFrame) -> pd.DataFrame:
    """The prices behind every segment of one conversation, from the last to the first."""
    segments = segments.sort_values("block", ignore_index=True)
    price, out = np.array(CLOSING, np.int64), []
    for steps in reversed(list(segments["crossing"])):
        out.append(price.tolist())
        price = np.minimum((np.array(steps, np.int64).reshape(STATES, STATES) + price).min(axis=1), NEVER)
    return segments[["conv", "no_conv", "block"]].assign(exits=out[::-1], total=int(price[0]))


_EDITS = "conv string, no_conv boolean, block long, total long, edits array<string>, ends array<int>"


def _edits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of a segment for each state that it may be entered in, and the state that it is left in."""
    for frame in frames:
        rows = []
        for code, exits in zip(frame["codes"], frame["exits"]):
            low = int(min(exits))
            lattice = Lattice(code, tuple(int(x) - low for x in exits))
            rows.append([lattice.trace(s) for s in range(STATES)])
        yield frame[["conv", "no_conv", "block", "total"]].assign(edits=[[e for e, _ in r] for r in rows], ends=[[s for _, s in r] for r in rows])


_WHOLE = "conv string, no_conv boolean, first_turn string, last_turn string, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _joined(_: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """One conversation from its segments."""
    parts = parts.sort_values("block", ignore_index=True)
    state, audit = 0, []
    for edits, ends in zip(parts["edits"], parts["ends"]):
        audit.append(edits[state])
        state = int(ends[state])
    seams = int(_ILLEGAL[parts["last_initial"].to_numpy()[:-1], parts["first_initial"].to_numpy()[1:]].sum())
    told = parts[parts["turns"] > 0]
    # A turn on both sides of a cut counts once; turns of nothing but nulls come first and have none.
    twice = int((told["last_turn"].to_numpy()[:-1] == told["first_turn"].to_numpy()[1:]).sum())
    row = {
        "conv": parts["conv"][0], "no_conv": bool(parts["no_conv"][0]), "first_turn": told["first_turn"].iloc[0] if len(told) else None,
        "last_turn": told["last_turn"].iloc[-1] if len(told) else None, "turns": int(parts["turns"].sum()) - twice,
        **{c: int(parts[c].sum()) for c in ("blank", "duplicate", "truncated")}, "illegal": int(parts["illegal"].sum()) + seams,
        "cost": int(parts["total"][0]), "audit": "".join(audit) + CLOSING_EDITS[state],
    }
    return pd.DataFrame([row])


def repairs(numbered: DataFrame, held: Staging) -> DataFrame:
    """Figures, cost and edits of every conversation that has rows, from rows (row_no, conv, turn, role, text) in order."""
    narrow = _narrow(numbered)
    firsts = narrow.filter(F.col("fault") != MUST_GO).groupBy("conv", "no_conv", "said").agg(F.min("row_no").alias("row_no"))
    firsts = firsts.select(F.floor(F.col("row_no") / BLOCK).alias("block"), "row_no")
    segments = narrow.drop("said").groupBy("block").cogroup(firsts.groupBy("block")).applyInPandas(_segments, _SEGMENT)
    segments = held.keep(segments, "segments")
    key = ["conv", "no_conv", "block"]
    cut = segments.filter("not whole")
    exits = cut.select(*key, "crossing").groupBy("conv", "no_conv").applyInPandas(_behind, "conv string, no_conv boolean, block long, exits array<long>, total long")
    # conv is null only where no_conv holds, and then it is one conversation.
    same = [F.coalesce("conv", F.lit("")).alias("conv"), "no_conv", "block"]
    traced = cut.select(*same, "codes").join(exits.select(*same, "exits", "total"), key).mapInPandas(_edits, _EDITS)
    figures = cut.select(*same, "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial")
    joined = figures.join(traced, key).groupBy("conv", "no_conv").applyInPandas(_joined, _WHOLE)
    whole = segments.filter("whole").select(*[c.split()[0] for c in _WHOLE.split(", ")])
    return held.keep(whole.unionByName(joined), "repairs")


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of every repaired conversation from a head row (its edits) and its rows, as they come."""
    key, audit, at, state, digest, parts = None, "", 0, 0, hashlib.sha256(), 0

    def put(role: str, text: str) -> None:
        nonlocal parts
        digest.update((("\n" if parts else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        parts += 1

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            put(ROLE[state], "")
            at += 1

    for frame in frames:
        done = []
        for mark, head, role, text in zip(frame["mark"], frame["head"], frame["role"], frame["text"]):
            if head:
                if key is not None:
                    inserts()
                    done.append((key, digest.hexdigest()))
                key, audit, at, state, digest, parts = mark, text, 0, 0, hashlib.sha256(), 0
                continue
            inserts()
            letter = audit[at]
            at += 1
            if letter == "K":
                state = KEEP[state, {"s": S, "u": U, "a": A}[role[0]]]
                put(role, text)
            elif letter == "R":
                state = NEXT[state]
                put(ROLE[state], text)
        yield pd.DataFrame(done, columns=["mark", "repaired_sha256"])
    if key is not None:
        inserts()
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["mark", "repaired_sha256"])


def repair(rows: DataFrame, held: Staging, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(mark, conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of the conversations in ``rows``, which are taken as they are.

    ``mark`` is conv as text behind a letter, so that it is never null.
    """
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    plain = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text")
    )
    numbered = number_rows(plain, order, held, "numbered")
    mark = F.when(F.col("conv").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv").cast("string")))
    found = repairs(numbered, held).withColumn("mark", F.when(F.col("no_conv"), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv"))))
    heads = found.select("mark", F.lit(True).alias("head"), F.lit(-1).cast("long").alias("row_no"), F.lit("").alias("role"), F.col("audit").alias("text"))
    said = numbered.select(mark.alias("mark"), F.lit(False).alias("head"), "row_no", "role", "text")
    stream = heads.unionByName(said).repartition("mark").sortWithinPartitions("mark", "row_no")
    digests = stream.mapInPandas(_hashed, "mark string, repaired_sha256 string")
    gaps = F.coalesce(F.col("last_turn").cast("long") - F.col("first_turn").cast("long") + 1 - F.col("turns"), F.lit(0)).cast("long")
    return found.join(digests, "mark").select(
        "mark", "conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(rows: DataFrame) -> DataFrame:
    """Per conversation of the undamaged rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 after the damage.

    A null conv_id is one conversation, and null turns come first and count for no gap. Rows of equal turn are taken by role, then text, so repeated rows
    lie side by side. Conversations that lose all rows have zeros, an empty audit and the digest of an empty text. Empty tables give no rows. Other
    columns are not read.
    """
    held = Staging(rows.sparkSession, "turns")
    found = repair(damaged(rows, "conv_id", "turn", "role", "text"), held, "conv", "turn", "role", "text")
    mark = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    every = rows.select("conv_id").distinct().select("conv_id", mark.alias("mark"))
    nothing = F.sha2(F.lit(""), 256)
    return every.join(found.drop("conv"), "mark", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _NUMBERS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )
