"""Fill-in-the-middle rearrangement of documents on a piece table.

A document is a list of pieces (buffer, start, stop) over two buffers that never change: its text and the sentinels. Cutting splits a
piece at an offset, an arrangement permutes groups of pieces and puts sentinels before them, and the inverse permutation
brings the text back. No text is copied until a table is read; hashes read it piece by piece.

Tokens are runs of A-Z and a-z, and every other code point by itself; cuts fall between tokens. Where the cuts fall and which
form a document gets follows from its id alone, so reruns and any partitioning agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = "<P><S><M>"
PLAIN_FROM, SPM_BELOW = 90, 20
READ = 1 << 20  # code points that are encoded at a time
TEXT, MARKS = 0, 1
_PREFIX, _MIDDLE, _SUFFIX = range(3)
#: Order of (prefix, middle, suffix) in an arrangement, and the sentinel before each of them.
ARRANGEMENTS = {"psm": ((_PREFIX, _SUFFIX, _MIDDLE), ("<P>", "<S>", "<M>")), "spm": ((_SUFFIX, _PREFIX, _MIDDLE), ("<S>", "<P>", "<M>"))}


class Piece(NamedTuple):
    buffer: int
    start: int
    stop: int


class PieceTable:
    """Pieces over immutable buffers, in the order in which they are read."""

    def __init__(self, buffers: tuple[str, ...], pieces: list[Piece]) -> None:
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: str) -> PieceTable:
        return cls((text, SENTINELS), [Piece(TEXT, 0, len(text))])

    def cut(self, *offsets: int) -> list[list[Piece]]:
        """Groups of pieces before, between and after the ascending ``offsets`` of the text that the table reads."""
        groups: list[list[Piece]] = [[]]
        wanted, at = list(offsets), 0
        for buffer, start, stop in self.pieces:
            while wanted and wanted[0] <= at + stop - start:
                split = start + wanted.pop(0) - at
                groups[-1].append(Piece(buffer, start, split))
                groups.append([])
                at += split - start
                start = split
            groups[-1].append(Piece(buffer, start, stop))
            at += stop - start
        return [[p for p in g if p.start < p.stop] for g in groups]

    def arranged(self, groups: list[list[Piece]], form: str) -> PieceTable:
        order, marks = ARRANGEMENTS[form]
        pieces = []
        for k, mark in zip(order, marks):
            at = SENTINELS.index(mark)
            pieces += [Piece(MARKS, at, at + len(mark)), *groups[k]]
        return PieceTable(self.buffers, pieces)

    def read(self) -> Iterator[str]:
        for buffer, start, stop in self.pieces:
            for k in range(start, stop, READ):
                yield self.buffers[buffer][k : min(k + READ, stop)]

    def text(self) -> str:
        return "".join(self.read())

    def sha256(self) -> str:
        told = hashlib.sha256()
        for part in self.read():
            told.update(part.encode("utf-8", "surrogatepass"))
        return told.hexdigest()


def token_starts(text: str) -> np.ndarray:
    """True at every code point that begins a token."""
    codes = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (codes | 32) - codes.dtype.type(ord("a")) < 26
    starts = ~letter
    starts[:1] = True
    starts[1:] |= ~letter[:-1]
    return starts


def restored(output: str, form: str) -> PieceTable:
    """The text behind an arranged ``output``: cut at its sentinels, put back by the inverse permutation, sentinels left out."""
    whole = PieceTable.of(output)
    if form == "plain":
        return whole
    order, marks = ARRANGEMENTS[form]
    at = [output.index(m) for m in marks]
    groups = whole.cut(*[x for a, m in zip(at, marks) for x in (a, a + len(m))])[2::2]
    inverse = np.argsort(order)
    return PieceTable(whole.buffers, [p for k in inverse for p in groups[k]])


def rearranged(text: str | None, one: int, two: int, three: int, four: int) -> tuple[int, str, PieceTable, list[list[Piece]] | None]:
    """Number of tokens, form, table of the output and the groups (prefix, middle, suffix), None for the plain form."""
    table = PieceTable.of(text or "")
    text = table.buffers[TEXT]
    starts = token_starts(text)
    n = int(np.count_nonzero(starts))
    if not text or three % 100 >= PLAIN_FROM or any(SENTINELS[k : k + 3] in text for k in (0, 3, 6)):
        return n, "plain", table, None
    first, last = sorted((one % (n + 1), two % (n + 1)))
    places = np.append(np.flatnonzero(starts), len(text))
    groups = table.cut(int(places[first]), int(places[last]))
    form = "spm" if four % 100 < SPM_BELOW else "psm"
    return n, form, table.arranged(groups, form), groups


def draws(id_column: Column) -> list[Column]:
    """Four numbers below 2**32 from the id; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


_FORMED = "n long, form string, prefix_chars long, middle_chars long, output string"


def _formed(text: pd.Series, one: pd.Series, two: pd.Series, three: pd.Series, four: pd.Series) -> pd.DataFrame:
    rows = []
    for t, *h in zip(text, one, two, three, four):
        n, form, table, groups = rearranged(t, *h)
        sizes = [sum(p.stop - p.start for p in g) for g in groups[:2]] if groups else [None, None]
        rows.append((n, form, *sizes, table.text()))
    return pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


def _back(output: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if o is None or f is None else restored(o, f).text() for o, f in zip(output, form)], dtype=object)


_DIGESTS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _digests(text: pd.Series, one: pd.Series, two: pd.Series, three: pd.Series, four: pd.Series) -> pd.DataFrame:
    rows = []
    for t, *h in zip(text, one, two, three, four):
        n, form, table, groups = rearranged(t, *h)
        sizes = [sum(p.stop - p.start for p in g) for g in groups[:2]] if groups else [None, None]
        rows.append((n, form, *sizes, table.sha256(), restored(table.text(), form).sha256()))
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return pd.DataFrame(rows, columns=names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n (tokens), form, prefix_chars, middle_chars (null for the plain form) and output, the rearranged text.

    Null texts are empty and so are their outputs; empty texts and texts that hold a sentinel stay plain; rows are independent, so repeated rows give
    repeated results, and an empty table gives no rows. Other columns are not read.
    """
    told = docs.select(F.col(id_col).alias(id_col), F.pandas_udf(_formed, _FORMED)(F.col(text_col), *draws(F.col(id_col))).alias("_told"))
    return told.select(id_col, "_told.*")


def restore(formed: DataFrame, id_col: str = "doc_id", output_col: str = "output", form_col: str = "form") -> DataFrame:
    """Per row of rearranged texts: its id and the text as it was."""
    return formed.select(F.col(id_col), F.pandas_udf(_back, "string")(F.col(output_col), F.col(form_col)).alias("text"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``fill_in_middle``, with the SHA-256 of the output and of the text rebuilt from it in place of the output."""
    told = docs.select(F.col(id_col).alias(id_col), F.pandas_udf(_digests, _DIGESTS)(F.col(text_col), *draws(F.col(id_col))).alias("_told"))
    return told.select(id_col, "_told.*")


REPORT_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), t AS (
    SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]', 0, 's') AS tokens,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
    SELECT doc_id, text, tokens, len(tokens) AS n,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
            WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
        least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b FROM t
), p AS (
    SELECT doc_id, text, n, form, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
        array_to_string(tokens[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
