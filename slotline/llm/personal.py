"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger reads windows of characters, from the left and from the right, and scores five tags a character
(outside, email, ip, card, phone); a matrix of transition scores couples neighbours, and the best tag
sequence of a window is found by dynamic programming. It is trained in numpy by gradient descent on the negative
log-likelihood of labelled spans. Windows overlap; the spans that they propose are scored and reconciled over the whole text by the best
set of spans that do not overlap.

Only windows with a digit or an at sign are decoded: every kind holds one by definition, so elsewhere the answer is known.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import SPANS, located, spans_text

KINDS = ["email", "ip", "card", "phone"]
TAGS = len(KINDS) + 1

# The base patterns. Looking behind, \\G and possessive repeats only save retries; the matches are the plain ones'.
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

WINDOW, STRIDE = 80, 40
HIDDEN, EMBEDDING = 20, 12
EXAMPLES, STEPS, BATCH, SEED = 2_000, 450, 32, 3


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s
        + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(digits, i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return total % 10 == 0


def base_spans(text: Column, matches: list[Column]) -> Column:
    def digits(hit):
        return F.regexp_replace(hit, "[^0-9]", "")

    def is_card(hit):
        return F.when(F.length(digits(hit)).between(14, 19), luhn(digits(hit))).otherwise(False)

    tests = [
        lambda hit: F.lit(True),
        lambda hit: hit.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
        is_card,
        lambda hit: F.length(digits(hit)).between(10, 15),
    ]
    found = [located(text, m, p, k, t) for k, (m, p, t) in enumerate(zip(matches, [EMAIL, IP, CARD, PHONE], tests))]
    return F.concat(*found).cast(SPANS)


# --- the tagger -------------------------------------------------------------

SYMBOLS = "@.-+() _%"


def symbol_table() -> np.ndarray:
    """Character code to symbol: digits 1, lower case 2, upper case 3, other letters 4, other 5, then ``SYMBOLS`` one by one."""
    table = np.full(0x250, 5)
    for c in range(0x250):
        ch = chr(c)
        table[c] = 4 if ch.isalpha() else 5
    table[ord("0") : ord("9") + 1] = 1
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    for k, ch in enumerate(SYMBOLS):
        table[ord(ch)] = 6 + k
    return table


_TABLE = symbol_table()
VOCABULARY = 6 + len(SYMBOLS)  # 0 pads


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)].astype(np.int8)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Tagger:
    """Parameters: embedding, two LSTMs (input, recurrent, bias), output layer and transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = SEED) -> Tagger:
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBEDDING
        p = {"emb": r.normal(0, 0.3, (VOCABULARY, e)), "out": r.normal(0, 0.2, (2 * h, TAGS)), "ob": np.zeros(TAGS), "tr": np.zeros((TAGS, TAGS))}
        for side in "fb":
            p[f"w{side}"] = r.normal(0, 0.25, (e, 4 * h))
            p[f"u{side}"] = r.normal(0, 0.25, (h, 4 * h))
            p[f"c{side}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def run(self, x: np.ndarray, side: str):
        """Hidden states (time, batch, hidden) over symbols x (batch, time), and what the backward pass needs."""
        xs = x.T if side == "f" else x.T[::-1]
        table = self.p["emb"] @ self.p[f"w{side}"] + self.p[f"c{side}"]  # one row per symbol
        h = np.zeros((x.shape[0], HIDDEN), np.float32)
        c = h.copy()
        keep = []
        out = np.empty((xs.shape[0], x.shape[0], HIDDEN), np.float32)
        for t, s in enumerate(xs):
            z = table[s] + h @ self.p[f"u{side}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            keep.append((h, before, i, f, o, g, tc))
            h = o * tc
            out[t] = h
        return (out if side == "f" else out[::-1]), keep

    def emissions(self, x: np.ndarray):
        hf, kf = self.run(x, "f")
        hb, kb = self.run(x, "b")
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["out"] + self.p["ob"], h, kf, kb

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (batch, time) and, per place, how far the tag's emission is above the outside tag's."""
        e = self.emissions(x)[0]
        steps, n, _ = e.shape
        best = e[0]
        back = np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + self.p["tr"]
            back[t] = options.argmax(axis=1)
            best = options.max(axis=1) + e[t]
        tags = np.empty((steps, n), np.int8)
        tags[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        margin = np.take_along_axis(e, tags[:, :, None].astype(int), 2)[:, :, 0] - e[:, :, 0]
        return tags.T, margin.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y (batch, time), and its gradients."""
        e, h, kf, kb = self.emissions(x)
        steps, n, _ = e.shape
        y = y.T.astype(int)
        tr = self.p["tr"]
        alpha = np.empty_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            s = alpha[t - 1][:, :, None] + tr
            m = s.max(axis=1, keepdims=True)
            alpha[t] = e[t] + (m + np.log(np.exp(s - m).sum(axis=1, keepdims=True)))[:, 0]
        beta = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            s = tr[None] + (e[t + 1] + beta[t + 1])[:, None, :]
            m = s.max(axis=2, keepdims=True)
            beta[t] = (m + np.log(np.exp(s - m).sum(axis=2, keepdims=True)))[:, :, 0]
        m = alpha[-1].max(axis=1, keepdims=True)
        logz = (m + np.log(np.exp(alpha[-1] - m).sum(axis=1, keepdims=True)))[:, 0]
        rows = np.arange(n)
        gold = e[np.arange(steps)[:, None], rows, y].sum(axis=0) + tr[y[:-1], y[1:]].sum(axis=0)
        de = np.exp(alpha + beta - logz[None, :, None])
        de[np.arange(steps)[:, None], rows, y] -= 1
        dtr = np.zeros_like(tr)
        for t in range(1, steps):
            pair = alpha[t - 1][:, :, None] + tr + (e[t] + beta[t])[:, None, :] - logz[:, None, None]
            dtr += np.exp(pair).sum(axis=0)
        np.add.at(dtr, (y[:-1].ravel(), y[1:].ravel()), -1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["tr"] = dtr
        g["out"] = np.einsum("tnh,tnk->hk", h, de)
        g["ob"] = de.sum(axis=(0, 1))
        dh = de @ self.p["out"].T
        for side, keep, part in (("f", kf, dh[:, :, :HIDDEN]), ("b", kb, dh[::-1, :, HIDDEN:])):
            xs = x.T if side == "f" else x.T[::-1]
            w, u = self.p[f"w{side}"], self.p[f"u{side}"]
            nh = np.zeros((n, HIDDEN), np.float32)
            nc = nh.copy()
            per_symbol = np.zeros((VOCABULARY, 4 * HIDDEN), np.float32)
            for t in range(steps - 1, -1, -1):
                h0, c0, i, f, o, gg, tc = keep[t]
                dht = part[t] + nh
                dc = nc + dht * o * (1 - tc * tc)
                dz = np.hstack([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dht * tc * o * (1 - o), dc * i * (1 - gg * gg)])
                np.add.at(per_symbol, xs[t], dz)
                g[f"u{side}"] += h0.T @ dz
                nh, nc = dz @ u.T, dc * f
            g[f"c{side}"] += per_symbol.sum(axis=0)
            g[f"w{side}"] += self.p["emb"].T @ per_symbol
            g["emb"] += per_symbol @ w.T
        return float((logz - gold).mean()), {k: v / n for k, v in g.items()}


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], steps: int = STEPS, seed: int = SEED) -> Tagger:
    """Tagger from (text, [(start, kind, stop)]) with texts of at most ``WINDOW`` characters; Adam with a fixed number of steps."""
    x = np.zeros((len(examples), WINDOW), np.int8)
    y = np.zeros((len(examples), WINDOW), np.int8)
    for k, (text, spans) in enumerate(examples):
        s = encode(text)[:WINDOW]
        x[k, : len(s)] = s
        for start, kind, stop in spans:
            y[k, start:stop] = kind + 1
    tagger, r = Tagger.new(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(w) for k, w in tagger.p.items()}
    for step in range(1, steps + 1):
        pick = r.integers(0, len(examples), BATCH)
        _, g = tagger.gradients(x[pick], y[pick])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.04 * (1 - step / (steps + 1)) * min(1.0, 5.0 / (norm + 1e-9))
        for k, a in g.items():
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.999 * v[k] + 0.001 * a * a
            tagger.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return tagger


def labelled_spans(count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled windows: personal data in common ways of writing, among words, numbers, dates, sums and codes that are none.

    The bound of the sample is ``count``; nothing of it depends on the corpus.
    """
    r = np.random.default_rng(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz")

    def word(least=1, most=11):
        w = "".join(r.choice(letters, r.integers(least, most)))
        return (w, w.title(), w.upper())[r.choice(3, p=[0.75, 0.2, 0.05])] + ("", ".", ",")[r.choice(3, p=[0.8, 0.1, 0.1])]

    def digits(n):
        return "".join(str(d) for d in r.integers(0, 10, n))

    def email():
        name = ".".join("".join(r.choice(letters, r.integers(2, 8))) for _ in range(r.integers(1, 3))) + ("", digits(2))[r.integers(2)]
        return f"{name}@{''.join(r.choice(letters, r.integers(3, 8)))}{('', digits(1))[r.integers(2)]}.{r.choice(['com', 'org', 'net', 'example.com', 'co.uk', 'de'])}"

    def ip():
        return ".".join(str(d) for d in r.integers(0, 256, 4))

    def card():
        body = [int(d) for d in r.integers(0, 10, 15)]
        total = sum(d if k % 2 else (2 * d) % 10 + d // 5 for k, d in enumerate(body))
        n = "".join(map(str, body)) + str(-total % 10)
        sep = ("", " ", "-")[r.choice(3, p=[0.5, 0.3, 0.2])]
        return sep.join(n[k : k + 4] for k in range(0, 16, 4))

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        forms = [f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)}{a}{b}{c}"]
        return forms[r.integers(len(forms))]

    def other():
        forms = [digits(r.integers(1, 7)), f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", digits(r.integers(20, 30)), f"{digits(3)},{digits(3)}", f"@{word(3)}", "".join(r.choice(list("0123456789abcdef"), 32))]
        return forms[r.integers(len(forms))]

    makers, out = [email, ip, card, phone], []
    for _ in range(count):
        text, spans = "", []
        while len(text) < WINDOW:
            what = r.choice(6, p=[0.55, 0.1, 0.1, 0.07, 0.1, 0.08])
            if what == 0:
                text += word() + " "
            elif what == 5:
                text += other() + " "
            else:
                kind = int(what) - 1
                made = makers[kind]()
                spans.append((len(text), kind, len(text) + len(made)))
                text += made + ("", ".", ",")[r.integers(3)] + " "
        shift = int(r.integers(0, 12))
        spans = [(max(a - shift, 0), k, min(b - shift, WINDOW)) for a, k, b in spans if b > shift and a - shift < WINDOW]
        out.append((text[shift : shift + WINDOW], spans))
    return out


_PROOF = [
    re.compile(r"[^\s@]+@[^\s@]+\.[^\s@.]+"),
    re.compile(r"\d{1,3}(?:\.\d{1,3}){3}"),
    re.compile(r"\d(?:[ -]?\d){13,18}"),
    re.compile(r"\+?\(?\d[\d ().-]{8,20}\d"),
]


def proven(kind: int, found: str) -> bool:
    """Exact check of a proposed span: its form, and the checksum or the range of its digits."""
    if not _PROOF[kind].fullmatch(found):
        return False
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == 1:
        return all(int(p) <= 255 for p in found.split("."))
    if kind == 2:
        return sum(d if k % 2 == 0 else (2 * d) % 10 + d // 5 for k, d in enumerate(reversed(digits))) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def proposals(text: str, tags: np.ndarray, margin: np.ndarray, at: int, last: bool) -> list[tuple[int, int, int, float]]:
    """Spans (start, kind, stop, score) of one decoded window; those cut by an edge that another window covers are left to it."""
    edges = np.flatnonzero(np.diff(tags)) + 1
    bounds = [0, *edges.tolist(), len(tags)]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        kind = int(tags[a]) - 1
        if kind < 0 or (a == 0 and at > 0) or (b == len(tags) and not last):
            continue
        start, stop = at + a, min(at + b, len(text))
        while start < stop and text[start] in " .,;:":
            start += 1
        while stop > start and text[stop - 1] in " .,;:-":
            stop -= 1
        if stop > start and proven(kind, text[start:stop]):
            out.append((start, kind, stop, float(margin[a:b].sum())))
    return out


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The set of spans without overlap whose scores sum to the most, over the whole text; equal spans count once."""
    best: dict[tuple[int, int, int], float] = {}
    for a, k, b, s in spans:
        best[(a, k, b)] = max(s, best.get((a, k, b), s))
    order = sorted(best, key=lambda x: (x[2], x[0], x[1]))
    ends = [x[2] for x in order]
    total, take = [0.0], []
    for n, x in enumerate(order):
        before = int(np.searchsorted(ends[:n], x[0], side="right"))
        gain = total[before] + max(best[x], 1e-6)
        take.append((gain > total[-1], before))
        total.append(max(gain, total[-1]))
    out, n = [], len(order)
    while n:
        yes, before = take[n - 1]
        if yes:
            out.append(order[n - 1])
        n = before if yes else n - 1
    return out[::-1]


def windows(symbols: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or an at sign."""
    marks = np.flatnonzero((symbols == 1) | (symbols == 6))
    if not len(marks):
        return np.zeros(0, np.int64)
    final = max(0, -(-(len(symbols) - WINDOW) // STRIDE))
    high = np.minimum(marks // STRIDE, final)
    return np.unique(np.concatenate([high, np.maximum(high - 1, 0)])) * STRIDE


def tag_texts(texts: list[str | None], tagger: Tagger, batch: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans of whole texts, decoded in batches of windows of any texts."""
    found: list[list] = [[] for _ in texts]
    queue: list[tuple[int, int, bool]] = []
    rows: list[np.ndarray] = []

    def flush():
        if not rows:
            return
        x = np.zeros((len(rows), WINDOW), np.int8)
        for k, s in enumerate(rows):
            x[k, : len(s)] = s
        tags, margin = tagger.decode(x)
        for (doc, at, last), t, m, s in zip(queue, tags, margin, rows):
            if t[: len(s)].any():
                found[doc].extend(proposals(texts[doc], t[: len(s)], m[: len(s)], at, last))
        queue.clear()
        rows.clear()

    for doc, text in enumerate(texts):
        if not text:
            continue
        symbols = encode(text)
        for at in windows(symbols):
            queue.append((doc, int(at), at + WINDOW >= len(symbols)))
            rows.append(symbols[at : at + WINDOW])
            if len(rows) >= batch:
                flush()
    flush()
    return [reconcile(s) for s in found]


@lru_cache(maxsize=1)
def trained() -> Tagger:
    return train(labelled_spans())


def tagged(text: Column, tagger: Tagger) -> Column:
    @F.pandas_udf(SPANS)
    def tag(texts: pd.Series) -> pd.Series:
        spans = tag_texts(texts.tolist(), tagger)
        return pd.Series([[{"start": a, "kind": k, "stop": b} for a, k, b in s] for s in spans], dtype=object)

    return tag(text)


def find(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``base`` spans of the patterns, ``added`` spans of the tagger that touch no base span.

    Spans are (start, kind, stop) in code points, stop exclusive, kinds being indexes into ``KINDS``. A null text is empty and has none;
    texts without a digit or an at sign are not sent to the tagger; repeated rows get equal results; other columns are not read.
    """
    tagger = tagger or trained()
    text = F.col("text")
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    matched = read.select("id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate([EMAIL, IP, CARD, PHONE])])
    based = matched.select("id", "text", base_spans(text, [F.col(f"m{k}") for k in range(4)]).alias("base"))
    told = based.select("id", "base", tagged(F.when(text.rlike("[0-9@]"), text), tagger).alias("tagged"))
    free = F.filter("tagged", lambda s: ~F.exists("base", lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"])))
    return told.select(F.col("id").alias(id_col), "base", free.cast(SPANS).alias("added"))


def report(docs: DataFrame) -> DataFrame:
    found = find(docs)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(spans_text(F.col("base"), KINDS), 256).alias("base_sha256"),
        spans_text(F.concat("base", "added"), KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
