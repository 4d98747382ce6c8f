"""Fill-in-the-middle, page text and conversation repair against brute-force versions."""

import hashlib
import html
import itertools
import random
import re
import zlib

import pytest
from compare import database, differences
from pyspark.sql import functions as F

from slotline.llm import fill_middle, page_text, turns
from slotline.llm.queries import QUERIES, SQL

# --- 11 fill in the middle ---------------------------------------------------


def formed(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    sha = hashlib.sha256(text.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, sha, sha
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), hashlib.sha256(out.encode()).hexdigest(), sha


TEXTS = ["", None, "a", "é", "one two", "x<P>y", "x <S", "😀 ñ abc\n\ndef", "word " * 30_000, "7" * 100, "ab" * 50, "<M>", " \x00 ", "P>S>M>"]


@pytest.fixture(scope="module")
def told(spark):
    rows = [(i + 100 * k, t, 1, "x") for k in range(12) for i, t in enumerate(TEXTS)] + [(None, "null id", 1, "x"), (3, "é", 1, "x"), (2**53 + 1, "large id", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, h1 int, _told string"), rows


def test_fill_middle(told):
    docs, rows = told
    got = [tuple(r) for r in fill_middle.report(docs).collect()]
    want = [(i, *formed(i, t)) for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_fill_middle_restores(told):
    docs, rows = told
    back = fill_middle.restore(fill_middle.fill_in_middle(docs))
    assert sorted(map(repr, ((r[0], r[1]) for r in back.collect()))) == sorted(repr((i, t or "")) for i, t, *_ in rows)


def test_fill_middle_of_nothing(spark):
    assert fill_middle.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_are_split_not_copied():
    table = fill_middle.PieceTable.of("abcdef")
    groups = table.cut(0, 4)
    assert groups == [[], [(0, 0, 4)], [(0, 4, 6)]]
    out = table.arranged(groups, "psm")
    assert out.text() == "<P><S>ef<M>abcd" and out.buffers is table.buffers
    assert fill_middle.restored(out.text(), "psm").text() == "abcdef"
    assert [[tuple(p) for p in g] for g in out.cut(4, 7)] == [[(1, 0, 3), (1, 3, 4)], [(1, 4, 6), (0, 4, 5)], [(0, 5, 6), (1, 6, 9), (0, 0, 4)]]


def test_fill_middle_equals_sql(spark, small):
    assert differences(QUERIES["op11_fill_middle"](spark, small), database(small), SQL["op11_fill_middle"]) is None


# --- 12 page text ------------------------------------------------------------

PAGE = """<html><body class="has-sidebar"><header class="top"><h1>Site</h1>Menu</header><div id="main-menu"><a href=x>Home</a></div>
<div class="cookie-notice">We use cookies</div><div class="post post-{n}"><header><h2>Title &lt;{n}&gt;</h2><span>by me</span></header>{body}
<div class="ad">BUY</div><form><p>mail</form><section id=comments><p>Reader says</p></section></div>
<div class="col">{side}</div><footer>&copy; all</footer>"""
BODY = """<p>One two, three<p>Four <a href="x">five</a> &amp;nbsp; six&nbsp;seven<ul><li>a<li>b</ul><table><tr><td>c1<td>c2</table>
<img alt="a>b" data-x='<p>no</p>'><pre>x
  y</pre><!-- <p>not this</p> --><script>var t = "<p>nor this</p>";</script><p hidden>nor that</p>"""
LINES = ["One two, three", "Four five &nbsp; six seven", "a", "b", "c1", "c2", "x y"]
LONG = "<p>" + "running text of the article, " * 12 + "</p>"


def expected(n, *lines):
    return "\n".join([f"Title <{n}>", *lines])


@pytest.fixture(scope="module")
def pages(spark):
    long = " ".join(LONG[3:-4].split())
    side = "<p>" + "a column beside it on every page. " * 9 + "</p>"
    rows = [(k, f"https://User@A.example:80/{k}?x", PAGE.format(n=k, body=LONG, side=""), "c") for k in range(8)]
    want = {k: expected(k, long) for k in range(8)}
    rows.append((8, "http://a.example", PAGE.format(n=8, body=BODY, side=side), "c"))  # alone it would choose the column
    want[8] = expected(8, *LINES)
    rows.append((9, "http://b.example/", "<div class=x><p>Only page of its host.</p></div>", "c"))
    want[9] = "Only page of its host."
    rows += [(10, None, None, "c"), (11, "", "", "c"), (12, "not a url", "just text &amp; more", "c"), (13, None, "<p", "c"), (14, "http://c.example", "<nav>Menu</nav>", "c"), (None, None, "x <br> y<br>z", "c")]
    want |= {10: "", 11: "", 12: "just text & more", 13: "", 14: "", None: "x y z"}
    rows.append((2**53 + 1, "http://d.example", "<main>" + "<p>very long</p>" * 50_000 + "</main>", "c"))
    want[2**53 + 1] = "\n".join(["very long"] * 50_000)
    rows.append(rows[9])
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string"), rows, want


def test_page_text(pages):
    frame, rows, want = pages
    got = page_text.report(frame).collect()
    assert len(got) == len(rows)
    urls = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r["page_id"], r["text"]) == (r["page_id"], want[r["page_id"]])
        assert r["n_chars"] == len(r["text"]) and r["url"] == urls[r["page_id"]]


def test_votes_are_sums_over_pages(pages):
    frame, rows, _ = pages
    want = {}
    for _, url, markup, _ in rows:
        page = page_text.Page(markup)
        host = {"https://User@A": "a.example"}.get((url or "")[:14]) or (url.split("//")[1].rstrip("/") if url and "//" in url else "")
        for element, weight in page.best():
            key = (host, page.path(element))
            want[key] = want.get(key, 0) + round(weight * 1e6)
    got = {(r["host"], r["path"]): r["votes"] for r in page_text.votes(frame).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 20 for k in got)


def test_page_text_of_test_pages(spark, small):
    """The pages of the test tables keep their article in one element."""
    got = {r["page_id"]: r["text"] for r in QUERIES["op12_page_text"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (re.sub("<[^>]*>", "", p.replace("<br>", " ")) for p in re.split("<p>|<h1>", article))
        assert got[r["page_id"]] == "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_page_text_of_nothing(spark):
    assert page_text.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 13 conversation repair --------------------------------------------------

def cheapest(codes):
    """Least (cost, edits) by trying every edit of every row, with up to two inserted rows before each."""
    best = {(len(codes), s): (turns.CLOSING[s], turns.CLOSING_EDITS[s]) for s in range(4)}
    for row in range(len(codes) - 1, -1, -1):
        initial, fault = codes[row] % 4, codes[row] // 4

        def edits(state, row=row, initial=initial, fault=fault):
            yield "D", (row + 1, state), 2
            if fault != turns.MUST_GO:
                more = 5 if fault == turns.TRUNCATED else 0
                if ("sua-"[initial], state) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                    yield "K", (row + 1, {0: 1, 1: 2, 2: 3}[initial]), more
                yield "R", (row + 1, 3 if state == 2 else 2), more + 1

        for state in range(4):
            options = []
            for inserts in range(3):
                at = state
                for _ in range(inserts):
                    at = 3 if at == 2 else 2
                for letter, node, cost in edits(at):
                    c, e = best[node]
                    options.append((5 * inserts + cost + c, "I" * inserts + letter + e))
            best[row, state] = min(options)
    return best[0, 0]


def test_auction_equals_trying_all_edits():
    kinds = [i + 4 * f for i in range(4) for f in range(3)]
    for n in range(4):
        for codes in itertools.product(kinds, repeat=n):
            assert turns.solve(bytes(codes)) == cheapest(bytes(codes))
    draw = random.Random(5)
    for n in (5, 8, 31, 32, 33, 64, 65, 100, 300):
        for _ in range(20):
            codes = bytes(draw.choice(kinds if draw.random() < 0.5 else [1, 2, 1, 2, 9, 5]) for _ in range(n))
            assert turns.solve(codes) == cheapest(codes)


def repaired(conv, rows):
    """The contract row by row, in plain Python."""
    out = []
    for turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    known = [r[0] for r in out if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen, codes, counts = set(), [], [0, 0, 0]
    for _, role, text in out:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 0
        if not bare:
            fault, k = 1, 0
        elif (role, text) in seen:
            fault, k = 1, 1
        elif bare[-1] not in ".!?":
            fault, k = 2, 2
        if fault:
            counts[k] += 1
        seen.add((role, text))
        codes.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * fault)
    illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in zip(out, out[1:]))
    cost, audit = cheapest(bytes(codes))
    state, at, parts = 0, 0, []
    for letter in audit:
        turned = 3 if state == 2 else 2
        if letter == "I":
            state = turned
            parts.append(("user:", "assistant:")[state - 2])
            continue
        _, role, text = out[at]
        at += 1
        if letter == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            parts.append(f"{role}:{text}")
        elif letter == "R":
            state = turned
            parts.append(f"{('user', 'assistant')[state - 2]}:{text}")
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(parts).encode()).hexdigest()


def talk(draw, conv, n):
    texts = ["Hello there.", "And you?", "no end", "", " \n ", None, "Well!", "same.", "é😀.  \n", "a. b"]
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, "", "User"]
    rows = []
    for k in range(n):
        turn = None if draw.random() < 0.05 else k + (3 if draw.random() < 0.1 else 0)
        plain = draw.random() < 0.6
        rows.append((conv, turn, ("user", "assistant")[k % 2] if plain else draw.choice(roles), f"line {k}." if plain else draw.choice(texts), 1, "x"))
    return rows


@pytest.fixture(scope="module", params=[2048, 7])
def block(request, monkeypatch_module):
    monkeypatch_module.setattr(turns, "BLOCK", request.param)
    return request.param


@pytest.fixture(scope="module")
def monkeypatch_module():
    patch = pytest.MonkeyPatch()
    yield patch
    patch.undo()


def test_turns(spark, block):
    draw = random.Random(11)
    rows = [r for conv in range(60) for r in talk(draw, conv, draw.randint(1, 9))]
    rows += talk(draw, 2**53 + 1, 120) + talk(draw, None, 9) + [(77, t, "user", "x.", 1, "x") for t in (None, None)]
    rows += [(88, 1, "assistant", "long. " * 60_000, 1, "x"), (88, 2, "assistant", "long. " * 60_000, 1, "x")]
    rows += rows[:3]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int, mark string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.report(frame).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:4])
    assert got.keys() == by.keys()
    for conv, own in by.items():
        assert got[conv] == repaired(conv, own), conv


def test_turns_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert turns.report(spark.createDataFrame([], schema)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = turns.report(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_page_text", "op13_turns"])
def test_one_row_each(spark, small, name):
    table, key = {"op11_fill_middle": ("documents", "doc_id"), "op12_page_text": ("pages", "page_id"), "op13_turns": ("conversations", "conv_id")}[name]
    out = QUERIES[name](spark, small)
    ids = spark.read.parquet(f"{small}/{table}.parquet").select(key)
    ids = ids.distinct() if name == "op13_turns" else ids
    assert out.count() == ids.count() and out.select(F.count_distinct(key)).first()[0] == ids.select(F.count_distinct(key)).first()[0]
