"""Main text of web pages by consensus of each host's pages.

Pass one scores the containers of every page by the running text below them and lets the page vote for the generalised tag-class path of its best ones
(class names with digits as ``#``). Spark sums the votes per host and path; paths with a tenth of a host's votes win. Pass two takes each page's containers
on the best winning path that the page has, so that a page with a short article and a long side column follows its host; a page without any keeps its own best.

Both passes read the markup where it lies; between them move only (host, path, votes), summed before the shuffle. Winners are a few 64-bit keys per host.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotline.llm.common import bounded_join
from slotline.session import Staging

SHARE = 0.1  # of a host's votes makes a winner, so a host has ten at most
CANDIDATES = 3  # containers that a page votes for
DEEPEST = 0.75  # a deeper container wins with this share of the best score
FAVOUR = 1.25

# Tags and names by their meaning in markup.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var".split()
)
IN_HEAD = set("base basefont bgsound link meta title noscript script style template".split())
DROPPED = set(
    "head nav footer aside form menu dialog button select datalist option textarea iframe object svg canvas audio video map math noscript noframes template".split()
)
CONTAINERS = set("body main article section div td center blockquote table".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES_ITSELF = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "option": ("option", "select datalist"), "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"),
}
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_NAMES = set(
    "ad ads adslot adbox adsbox adunit advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies"
    " disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion"
    " recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
KEPT_NAMES = set("article body content entry main page post story text".split())
STATE_NAMES = set("has with no is not without".split())

_CLOSES = {tag: (set(own.split()), set(scope.split())) for tag, (own, scope) in CLOSES_ITSELF.items()}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]{0,20000}+\"|'[^']{0,20000}+')*+)>"
    r"|<(/?)([a-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^-_:]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MASK = (1 << 64) - 1
KEPT, HEADING_ONLY, GONE = 0, 1, 2


def _parts(name: str) -> list[str]:
    return [p.lower() for p in _PARTS.findall(_CAMEL.sub("-", name))]


@lru_cache(1 << 14)
def meaning(tag: str, attributes: str) -> tuple[str, int, int]:
    """Label (tag and generalised classes), its hash, and what happens to text below an element."""
    found = {}
    if attributes and not attributes.isspace():
        for name, x, y, z in _ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), html.unescape(x or y or z))
    classes = found.get("class", "").split()
    label = ".".join([tag, *sorted({_DIGITS.sub("#", c.lower()) for c in classes})])
    fate = GONE if tag in DROPPED else KEPT
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")) or found.get("role", "").lower() in DROPPED_ROLES:
        fate = GONE
    if tag not in ("html", "body", "main", "article") and fate == KEPT:
        names = [p for p in map(_parts, [*classes, *found.get("id", "").split()]) if p and p[0] not in STATE_NAMES]
        if not any(set(p) <= KEPT_NAMES for p in names):
            if any(p[0] in DROPPED_NAMES or p[-1] in DROPPED_NAMES for p in names):
                fate = GONE
            elif any("header" in (p[0], p[-1]) for p in names):
                fate = HEADING_ONLY
        if tag == "header":
            fate = HEADING_ONLY
    return label, xxhash.xxh3_64_intdigest(label), fate


class Page:
    """Elements (parent, key of the generalised path, label, fate) and text blocks (element, text, code points inside links) in page order."""

    def __init__(self, markup: str | None) -> None:
        self.parent, self.key, self.label, self.fate, self.tag = [-1], [1], [""], [KEPT], [""]
        self.named = [False]  # whether an element is, or is inside, one that says it holds the article
        self.blocks: list[tuple[int, str, int]] = []
        self._read(markup or "")

    def _read(self, markup: str) -> None:
        stack, opened = [0], {}
        parent, key, labels, fates, tags = self.parent, self.key, self.label, self.fate, self.tag
        said: list[str] = []
        linked: list[str] = []
        in_link, at = False, 0

        def flush() -> None:
            if said:
                text = " ".join(html.unescape("".join(said)).split())
                if text:
                    self.blocks.append((stack[-1], text, len(" ".join(html.unescape("".join(linked)).split())) if linked else 0))
                said.clear()
                linked.clear()

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                opened[tags[stack.pop()]] -= 1

        def close(names: set[str], scope: set[str]) -> None:
            """End the innermost open element of ``names``, unless one of ``scope`` is nearer."""
            if any(opened.get(n) for n in names):
                for depth in range(len(stack) - 1, 0, -1):
                    tag = tags[stack[depth]]
                    if tag in names:
                        pop_to(depth)
                        return
                    if tag in scope:
                        return

        def take(text: str) -> None:
            if text:
                said.append(text)
                if in_link:
                    linked.append(text)

        for m in _TAG.finditer(markup):
            take(markup[at : m.start()])
            at = m.end()
            tag = m[3] or m[6]
            if tag is None:
                continue
            tag, ends = tag.lower(), bool(m[2] or m[5])
            if tag in INLINE:
                if tag == "a":
                    in_link = not ends
                continue
            if tag == "br" or tag == "wbr":
                take(" " if tag == "br" else "")
                continue
            flush()
            if ends:
                if opened.get(tag):
                    close({tag}, set() if tag in ("table", "body", "html") else {"td", "th", "table"} - {tag})
                in_link = False
                continue
            if tag in VOID or (tag in ("html", "body") and opened.get(tag)):
                continue
            if opened.get("head") and tag not in IN_HEAD:
                close({"head"}, set())
            if opened.get("p"):
                close({"p"}, {"td", "th", "table", "button"})
            if tag in _CLOSES:
                own, scope = _CLOSES[tag]
                for _ in own:
                    close(own, scope)
            label, digest, fate = meaning(tag, m[4] or m[7] or "")
            up = stack[-1]
            if fate == HEADING_ONLY and not self.named[up]:
                fate = GONE
            self.named.append(self.named[up] or tag in ("article", "main") or (tag != "body" and not KEPT_NAMES.isdisjoint(label.split(".")[1:])))
            parent.append(up)
            tags.append(tag)
            labels.append(label)
            fates.append(max(fates[up], fate))
            key.append(((key[up] ^ digest) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
            if not (m[4] or m[7] or "").rstrip().endswith("/") or tag not in ("svg", "iframe", "object"):
                stack.append(len(parent) - 1)
                opened[tag] = opened.get(tag, 0) + 1
        take(markup[at:])
        flush()

    def stays(self, element: int) -> bool:
        fate = self.fate[element]
        return fate == KEPT or (fate == HEADING_ONLY and self.tag[element] in HEADINGS)

    def scores(self) -> np.ndarray:
        """Per element: code points of running text below it, less those of links; containers that say they hold the article count a quarter more."""
        score = np.zeros(len(self.parent))
        for element, text, linked in self.blocks:
            if self.stays(element):
                score[element] += len(text) - 2 * linked
        for element in range(len(score) - 1, 0, -1):
            score[self.parent[element]] += score[element]
        return np.where(self.named, score * FAVOUR, score)

    def best(self) -> list[tuple[int, float]]:
        """The page's best containers, best first, with the share of its vote that each gets."""
        score = self.scores()
        may = [e for e in range(len(score)) if (e == 0 or self.tag[e] in CONTAINERS) and self.fate[e] == KEPT and score[e] > 0]
        if not may:
            return []
        depth = np.zeros(len(score), int)
        for e in range(1, len(score)):
            depth[e] = depth[self.parent[e]] + 1
        top = max(score[e] for e in may)
        # Deeper containers first as long as they hold nearly all; a later element never beats an equal earlier one.
        ranked = sorted(may, key=lambda e: (score[e] < DEEPEST * top, -depth[e] if score[e] >= DEEPEST * top else 0, -score[e], e))[:CANDIDATES]
        weights = [float(score[e]) / 2**k for k, e in enumerate(ranked)]
        total = sum(weights)
        return [(e, w / total) for e, w in zip(ranked, weights)]

    def path(self, element: int) -> str:
        labels = []
        while element > 0:
            labels.append(self.label[element])
            element = self.parent[element]
        return ">".join(reversed(labels))

    def text(self, winners: list[int]) -> str:
        """Blocks of all containers on the first of ``winners`` (path keys) that holds text here; without one, of the page's best container."""
        has = set()
        for element, _, _ in self.blocks:
            if self.stays(element):
                while element >= 0 and element not in has:
                    has.add(element)
                    element = self.parent[element]
        keys = {self.key[e] for e in has if e == 0 or self.tag[e] in CONTAINERS}
        chosen = next((w & _MASK for w in winners if w & _MASK in keys), None)
        if chosen is None:
            own = self.best()
            inside = [bool(own) and e == own[0][0] for e in range(len(self.parent))]
        else:
            inside = [k == chosen for k in self.key]
        for e in range(1, len(inside)):
            inside[e] = inside[e] or inside[self.parent[e]]
        return "\n".join(text for element, text, _ in self.blocks if inside[element] and self.stays(element))


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


_VOTES = "array<struct<path:string,key:long,weight:double>>"


def _ballots(markup: pd.Series) -> pd.Series:
    out = []
    for m in markup:
        page = Page(m)
        out.append([{"path": page.path(e), "key": _signed(page.key[e]), "weight": w} for e, w in page.best()])
    return pd.Series(out, dtype=object)


def _taken(markup: pd.Series, winners: pd.Series) -> pd.Series:
    return pd.Series([Page(m).text([] if w is None else [int(x) for x in w]) for m, w in zip(markup, winners)], dtype=object)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty where there is none."""
    authority = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s]*)", 1)
    return F.regexp_replace(authority, r"^.*@|:[0-9]*$", "")


def votes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, key, path, votes): the votes of each host's pages for generalised container paths."""
    ballots = pages.select(host_of(F.col(url_col)).alias("host"), F.explode(F.pandas_udf(_ballots, _VOTES)(F.col(html_col))).alias("v"))
    # Votes are summed as integers, so that the order of rows changes nothing.
    weight = F.round(F.col("v.weight") * 1_000_000).cast("long")
    return ballots.groupBy("host", F.col("v.key").alias("key")).agg(F.min("v.path").alias("path"), F.sum(weight).alias("votes"))


def winners(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, winners): keys of the paths with at least ``share`` of a host's votes, most votes first."""
    total = counted.groupBy("host").agg(F.sum("votes").alias("all"))
    kept = counted.join(total, "host").filter(F.col("votes") >= F.col("all") * share)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path", "key")))
    return kept.groupBy("host").agg(F.transform(ranked, lambda x: x["key"]).alias("winners"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text (main text, blocks joined by a line feed; empty if there is none) and n_chars, its code points.

    Null or empty markup gives an empty text; pages without a host (null or odd URLs) vote among themselves; repeated rows are each a page with a vote;
    an empty table gives no rows. Other columns are not read. ``br`` counts as white space, and white space is what Unicode calls so.
    Headers go, but a heading inside the header of an article stays.
    """
    held = Staging(pages.sparkSession, "pages")
    won = held.keep(winners(votes(pages, url_col, html_col)), "winners")
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = bounded_join(plain, won, "host", won.count())
    told = joined.select("id", "url", F.pandas_udf(_taken, "string")(F.col("html"), F.col("winners")).alias("text"))
    return told.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def report(pages: DataFrame) -> DataFrame:
    return extract(pages)
