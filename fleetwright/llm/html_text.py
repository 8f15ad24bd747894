"""Main text of web pages by consensus on host paths.

Every page scores its containers by the text of their paragraphs, links counting against it, and
votes for the generalised paths (tags and classes without numbers) of its best ones. Votes are
summed per host in Spark, and every page is extracted again along its host's winning paths. A
page on which no winning path leads to a fair share of what its own best container holds uses that.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.llm.common import store

VOTES = 3  # of a page
WINNERS = 5  # of a host
FAIR = 1 / 3  # of the paragraph text of the page's own best container

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?][^>]*+>?",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var",
}
CONTAINERS = {"article", "main", "section", "div", "body", "td", "center"}
DROPPED = {
    "head", "nav", "footer", "aside", "button", "select", "option", "menu", "dialog", "template", "svg",
    "object", "canvas", "audio", "video", "math", "map",
}
UNWANTED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "banner", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer",
    "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "newsletter", "subscribe", "signup",
    "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "reply", "replies",
    "respond", "widget", "toolbar", "pagination", "pager", "masthead", "login", "search",
}
HEADERS = {"header", "topbar"}
MODIFIERS = {"no", "has", "with", "without"}  # "no-sidebar" says nothing about the element itself
# Parts that may well hold more text than the article, and articles of their own.
WORDY = {
    "comment", "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "notice",
    "notices", "popup", "modal", "related", "recommended",
}
WANTED = {"article", "content", "entry", "main", "post", "story", "text"}
# What an opening tag closes, if it is open: paragraphs by any block, items by their like.
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "body": {"head"}}
STOPS = {"ul", "ol", "table", "div", "article", "section", "main", "body", "dl"}


@dataclass
class Page:
    """Elements (parent, path, dropped, weight) and blocks (element, text, characters in links).

    `doubt` names why an element looks unwanted by its words or as a form; `settle` decides.
    """

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    path: list[str] = field(default_factory=list)
    dropped: list[bool] = field(default_factory=list)
    doubt: list[frozenset[str]] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _traits(tag: str, attrs: str, in_article: bool) -> tuple[str, bool, frozenset[str], float]:
    """Label of an element in a path, whether it is surely unwanted, why it may be, its weight."""
    classes, names, hidden = "", "", False
    if attrs.strip():
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "class":
                classes = value
            if name in ("class", "id", "role"):
                names += " " + value
            hidden |= name == "hidden" or (name == "style" and "display:none" in value.replace(" ", ""))
    words = set(re.split(r"[^a-z]+", names)) if names else set()
    label = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in classes.split()} - {""})])
    doubt = {"form"} if tag == "form" else set()
    if tag not in ("html", "body") and words & (UNWANTED | HEADERS) or tag == "header":
        said = [re.split(r"[^a-z]+", token) for token in names.split()]
        own = {tag}.union(*(takewhile(lambda w: w not in MODIFIERS, s) for s in said))
        doubt |= own & (UNWANTED if in_article else UNWANTED | HEADERS)
    bad = tag in DROPPED or hidden
    weight = {"article": 1.5, "main": 1.2}.get(tag, 1.25 if words & WANTED else 1.0)
    return label, bad, frozenset(doubt), weight


def _value(text: str, links: int) -> float:
    return max(0.0, len(text) - 3.0 * links)


def parse(source: str) -> Page:
    """Elements and text blocks of a page, however broken its markup is."""
    page = Page()
    page.parent.append(-1), page.tag.append("html"), page.path.append(""), page.dropped.append(False), page.weight.append(0.5)
    page.doubt.append(frozenset())
    stack, texts, links, depth_a, in_article = [0], [], 0, 0, 0

    def flush() -> None:
        nonlocal texts, links
        text = " ".join("".join(texts).split())
        if text:
            page.blocks.append((stack[-1], text, links))
        texts, links = [], 0

    def close_to(size: int) -> None:
        nonlocal in_article
        flush()
        for node in stack[size:]:
            in_article -= page.tag[node] == "article"
        del stack[size:]

    def close(names: set[str], stops: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if page.tag[stack[i]] in names:
                close_to(i)
                return
            if page.tag[stack[i]] in stops:
                return

    at, end = 0, len(source)
    while at < end:
        less = source.find("<", at)
        piece = source[at : less if less >= 0 else end]
        found = _TAG.match(source, less) if less >= 0 else None
        if less >= 0 and found is None:
            piece += "<"
        if piece:
            text = html_lib.unescape(piece) if "&" in piece else piece
            texts.append(text)
            links += len(text.strip()) if depth_a else 0
        if less < 0:
            break
        if found is None:
            at = less + 1
            continue
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(found[1] or found[4]), found[3] or found[6] or ""
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = stop.end() if stop else end
            continue
        if name == "br":
            texts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                depth_a = 0 if closing else 1
            continue
        flush()
        if name in VOID or name == "html":
            continue
        depth_a = 0
        if closing:
            close({name}, {"td", "table"} - {name} if name in ("p", "li") else set())
            continue
        close({"p"}, STOPS | {"li", "td"})
        if name in CLOSES:
            close(CLOSES[name], STOPS - CLOSES[name] - {"div"})
        label, bad, doubt, weight = _traits(name, attrs, in_article > 0)
        up = stack[-1]
        in_article += name == "article"
        page.parent.append(up)
        page.tag.append(name)
        page.path.append(f"{page.path[up]}>{label}" if name in CONTAINERS else page.path[up])
        page.dropped.append(page.dropped[up] or bad)
        page.doubt.append(doubt)
        page.weight.append(weight)
        stack.append(len(page.tag) - 1)
    flush()
    settle(page)
    return page


def settle(page: Page) -> None:
    """Drop what is in doubt, except what holds the page's article or most of its paragraphs.

    If no paragraph is left then, nothing is dropped for its words.
    """
    if not any(page.doubt):
        return
    nodes = range(len(page.tag))
    held = [0.0] * len(nodes)
    for node, text, links in page.blocks:
        held[node] += 0.0 if page.dropped[node] else _value(text, links)
    own = list(held)
    articles = [
        tag in ("article", "main") and not page.dropped[n] and not page.doubt[n] for n, tag in enumerate(page.tag)
    ]
    above = list(articles)
    for node in reversed(nodes[1:]):
        held[page.parent[node]] += held[node]
        above[page.parent[node]] |= above[node]
    doubtful = [bool(d) and page.tag[n] not in ("article", "main") for n, d in enumerate(page.doubt)]

    def inherited(flags: list[bool]) -> list[bool]:
        out = list(flags)
        for node in nodes[1:]:
            out[node] |= out[page.parent[node]]
        return out

    inside = inherited(doubtful)
    free = any(a and not i and held[n] > 0 for n, (a, i) in enumerate(zip(articles, inside, strict=True)))
    for node in nodes:
        if doubtful[node] and not page.doubt[node] & WORDY:
            most = held[node] * 2 > held[0]
            doubtful[node] = not (most or (above[node] and held[node] > 0 and not free))
    dropped = [a or b for a, b in zip(page.dropped, inherited(doubtful), strict=True)]
    if any(v > 0 and not d for v, d in zip(own, dropped, strict=True)) or not held[0]:
        page.dropped = dropped


def scores(page: Page) -> dict[int, float]:
    """Score of each container: text of its paragraphs, and half of that of its child containers."""
    out: dict[int, float] = {}
    for node, text, links in page.blocks:
        if page.dropped[node]:
            continue
        value, share = _value(text, links), 1.0
        while node >= 0 and share >= 0.25:
            if page.tag[node] in CONTAINERS:
                out[node] = out.get(node, 0.0) + value * share * page.weight[node]
                share /= 2
            node = page.parent[node]
    return {n: s for n, s in out.items() if s > 0}


def votes(source: str) -> list[tuple[str, float]]:
    """Paths of the page's best containers and their shares of its score."""
    page = parse(source)
    by_path: dict[str, float] = {}
    for node, score in scores(page).items():
        by_path[page.path[node]] = max(by_path.get(page.path[node], 0.0), score)
    best = sorted(by_path.items(), key=lambda x: (-x[1], x[0]))[:VOTES]
    total = sum(s for _, s in best)
    return [(p, round(s / total, 6)) for p, s in best]


def _blocks(page: Page, chosen: set[int]) -> list[tuple[str, int]]:
    inside = [False] * len(page.tag)
    for node, up in enumerate(page.parent):
        inside[node] = node in chosen or (up >= 0 and inside[up])
    return [(t, links) for node, t, links in page.blocks if inside[node] and not page.dropped[node]]


def _below(page: Page, chosen: set[int]) -> str:
    return "\n\n".join(t for t, _ in _blocks(page, chosen))


def _worth(page: Page, chosen: set[int]) -> float:
    return sum(_value(t, links) for t, links in _blocks(page, chosen))


def main_text(source: str, winners: list[str]) -> tuple[str, str | None]:
    """Blocks of the main text joined by empty lines, and the path used."""
    page = parse(source)
    score = scores(page)
    if not score:
        return _below(page, {0}), None
    best = max(score, key=lambda n: (score[n], -n))
    least, refused = FAIR * _worth(page, {best}), []
    for path in winners:
        if any(r.startswith(path + ">") for r in refused):
            continue  # won as what surrounds a refused one
        chosen = {n for n, p in enumerate(page.path) if p == path and page.tag[n] in CONTAINERS and n in score}
        if chosen and _worth(page, chosen) >= least:
            return _below(page, chosen), path
        if chosen:
            refused.append(path)
    return _below(page, {best}), page.path[best]


def host_of(url: Column | str) -> Column:
    """Host of a URL in lower case, empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, winners): the paths with the most votes of each host, best first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(h, p, s) for h, x in zip(frame["host"], frame["html"], strict=True) for p, s in votes(x or "")]
            yield pd.DataFrame(rows, columns=["host", "path", "share"])

    cast = pages.select("host", "html").mapInPandas(run, "host string, path string, share double")
    summed = cast.groupBy("host", "path").agg(F.round(F.sum("share"), 4).alias("votes"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    top = summed.withColumn("rank", rank).where(F.col("rank") <= WINNERS)
    listed = F.array_sort(F.collect_list(F.struct("rank", "path")))
    return top.groupBy("host").agg(F.transform(listed, lambda x: x["path"]).alias("winners"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path for every row of `pages` (page_id, url, html).

    Null or empty html gives an empty text; pages without a host share one vote. Repeated rows
    come back repeated. Other columns are ignored.
    """
    keyed = pages.select("page_id", "url", host_of("url").alias("host"), "html")
    winners = store(winning_paths(keyed), "winners")

    @F.pandas_udf("text string, path string")
    def main(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for html, paths in parts:
            got = [main_text(x or "", [] if w is None else list(w)) for x, w in zip(html, paths, strict=True)]
            yield pd.DataFrame(got, columns=["text", "path"])

    found = keyed.join(winners, "host", "left").select("page_id", "url", main("html", "winners").alias("m"))
    return found.select(
        "page_id", "url", "m.text", F.char_length("m.text").cast("bigint").alias("n_chars"), "m.path"
    )
