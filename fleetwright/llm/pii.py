"""Personal data by patterns, and by a skip-chain conditional random field that carries them on.

Patterns find the base spans of four kinds. Then every token with a digit or an @ becomes a node
of its document's graph. Neighbours are linked, and so are mentions that repeat or resemble each
other (same letters and digits, or the same last digits), however far apart: each with the one
before it, so the graph grows with the document. Node potentials come from a token's shape and
surroundings, edge potentials say which labels go together; both are learned in numpy by pseudo-
likelihood on a bounded sample, labelled by the patterns, with shapes hidden at random so that
the links matter. Loopy message passing gives each node's label; confident ones that are no base
span and are linked to a node of their kind become further spans. Base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
SAMPLE_LINES = 64
LINE_CHARS = 2_000
SAMPLE_ROWS = 3000
SURE = 0.9
ROUNDS = 8

Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is tried from its first digit only; a later start could not match more.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    """Whether a number passes the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: for each @, back to the start of the name before it, then the domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Base matches by kind, then start."""
    if not _MARK.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:  # 19 digits and 18 separators
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@dataclass
class Tokens:
    """The marked tokens of a document: spans, keys of likeness, features, neighbour links."""

    starts: list[int]
    ends: list[int]
    features: list[list[str]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'<>[]{}"


def _shape(word: str) -> str:
    """Digits as 9, letters as a, runs of three and more as one."""
    out, last, run = [], "", 0
    for c in word[:64]:
        c = "9" if c.isdigit() else "a" if c.isalpha() else c
        run = run + 1 if c == last else 1
        last = c
        if run <= 3:
            out.append(c)
    return "".join(out)


def tokens(text: str) -> Tokens:
    """Tokens with a digit or @ of a whole text, and the links between them."""
    starts, ends, words = [], [], []
    at = 0
    while found := _MARK.search(text, at):
        low = found.start()
        while low > at and not (text[low - 1] == " " or "\t" <= text[low - 1] <= "\r"):
            low -= 1
        high = _WORD.match(text, found.start()).end()
        a, b = low, high
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b:
            starts.append(a), ends.append(b), words.append(text[a:b])
        at = high
    features, chain, skip = [], [], []
    latest: dict[str, int] = {}
    for i, word in enumerate(words):
        digits = "".join(c for c in word if c in "0123456789")
        core = "".join(c for c in word if c.isalnum() or c == "@").lower()
        before = text[max(0, starts[i] - 1) : starts[i]]
        own = ["bias", f"s={_shape(word)}", f"d={min(len(digits), 20)}", f"@={'@' in word}", f".={min(word.count('.'), 4)}", f"+={word[0] == '+' or before == '+'}"]
        near = i > 0 and starts[i] - ends[i - 1] <= 2
        own.append(f"p={_shape(words[i - 1])}" if near else "p=")
        features.append(own)
        if near:
            chain.append((i - 1, i))
            features[i - 1].append(f"n={_shape(word)}")
        keys = {f"c{core}"} if len(core) >= 6 else set()
        if len(digits) >= 7:
            keys.add(f"t{digits[-7:]}")
        if near and len(keys) == 0:
            joined = "".join(c for c in words[i - 1] + word if c in "0123456789")
            if len(joined) >= 7:
                keys.add(f"t{joined[-7:]}")
        linked = set()
        for key in sorted(keys):
            if key in latest and latest[key] not in linked and latest[key] != i - 1:
                skip.append((latest[key], i))
                linked.add(latest[key])
            latest[key] = i
    for i in range(len(words)):
        if not any(f.startswith("n=") for f in features[i]):
            features[i].append("n=")
    return Tokens(starts, ends, features, chain, skip)


def token_labels(found: Tokens, spans: list[Span]) -> np.ndarray:
    """Label of each token: the kind of the base span that it touches, else 0."""
    out = np.zeros(len(found.starts), dtype=np.int64)
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        low = np.searchsorted(found.ends, a, side="right")
        while low < len(out) and found.starts[low] < b:
            out[low] = kind + 1
            low += 1
    return out


@dataclass(frozen=True)
class Field:
    """Weights: per feature and label, and per pair of labels for both kinds of edges."""

    nodes: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray


def train(texts: list[str], *, epochs: int = 12, hide: float = 0.35, seed: int = 3) -> Field:
    """Pseudo-likelihood by gradient steps; repeatable for the same texts."""
    n_labels = len(LABELS)
    names: dict[str, int] = {}
    rows, cols, gold, ends = [], [], [], {"chain": [], "skip": []}
    base = 0
    for text in texts:
        found = tokens(text)
        gold.append(token_labels(found, base_spans(text)))
        for i, own in enumerate(found.features):
            for f in own:
                rows.append(base + i)
                cols.append(names.setdefault(f, len(names)))
        ends["chain"] += [(base + a, base + b) for a, b in found.chain]
        ends["skip"] += [(base + a, base + b) for a, b in found.skip]
        base += len(found.starts)
    y = np.concatenate(gold) if gold else np.zeros(0, dtype=np.int64)
    rows, cols = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
    w = np.zeros((len(names), n_labels))
    pair = {k: np.zeros((n_labels, n_labels)) for k in ends}
    edge = {k: np.array(v, dtype=np.int64).reshape(-1, 2) for k, v in ends.items()}
    rng = np.random.default_rng(seed)
    target = np.eye(n_labels)[y]
    counts = np.maximum(np.bincount(cols, minlength=len(names)), 1)[:, None] if len(names) else 1
    for _ in range(epochs * 10 if len(y) else 0):
        # Whole tokens lose all their features but the bias, so that their links must tell.
        dark = rng.random(len(y)) < hide
        live = ~dark[rows] | (cols == names["bias"])
        z = np.zeros((len(y), n_labels))
        np.add.at(z, rows[live], w[cols[live]])
        for k, e in edge.items():
            np.add.at(z, e[:, 0], pair[k][:, y[e[:, 1]]].T)
            np.add.at(z, e[:, 1], pair[k][y[e[:, 0]]])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = target - p / p.sum(axis=1, keepdims=True)
        g = np.zeros_like(w)
        np.add.at(g, cols[live], off[rows[live]])
        w += 1.0 * g / np.sqrt(counts) / 4 - 0.002 * w
        for k, e in edge.items():
            if len(e):
                step = target[e[:, 0]].T @ off[e[:, 1]] + off[e[:, 0]].T @ target[e[:, 1]]
                pair[k] += step / np.sqrt(len(e)) / 4 - 0.002 * pair[k]
    return Field({f: w[i] for f, i in names.items()}, pair["chain"], pair["skip"])


def marginals(model: Field, found: Tokens, known: np.ndarray) -> np.ndarray:
    """(tokens, labels): beliefs after loopy message passing. Tokens with a base label (`known`
    above 0) are held at it."""
    n, n_labels = len(found.starts), len(LABELS)
    unary = np.zeros((n, n_labels))
    for i, own in enumerate(found.features):
        for f in own:
            if f in model.nodes:
                unary[i] += model.nodes[f]
    unary[known > 0] = -30.0
    unary[np.flatnonzero(known), known[known > 0]] = 30.0
    edges = np.array(found.chain + found.skip, dtype=np.int64).reshape(-1, 2)
    pots = np.concatenate([np.broadcast_to(p, (m, n_labels, n_labels)) for p, m in ((model.chain, len(found.chain)), (model.skip, len(found.skip)))])
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(src), n_labels))
    belief = unary.copy()
    for _ in range(ROUNDS if len(src) else 0):
        cavity = belief[src] - messages[back]
        grid = cavity[:, :, None] + pots
        top = grid.max(axis=1, keepdims=True)
        new = np.log(np.exp(grid - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        messages = 0.5 * messages + 0.5 * new
        belief = unary.copy()
        np.add.at(belief, dst, messages)
    p = np.exp(belief - belief.max(axis=1, keepdims=True)) if n else belief
    return p / p.sum(axis=1, keepdims=True) if n else p


def added_spans(model: Field, text: str, base: list[Span]) -> list[Span]:
    """Spans that the field adds: tokens outside base spans whose label is sure and shared with
    a linked mention; neighbours of one kind are one span."""
    if not base:
        return []  # a kind can only be carried on from a base span
    found = tokens(text)
    if not found.skip:
        return []
    known = token_labels(found, base)
    p = marginals(model, found, known)
    label = np.where((known == 0) & (p.max(axis=1) >= SURE), p.argmax(axis=1), 0)
    agreed = known.copy()
    linked: dict[int, list[int]] = {}
    for i, j in found.skip:
        linked.setdefault(i, []).append(j)
        linked.setdefault(j, []).append(i)
    todo = [i for i in linked if agreed[i] > 0]
    while todo:
        i = todo.pop()
        for j in linked[i]:
            if agreed[j] == 0 and label[j] == agreed[i]:
                agreed[j] = label[j]
                todo.append(j)
    near = set(found.chain)
    first = list(range(len(label)))  # of the run of neighbours with one label
    for i in range(1, len(label)):
        if (i - 1, i) in near and known[i - 1] == 0 and label[i - 1] == label[i]:
            first[i] = first[i - 1]
    held = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in held]
    reach = np.maximum.accumulate([b for _, b in held])
    out: list[Span] = []
    for i in np.flatnonzero((agreed > 0) & (known == 0)).tolist():
        low, high = found.starts[first[i]], found.ends[i]
        before = bisect_left(starts, high)
        # Base spans that begin before the end of this one must be over by its begin, and so must
        # the one added last.
        if (before == 0 or reach[before - 1] <= low) and (not out or out[-1][2] <= low):
            out.append((int(agreed[i]) - 1, low, high))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """Train on `sample_rows` texts with a digit or @, or on all there are.

    Those with the smallest hashes of doc_id and text are taken; repeated rows count as one. Of each
    text up to `SAMPLE_LINES` marked lines are used, spread evenly over it, with `LINE_CHARS`
    characters each, so that long texts are drawn as well and the sample stays bounded.
    """
    marked = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("doc_id", "text").alias("key"), "text")
    drawn = marked.select("key").distinct().orderBy("key").limit(sample_rows)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[0-9@]"))
    # Only lines with a marked token are needed, and their order tells nothing.
    shown = F.least(F.size("lines"), F.lit(SAMPLE_LINES))
    place = lambda i: (i * F.size("lines") / shown).cast("int") + 1
    picked = F.transform(F.sequence(F.lit(0), shown - 1), lambda i: F.substring(F.element_at("lines", place(i)), 1, LINE_CHARS))
    found = (
        marked.join(F.broadcast(drawn), "key")  # `sample_rows` numbers
        .select("key", lines.alias("lines"))
        .select("key", F.array_join(picked, "\n").alias("t"))
        .groupBy("key")
        .agg(F.min("t").alias("t"))
    )
    return train(sorted(r["t"] for r in found.collect()))


def find_personal_data(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row.

    Counts and digest are those of the base spans; `spans` holds all, with code point offsets.
    Null texts count as empty. Repeated rows come back repeated. Other columns are ignored.
    """

    @F.pandas_udf("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for text in texts:
                base = base_spans(text or "")
                more = added_spans(model, text, base)
                names = listed(base)
                counts = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                out.append([*counts, hashlib.sha256(names.encode()).hexdigest(), listed(base + more) if more else names, len(more)])
            yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", find("text").alias("f")).select("doc_id", "f.*")
