"""How far the sources of a language are from each other, by chunk factorization.

1. Documents are put in ranges of lang and source, so that a block of them has few sources; ranges
   are of equal size, whatever the largest source. A block is cut into chunks at white space. It
   keeps its distinct chunks and, per document, the numbers of its chunks with their counts (a
   sparse matrix in a byte or two per entry). A chunk that is in every document is one row per
   block, not one per document.
2. Each globally distinct chunk is split into terms once.
3. The terms are joined back to the chunks of each block; the block's matrix turns them into
   distinct documents and occurrences per (lang, source, term), which are then added up.
4. Terms in at least `min_docs` documents of a language make its vocabulary. Smoothed shares of
   the terms, as whole numbers per thousand million, are compared between sources (`pair`) and
   with the whole language (`term`).

All arithmetic is on whole numbers. Null text, lang and source count as empty. Every row is a
document, so repeated rows count each. Columns other than text, lang and source are ignored.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.llm.common import packed, store, unpacked

# Letters: runs of a-z and of characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000
MIN_DOCS = 10
TOP = 10
BLOCK_BYTES = 32 << 20
PIECE = 1 << 20
# Cells of the (source, term) matrix that one task compares.
CELLS = 1 << 17
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK = (
    "block bigint, groups array<struct<lang:string,source:string>>, doc_group binary, doc_entries binary, "
    "ids binary, counts binary, chunks array<string>"
)


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end at white space, so that the words of a huge text are never all objects."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, min(at + PIECE, len(data)))
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


class _Block:
    def __init__(self) -> None:
        self.chunks: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.groups: defaultdict[tuple[str, str], int] = defaultdict(count().__next__)
        self.doc_group: list[int] = []
        self.entries: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, lang: str, source: str, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        number = self.chunks.__getitem__
        parts = []
        for piece in _pieces(data):
            words = piece.split()
            parts.append(np.unique(np.fromiter(map(number, words), np.int64, len(words)), return_counts=True))
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        seen = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        if len(parts) > 1:
            ids, seen = add_up(ids, seen)
        self.doc_group.append(self.groups[lang, source])
        self.entries.append(ids)
        self.counts.append(seen)
        self.bytes += len(data)

    def frame(self, block: int) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "block": [block],
                "groups": [[{"lang": a, "source": b} for a, b in self.groups]],
                "doc_group": [packed(np.array(self.doc_group))],
                "doc_entries": [packed(np.array([len(e) for e in self.entries]))],
                # Numbers ascend within a document, so that their steps are small.
                "ids": [packed(np.concatenate([np.diff(e, prepend=0) for e in self.entries]))],
                "counts": [packed(np.concatenate(self.counts))],
                "chunks": [[c.decode("utf-8", "surrogatepass") for c in self.chunks]],
            }
        )


def add_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first)


def chunk_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents: distinct chunks, and per document the chunks' numbers and counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        block = _Block()
        for frame in frames:
            for row in frame.itertuples(index=False):
                block.add(row.lang, row.source, row.text)
                if block.bytes >= block_bytes:
                    yield block.frame(number)
                    block, number = _Block(), number + 1
        if block.doc_group:
            yield block.frame(number)

    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # The running number cuts a source of any size into ranges, also where all its texts are equal.
    dealt = texts.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("lang", "source", "at")
    return dealt.select("lang", "source", "text").mapInPandas(run, _BLOCK)


def chunk_terms(chunks: DataFrame) -> DataFrame:
    """(chunk, term): the terms of each distinct chunk, repeated as often as the chunk has them."""
    lower = F.translate("chunk", string.ascii_uppercase, string.ascii_lowercase)
    return chunks.distinct().select("chunk", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))


def _count_block(block: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
    """Documents and occurrences of each (lang, source, term) of one block."""
    names = ["lang", "source", "term", "docs", "occurrences"]
    if not len(block) or not len(terms):
        return pd.DataFrame([], columns=names)
    row = block.iloc[0]
    steps, counts, entries, group_of = (unpacked(row[c]) for c in ("ids", "counts", "doc_entries", "doc_group"))
    doc = np.repeat(np.arange(len(entries)), entries)
    sums = np.concatenate(([0], np.cumsum(steps)))
    ids = sums[1:] - np.repeat(sums[np.cumsum(entries) - entries], entries)
    codes, words = pd.factorize(terms["term"])
    at = terms["pos"].to_numpy()
    order = np.argsort(at, kind="stable")
    at, codes = at[order], codes[order].astype(np.int64)
    first, last = np.searchsorted(at, ids, "left"), np.searchsorted(at, ids, "right")
    times = last - first
    entry = np.repeat(np.arange(len(ids)), times)
    step = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
    width = len(words)
    keys, seen = add_up(doc[entry] * width + codes[first[entry] + step], counts[entry])
    cells = group_of[keys // width] * width + keys % width
    found, docs = add_up(cells, np.ones(len(cells), np.int64))
    occurrences = add_up(cells, seen)[1]
    groups = list(row["groups"])
    side = [groups[g] for g in found // width]
    return pd.DataFrame(
        {
            "lang": [g["lang"] for g in side],
            "source": [g["source"] for g in side],
            "term": np.asarray(words, dtype=object)[found % width],
            "docs": docs,
            "occurrences": occurrences,
        }
    )


def term_counts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, source, term, docs, occurrences over all documents."""
    blocks = store(chunk_blocks(docs, block_bytes), "chunk-blocks")
    places = blocks.select(F.col("block").alias("of"), F.posexplode("chunks").alias("pos", "chunk"))
    terms = places.join(chunk_terms(places.select("chunk")), "chunk").select("of", "pos", "term")
    matrices = blocks.drop("chunks")
    schema = "lang string, source string, term string, docs bigint, occurrences bigint"
    parts = matrices.groupBy("block").cogroup(terms.groupBy("of")).applyInPandas(_count_block, schema)
    return parts.groupBy("lang", "source", "term").agg(
        F.sum("docs").alias("docs"), F.sum("occurrences").alias("occurrences")
    )


def share(occurrences: str, total: str, vocabulary: str) -> Column:
    """Smoothed share of a term per thousand million, at least 1; exact for any count."""
    return F.expr(f"1 + ({UNIT} * cast({occurrences} + 2 as decimal(28,0))) div ({total} + 2 * {vocabulary})")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _compare_sources(counted: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Summed divergence of every ordered pair of a language's sources over one bucket of terms."""
    names = groups["item"].tolist()
    lang = groups["of"].iloc[0]
    rows = {name: i for i, name in enumerate(names)}
    codes, words = pd.factorize(counted["term"])
    shares = np.repeat(groups["zero_share"].to_numpy(np.int64)[:, None], len(words), axis=1)
    shares[[rows[s] for s in counted["source"]], codes] = counted["p"].to_numpy(np.int64)
    parts = []
    for i, name in enumerate(names):
        gap = shares - shares[i]
        value = (gap * gap // (shares + shares[i])).sum(axis=1)
        parts.append(pd.DataFrame({"lang": lang, "source": name, "item": names, "value": value}).drop(index=i))
    return pd.concat(parts)


def source_divergence(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, block_bytes: int = BLOCK_BYTES, cells: int = CELLS
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: for each ordered pair of sources of a language, the divergence summed over its
    whole vocabulary (0 without one). Part `term`: the `top` terms of a source whose share is
    above the language's. Ranks go by value, then by item in UTF-8 order. An empty table gives
    no rows; a language with one source has no pairs.
    """
    counts = store(term_counts(docs, block_bytes), "term-counts")
    vocabulary = store(
        counts.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("occurrences").alias("lang_occurrences"))
        .where(F.col("docs") >= min_docs)
        .select("lang", "term", "lang_occurrences"),
        "vocabulary",
    )
    kept = store(counts.join(vocabulary, ["lang", "term"]).drop("docs"), "kept-terms")
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_occurrences").alias("lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("n"))
    zero = F.lit(0).cast("bigint")
    sources = named.groupBy("lang").agg(F.count("*").alias("sources"))
    groups = store(
        named.join(sizes, "lang", "left")
        .join(totals, ["lang", "source"], "left")
        .join(sources, "lang")
        .select("lang", "source", "sources", *[F.coalesce(c, zero).alias(c) for c in ("v", "lang_n", "n")])
        .withColumn("buckets", F.greatest(F.ceil(F.col("v") * F.col("sources") / F.lit(cells)), F.lit(1)).cast("int")),
        "groups",
    )
    shares = kept.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        "occurrences",
        F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"),
        share("occurrences", "n", "v").alias("p"),
        share("lang_occurrences", "lang_n", "v").alias("q"),
    )

    # Without a vocabulary there is nothing to divide by, and nothing that reads the share.
    none = F.when(F.col("v") > 0, F.expr(f"1 + ({UNIT} * 2L) div (n + 2 * v)")).otherwise(F.lit(1).cast("bigint"))
    every = groups.select(
        F.col("lang").alias("of"),
        F.col("source").alias("item"),
        none.alias("zero_share"),
        F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("part"),
    )
    summed = (
        shares.select("lang", "bucket", "term", "source", "p")
        .groupBy("lang", "bucket")
        .cogroup(every.groupBy("of", "part"))
        .applyInPandas(_compare_sources, "lang string, source string, item string, value bigint")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(order).alias("rank")
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    above = shares.where((F.col("occurrences") > 0) & (F.col("p") > F.col("q"))).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value")
    )
    best = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.union(best)
