"""Source divergence, n-gram join and spelling variants against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests_helpers import brute_components

from fleetwright.llm import divergence, ngram_join, spelling
from fleetwright.llm.common import packed, unpacked
from fleetwright.llm.fm_index import WordIndex

SF = "/root/testdata/sf0.001"
# Columns beyond those of the documents clash with names that the operators use themselves.
EXTRA = "node int, term string, word string, n int, component string, block int, hub int, value int"


def table(spark, rows):
    schema = f"doc_id bigint, text string, lang string, source string, {EXTRA}"
    return spark.createDataFrame([(*r, 1, "t", "w", 2, "c", 3, 4, 5) for r in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one two", None, "b"),
        (5, "one two", "en", "b"), (5, "one two", "en", "b"), (None, "ONE two", "en", None),
        (None, "alone without a number here", "en", "b"), (7, "longest " * 60_000 + "end", "en", "a"),
        (8, "x" * 100_000, "de", "a"), (9, "123 456 !!", "fr", "c"), (10, "one two", "en", "c"),
    ]
    return table(spark, rows)


# Source divergence


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_divergence(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (c[t] + 2) // total for t in kept]

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pairs = [(-sum((a - b) ** 2 // (a + b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            terms = [
                (-((a - b) ** 2 // (a + b)), t)
                for t, a, b in zip(kept, p[s], q, strict=True)
                if counts[lang, s][t] > 0 and a > b
            ]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize(("min_docs", "options"), [(10, {}), (2, {"block_bytes": 2000, "cells": 50})])
def test_divergence(spark, min_docs, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = divergence.source_divergence(docs, min_docs=min_docs, **options).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_divergence(rows, min_docs, 10)


def test_divergence_odd(spark, odd):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    for min_docs in (1, 2, 100):
        got = divergence.source_divergence(odd, min_docs=min_docs, block_bytes=100).collect()
        assert {tuple(r) for r in got} == brute_divergence(rows, min_docs, 10)
    assert divergence.source_divergence(odd.limit(0)).count() == 0


def test_divergence_of_equal_rows(spark):
    """One source with nearly all rows, all of them alike."""
    rows = [(1, "same words", "en", "hot")] * 3000 + [(2, "other words", "en", "small")] * 20
    got = divergence.source_divergence(table(spark, rows), block_bytes=500).collect()
    assert {tuple(r) for r in got} == brute_divergence([r[1:] for r in rows], 10, 10)


def test_huge_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "ab  cd\tabcdefghijklmnop ab\n" * 3
    block = divergence._Block()
    block.add("en", "a", text)
    words = Counter(text.split())
    names = [c.decode() for c in block.chunks]
    got = dict(zip([names[i] for i in block.entries[0]], block.counts[0].tolist(), strict=True))
    assert got == words


def test_packed_numbers():
    for values in ([], [0], [1, -1, 2**62, 300]):
        assert unpacked(packed(np.array(values, dtype=np.int64))).tolist() == values


# N-gram join


def joined(docs, **options):
    rows = ngram_join.ngram_join(docs, **options).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}, len(rows)


def test_ngram_join(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 4, 85)
    for options in ({}, {"short": 2, "hubs": 1, "block_values": 500}):
        assert joined(docs, **options) == (want, len(want))


def family(rng, names, size, words, low, high, ring=False):
    """Texts that differ from one text, or each from the one before, in `low` to `high` words."""
    base = [rng.choice(names) for _ in range(words)]
    for _ in range(size):
        text = list(base)
        for at in rng.sample(range(words), rng.randint(low, high)):
            text[at] = rng.choice(names)
        if ring:
            base = text
        yield " ".join(text)


@pytest.mark.parametrize("options", [{}, {"short": 3, "block_values": 2000}, {"short": 3, "hubs": 3}])
def test_ngram_join_of_families(spark, options):
    """Families around the threshold, chains whose ends are far apart, and a passage that many texts share."""
    rng = random.Random(5)
    names = [f"w{i}" for i in range(3000)]
    texts = [
        *family(rng, names, 60, 120, 0, 8),
        *family(rng, names, 60, 120, 2, 5),
        *family(rng, names, 50, 100, 1, 3, ring=True),
        *family(rng, names, 40, 12, 0, 1),
    ]
    passage = " ".join(rng.choice(names) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(names) for _ in range(rng.randint(1, 40))) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_components(list(enumerate(texts)), 4, 85)
    assert joined(docs, **options)[0] == want


def test_ngram_join_odd(spark, odd):
    got = ngram_join.ngram_join(odd).collect()
    assert len(got) == odd.count()
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got}
    assert found == {
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, 4), (None, 2, None),
        (7, 2, 7), (8, 1, 8), (9, 1, 9), (10, 1, 4),
    }
    assert ngram_join.ngram_join(odd.limit(0)).count() == 0
    names = odd.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert ("d10", 1, "d10") in {tuple(r) for r in ngram_join.ngram_join(names).collect()}


def test_prefixes_meet_in_every_order():
    """Sets at the threshold share a prefix value, whatever the order."""
    rng = np.random.default_rng(3)
    levels = rng.integers(0, 9, (2, ngram_join.SLOTS)).astype(np.uint8)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        values = np.unique(rng.integers(0, 1 << 62, n + 40).astype(np.uint64))
        one = values[:n]
        for size in range(-(-n * 85 // 100), n + 1):
            # A part of the set, as small as the threshold lets it be.
            two = rng.permutation(one)[:size]
            two.sort()
            first = [
                ngram_join.rare_first(x, levels)[0][: ngram_join.prefix_length(len(x), 85)] for x in (one, two)
            ]
            assert len(np.intersect1d(*first))


def test_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    for _ in range(300):
        values = np.unique(rng.integers(0, 1 << 62, int(rng.integers(2, 400))).astype(np.uint64))
        one, two = (np.sort(rng.permutation(values)[: int(rng.integers(1, len(values) + 1))]) for _ in range(2))
        both = len(np.intersect1d(one, two))
        apart = len(one) + len(two) - 2 * both
        found = ngram_join.differences(*[pd.Series([ngram_join.sketch(x)]) for x in (one, two)])
        assert found[0] <= apart and (found[0] - apart) % 2 == 0
        linked = 100 * both >= 85 * (len(one) + len(two) - both)
        assert linked == (apart <= ngram_join.most_apart(len(one) + len(two), 85))


def test_ngram_join_reads_few_full_sets(spark, monkeypatch):
    """Texts that share most of their shingles, too few for a link: no full set is moved."""
    rng = random.Random(9)
    names = [f"w{i}" for i in range(100_000)]
    passage = [rng.choice(names) for _ in range(100)]
    texts = [" ".join(passage + [rng.choice(names) for _ in range(17)]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    full_sets, asked = ngram_join.full_sets, []

    def counting(docs, counted, wanted, width):
        asked.append(wanted.count())
        return full_sets(docs, counted, wanted, width)

    monkeypatch.setattr(ngram_join, "full_sets", counting)
    want = brute_components(list(enumerate(texts)), 4, 85)
    assert joined(docs)[0] == want == {i: (114, i) for i in range(60)}
    assert sum(asked) == 0


@pytest.mark.parametrize(("tiles", "block_values"), [(1, 300), (2, 1000), (16, 1_000_000)])
def test_linked_sets_meet_in_blocks(spark, monkeypatch, tiles, block_values):
    """One family of open sets, of many sizes: all links are between the sides of a pair of tiles."""
    monkeypatch.setattr(ngram_join, "_TILES", tiles)
    rng = random.Random(11)
    names = [f"w{i}" for i in range(20_000)]
    texts = [t for _ in range(12) for t in family(rng, names, 4, rng.randint(5, 200), 0, 3)]
    docs = spark.createDataFrame([(t,) for t in set(texts)], "text string")
    levels = np.zeros((2, ngram_join.SLOTS), np.uint8)
    nodes = ngram_join.distinct_nodes(ngram_join.prefixes(docs, 4, 85, levels))
    rows = nodes.collect()
    node_of = {bytes(r["set_key"]): r["node"] for r in rows}
    members = nodes.select(F.lit(rows[0]["node"]).alias("family"), "node", F.col("node").alias("component"))
    members = members.withColumn("is_open", F.col("node") != F.col("family"))
    met = ngram_join.block_candidates(members, nodes, 85, block_values).collect()
    held = defaultdict(lambda: (set(), set()))
    for r in met:
        held[tuple(r[c] for c in ngram_join.CELL)][r["is_open"]].add(r["node"])
    sets = {node_of[ngram_join.set_key(v)]: set(v.tolist()) for v in ngram_join.shingle_sets(texts, 4)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert links
    for a, b in links:
        assert any((a in two and b in one) or (b in two and a in one) for one, two in held.values())
    assert len(held) > 3 or tiles == 16


# Spelling variants


def brute_spelling(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if check % spelling.NOISE == 0:
                at = check % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    by_half = defaultdict(set)
    for w in words:
        for size in {len(w) // 2, (len(w) - 1) // 2, (len(w) + 1) // 2}:
            by_half[w[:size]].add(w)
            by_half["$" + w[len(w) - size :]].add(w)
    found = {}
    for w, n in words.items():
        half = len(w) // 2
        others = by_half[w[:half]] | by_half["$" + w[half:]] | by_half["$" + w[half + 1 :]]
        close = sorted((o for o in others if o != w and near(w, o)), key=lambda o: (-words[o], o))
        best = close[0] if close and words[close[0]] >= 5 * n else None
        found[w] = (best, n, len(close))
    out = set()
    for w, (form, n, close) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out.add((w, form, root, n, close, words[form] if form else None))
    return out


@pytest.mark.parametrize("shard_words", [spelling.SHARD_WORDS, 40])
def test_spelling(spark, shard_words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = spelling.spelling_variants(docs, shard_words=shard_words).collect()
    assert len(got) == len({r["word"] for r in got})
    assert {tuple(r) for r in got} == brute_spelling([(r.doc_id, r.text) for r in docs.collect()])


def test_spelling_of_similar_words(spark):
    """Many words that share beginnings and endings; chains of forms; ties."""
    rng = random.Random(7)
    words = {"".join(rng.choice("abàé") for _ in range(rng.randint(2, 5))) for _ in range(60)}
    words = ["pre" + w + "ing" for w in sorted(words)] + ["aaaaaaa", "aaaaaa", "bbbbbbbb", "bbbbbbb", "abbbbbbb"]
    texts = [(i, " ".join(rng.choices(words, k=400, weights=[5 ** (k % 5) for k in range(len(words))]))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = brute_spelling(texts)
    assert any(w[1] and w[1] != w[2] for w in want)
    for shard_words in (spelling.SHARD_WORDS, 7):
        assert {tuple(r) for r in spelling.spelling_variants(docs, shard_words=shard_words).collect()} == want


def test_spelling_odd(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in spelling.spelling_variants(odd).collect()} == brute_spelling(rows)
    many = table(spark, [(i, "y" * 20_000 + " " + "y" * 19_999, "en", "a") for i in range(5)] + [(None, None, None, None)])
    want = brute_spelling([(r.doc_id, r.text) for r in many.collect()])
    assert {tuple(r) for r in spelling.spelling_variants(many).collect()} == want
    assert spelling.spelling_variants(odd.limit(0)).count() == 0


def test_index_equals_brute_force():
    rng = random.Random(1)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    for _ in range(20):
        words = list({"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))) for _ in range(120)})
        asked = [*words, "zzz", "abz"]
        got = [(asked[i], words[j]) for a, b in WordIndex(words).one_error(asked) for i, j in zip(a, b, strict=True)]
        assert set(got) == {(a, b) for a in asked for b in words if near(a, b)}
    assert list(WordIndex([]).one_error(["abc"])) == []
