"""Operators on documents against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_helpers import WORD, brute_components, check_packed

import corpus_pipeline
from fleetwright.llm import langid, mixing, packing, pii
from fleetwright.llm.exact_dedup import directory, exact_dedup, keep_first
from fleetwright.llm import near_dedup as near_dedup_module
from fleetwright.llm.near_dedup import SKETCH, keep_one, least_listed, least_shared, near_dedup
from fleetwright.llm.shingles import PIECE, shingle_sets, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, extra int, size int, target string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "t", "k") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", None, "b"),
        (5, "one", "en", "b"), (5, "one", "en", "b"), (None, "one", "en", None), (None, "two words", "en", "b"),
        (7, "ab " * 60_000 + "end", "en", "a"), (8, "x" * 100_000, "de", "a"), (9, "123 456 !!", "fr", "c"),
    ]
    return rows_of(spark, rows)


def test_exact_dedup(spark, docs):
    for options in ({}, {"key_bits": 4, "bucket_rows": 3}):
        got = {r["doc_id"]: r for r in exact_dedup(docs, **options).collect()}
        groups = {}
        for r in docs.collect():
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r["doc_id"])
        for text, ids in groups.items():
            for i in ids:
                assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(ids), len(ids), i == min(ids))
                assert got[i]["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_odd(spark, odd):
    for options in ({}, {"key_bits": 1}):
        got = exact_dedup(odd, **options).collect()
        assert len(got) == odd.count()
        one = [r for r in got if r["text_sha256"] == hashlib.sha256(b"one").hexdigest()]
        assert [(r["keep_id"], r["group_size"]) for r in one] == [(4, 4)] * 4 and sum(r["kept"] for r in one) == 1
        assert [r["keep_id"] for r in got if r["doc_id"] in (1, 2)] == [1, 1]
        kept = keep_first(odd, **options)
        assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)
    assert exact_dedup(odd.limit(0)).count() == 0


def test_directory_splits(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("key"))
    slots = directory(keys, 100)
    sizes = keys.join(slots, F.shiftrightunsigned("key", 48) == slots["slot"]).groupBy("bucket").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first() == (sizes.agg(F.max("count")).first()[0], 4000)
    assert sizes.agg(F.max("count")).first()[0] <= 100
    assert slots.groupBy("slot").count().where("count > 1").isEmpty()


def test_shingles_of_long_texts():
    text = b"Ab \x0bcd  " * (PIECE // 4)
    long = next(word_hashes([text]))
    short = next(word_hashes([b"aB Cd"]))
    assert len(long) == PIECE // 2 and (long[::2] == short[0]).all() and (long[1::2] == short[1]).all()
    assert [len(s) for s in shingle_sets([None, "", " ", "a", "a b a b"], 2)] == [0, 0, 0, 1, 2]


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, docs, width):
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], width, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup(docs, width=width).collect()}
    assert got == want


def test_near_dedup_families(spark):
    """Copies of one text around the threshold, as a long list with leftovers in small blocks."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(14)):
            at = rng.randrange(len(words))
            if rng.random() < 0.5:
                words[at] = f"v{rng.randrange(10**6)}"
            else:
                del words[at]
        rows.append((i, " ".join(words), "en", "s"))
    want = brute_components([r[:2] for r in rows], 2, 80)
    got = near_dedup(rows_of(spark, rows), width=2, short=4, block_values=4000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_dedup_shuffles_wanted_texts_only(spark, monkeypatch):
    """Texts without a partner go before the shuffle, by a table of bits that loses no wanted key."""
    plans = []
    sets = near_dedup_module.full_sets

    def seen(docs, width):
        plans.append(docs._jdf.queryExecution().executedPlan().toString())
        return sets(docs, width)

    monkeypatch.setattr(near_dedup_module, "full_sets", seen)
    rows = [(i, " ".join(f"w{i // 2 if i < 20 else i}x{j}" for j in range(60)) + (" end" if i % 2 else ""), "en", "s") for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(rows_of(spark, rows), width=2).collect()}
    assert got == {i: i - i % 2 if i < 20 else i for i in range(200)}
    assert "inside(" in plans[0]
    keys = spark.range(5000).select((F.col("id") % 7 == 0).alias("_none"), F.col("id").cast("string").alias("_id"))
    wanted = keys.where("_id < '2'")
    left = keys.where(near_dedup_module.may_hold(wanted, ["_none", "_id"]))
    assert wanted.exceptAll(left).count() == 0
    assert left.count() < wanted.count() + 0.2 * keys.count()
    assert keys.where(near_dedup_module.may_hold(keys.limit(0), ["_none", "_id"])).count() == 0


def test_near_dedup_where_the_partner_hides_values(spark):
    """47 of 58 shingles: the sketch of the larger set may hide ten of the shared ones."""
    rows = []
    for i in range(60):
        words = [f"p{i}x{j}" for j in range(59)]
        rows += [(2 * i, " ".join(words[:48]), "en", "s"), (2 * i + 1, " ".join(words), "en", "s")]
    want = brute_components([r[:2] for r in rows], 2, 80)
    got = near_dedup(rows_of(spark, rows), width=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert {n for n, _ in want.values()} == {47, 58} and {c for _, c in want.values()} == set(range(0, 120, 2))


def test_near_dedup_at_another_threshold(spark):
    rows = []
    for i in range(40):
        words = [f"p{i}x{j}" for j in range(301)]
        rows += [(2 * i, " ".join(words[:152]), "en", "s"), (2 * i + 1, " ".join(words), "en", "s")]
    want = brute_components([r[:2] for r in rows], 2, 50)
    got = near_dedup(rows_of(spark, rows), width=2, percent=50).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    with pytest.raises(ValueError):
        near_dedup(rows_of(spark, rows), percent=20)


def test_bounds_of_sketches():
    assert least_shared(SKETCH, 80) == 25 and least_listed(47, SKETCH, 80) == 37
    for n in range(1, SKETCH):
        for m in range(1, 100):
            for both in range(1, min(n, m) + 1):
                if 100 * both >= 80 * (n + m - both):
                    assert least_listed(n, SKETCH, 80) <= both - max(0, m - SKETCH)


def test_near_dedup_odd(spark, odd):
    got = near_dedup(odd, width=2).collect()
    assert len(got) == odd.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by_id[i]["component_id"] for i in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 4]
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {4, None}
    assert near_dedup(odd.limit(0)).count() == 0


def test_keep_one_tells_repeated_ids_apart(spark):
    common = " ".join(f"w{i}" for i in range(60))
    rows = [(1, common, "en", "a"), (2, common + " tail", "en", "a"), (2, "a text of its own", "en", "a"), (None, common + " end", "en", "a")]
    kept = keep_one(rows_of(spark, rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, common), (2, "a text of its own")]
    assert kept.columns == rows_of(spark, rows).columns


def test_language(spark, docs, odd):
    net = langid.fit(langid.train_rows(docs))
    got = langid.identify(docs, net).where(langid.held_out() & F.col("lang").isNotNull())
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    some = langid.identify(odd, net)
    assert some.count() == odd.count() and some.where("score < 0 or score > 1").isEmpty()
    assert {r["doc_id"] for r in some.where("lang_pred = 'und'").collect()} == {1, 2, 3, 9}
    assert langid.fit(odd.limit(0)) is None
    assert langid.identify(odd, None).where("lang_pred <> 'und'").isEmpty()


def test_language_stage_keeps_texts_without_labels(spark, docs, odd):
    for label in (None, "und"):
        some = odd.withColumn("lang", F.lit(label).cast("string"))
        kept = corpus_pipeline.language_id(spark, some, SF)
        assert kept.columns == odd.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "5", "7", "8", "None", "None"]
    held = docs.where(langid.held_out())
    assert corpus_pipeline.language_id(spark, held, SF).count() == held.where(r"text rlike '\\p{L}'").count() > 0


def test_windows_cover_texts():
    for n in (0, 1, 3, 255, 256, 257, 508, 509, 510, 2000):
        windows, owner, used = langid.cut(["a" * n])
        step = langid.WINDOW - langid._WIDE + 1
        assert (owner == 0).all() and (n == 0 or (len(windows) - 1) * step + used[-1] == n)


def fair(sizes, weights, share, most):
    """Iterative sharing: clamp what is above its limit, share the rest anew."""
    total, capped = sum(sizes) * share, set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        out = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if out[i] > most * sizes[i] * (1 + 1e-12)}
        if not over:
            return [most * sizes[i] if i in capped else out[i] for i in range(len(sizes))]
        capped |= over


def test_mixing(spark, docs, odd):
    got = mixing.taken_words(docs, block_words=200, shard_words=5000).toPandas()
    frame = docs.select("doc_id", "source", "text").toPandas().merge(got, on="doc_id")
    assert (frame["size"] == frame["text"].map(lambda t: len(WORD.findall(t or "")))).all()
    assert (frame["taken"] <= 2 * frame["size"]).all()
    by = frame.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    weights = [(3, 1, 2)[i % 3] for i in range(len(by))]
    assert np.allclose(by["target"], fair(by["size"].tolist(), weights, 1.5, 2.0))
    assert ((by["taken"] - by["target"]).abs() <= 0.51).all()
    again = mixing.taken_words(docs.repartition(7), block_words=200, shard_words=5000).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert mixing.taken_words(odd).count() == odd.count()
    assert mixing.taken_words(odd.limit(0)).count() == 0


def test_mixed_rows_are_whole(spark, docs, odd):
    out = mixing.mix(docs, block_words=200, shard_words=5000)
    assert out.columns == docs.columns
    assert out.join(docs, docs.columns, "left_anti").isEmpty()
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mix(odd).columns == odd.columns


def test_split_tree(spark):
    quotas = spark.createDataFrame([(False, "a", 100), (False, "b", 7), (True, "", 1)], "none boolean, src string, units bigint")
    parts = mixing.split_tree(quotas, 3, 1).toPandas()
    sums = parts.groupby("src")["quota"].sum().to_dict()
    assert sums == {"a": 100, "b": 7, "": 1} and parts.groupby("shard")["quota"].sum().between(12, 15).all()
    for _, one in parts.groupby("src"):
        one = one.sort_values("first")
        assert (one["first"].to_numpy()[1:] == (one["first"] + one["quota"]).to_numpy()[:-1]).all()


def plain_best_fit(sizes, sources, clusters, capacity, per_source):
    bins = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        fits = [
            (room, i) for i, (room, s, c) in enumerate(bins)
            if room >= size and s.count(source) < per_source and (cluster < 0 or cluster not in c)
        ]
        if not fits:
            bins.append([capacity, [], []])
            fits = [(capacity, len(bins) - 1)]
        best = min(fits)[1]
        bins[best][0] -= size
        bins[best][1].append(source)
        bins[best][2].append(cluster)
        out.append(best)
    return out


def test_best_fit_search():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randrange(1, 120)
        items = sorted(((rng.randrange(1, 60), rng.randrange(4), rng.randrange(-1, 9)) for _ in range(n)), reverse=True)
        args = [list(x) for x in zip(*items, strict=True)]
        for per_source in (1, 2):
            assert packing.best_fit(*args, 64, per_source) == plain_best_fit(*args, 64, per_source)


def test_packing(spark, docs, odd):
    rows = packing.pack(docs, capacity=300, group_rows=64).collect()
    check_packed(rows, docs.collect(), 300, packing.PER_SOURCE)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    assert packing.pack(odd).select("doc_id").distinct().count() == 9
    assert packing.pack(odd.limit(0)).count() == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(int(x) for x in m[0].split(".")) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans():
    rng = random.Random(1)
    texts = ["a@b@c.d.e", "@x.y", "a@b..c a@b.c.", "1.2.3.4.5.6.7.8", "0256.1.1.1 256.1.1.1 000255.1.1.1", "4111 1111-1111 1111", "++1 (2) 3-4-5 6 7 8", "é@b.c ü1.2.3.4"]
    texts += ["".join(rng.choices("a1.@+- (9\n", k=rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        assert pii.listed(pii.base_spans(text)) == plain_spans(text), text


def test_personal_data(spark, docs, odd):
    model = pii.fit(docs)
    for r in pii.find_personal_data(docs, model).join(docs, "doc_id").collect():
        want = plain_spans(r["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r["spans"].split(","))
    assert pii.find_personal_data(odd, model).count() == odd.count()
    assert pii.find_personal_data(odd.limit(0), pii.fit(odd.limit(0))).count() == 0


def test_mentions_are_carried_on():
    phones = [f"call +1 (9{i:02d}) 555-{1000 + i} now, then 9{i:02d} 555-{1000 + i} again" for i in range(40)]
    mails = [f"write to ab.{i}@mail{i}.example.com today version 3.{i} of it" for i in range(40)]
    model = pii.train(phones + mails)
    for text in ("no data 1234 here 1234", "licence 4.0 and 4.0"):
        assert pii.added_spans(model, text, pii.base_spans(text)) == []
    # Where all mentions are written out, one without its prefix is taken along; a number that
    # resembles no base span is not.
    whole = [f"call +1 (9{i:02d}) 555-{1000 + i} now, then +1 (9{i:02d}) 555-{1000 + i} again in {i} days of 20{i:02d}" for i in range(40)]
    model = pii.train(whole + mails)
    text = "call +1 (905) 555-1005 now. In 2019 room 12, and (905) 555-1005 again"
    base = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in pii.added_spans(model, text, base)] == [(3, "(905) 555-1005")]
    assert pii.listed(base) == plain_spans(text)
    text = text.replace("(905) 555-1005 again", "(917) 555-2231 again")
    assert pii.added_spans(model, text, pii.base_spans(text)) == []
