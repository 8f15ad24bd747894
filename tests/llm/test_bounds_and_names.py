"""Repeated rows in training samples, clashing column names in all stages, huge vectors, spread of passes."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetwright.llm import ann, langid, mixing, pii
from fleetwright.llm.common import free_names

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASHES = ["_id", "_none", "_sha", "_hash", "_place", "_draws", "_draw", "shard", "shuffle", "score", "lang_pred", "_d"]


@pytest.mark.parametrize("text", ["the one text", "un autre texte", "4 numbers 12", "x@y.z and more"])
def test_one_row_repeated(spark, text):
    rows = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    net = langid.fit(rows)
    assert net.languages == ("en",)
    assert {tuple(r) for r in langid.identify(rows, net).select("lang_pred").distinct().collect()} == {("en",)}
    assert pii.find_personal_data(rows, pii.fit(rows)).count() == 5000
    assert corpus_pipeline.language_id(spark, rows, SF).count() == 5000


def test_samples_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, labels, languages: seen.append((len(windows), languages)))
    rows = spark.range(3000).select(
        "*", F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.concat(F.lit("l"), F.col("id") % 60).alias("lang")
    )
    langid.fit(rows)
    langid.fit(rows, sample_rows=7)
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 5)
    monkeypatch.setattr(langid, "MAX_WINDOWS", 60)
    langid.fit(rows.union(rows.where("lang > 'l55'")))
    # Equal rows count as one; each of the most frequent labels has at most 60 / (5 * 4) rows.
    assert [n for n, _ in seen] == [3000, 420, 15] and seen[2][1] == ("l56", "l57", "l58", "l59", "l6")


def test_clashing_names_pass_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHES]).cache()
    assert free_names(docs, "_ID", "new", "new") == ["__ID", "new", "_new"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        now = now.cache()
        for c in CLASHES:
            assert now.where(F.col(c) != F.concat(F.lit(f"{c}-"), "doc_id")).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() >= now.select("doc_id").distinct().count()


def test_huge_vectors_hide_nothing(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x[0], x[7] = 1e30, -1e200
    x[9] = 1e-30
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.nearest(df, k=5, every=20, shard_rows=1000).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = 0
    for q in range(20, 401, 20):
        with np.errstate(over="ignore"):
            d = np.sqrt(((x - x[q - 1]) ** 2).sum(axis=1))
        best = [i + 1 for i in np.lexsort((np.arange(400), d)) if i != q - 1][:5]
        assert len(got[q]) == 5
        hit += len(set(best) & set(got[q]))
    assert hit >= 0.9 * 20 * 5


def test_passes_are_spread_over_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, drawn = mixing.draws(docs, cut=True, block_words=500, shard_words=80_000)
    means = {r["shard"]: r["mean"] for r in drawn.groupBy("shard").agg(F.avg("pass").alias("mean")).collect()}
    overall = drawn.agg(F.avg("pass")).first()[0]
    assert len(means) >= 8 and all(abs(m - overall) < 0.25 for m in means.values())
    # Every drawn block is in one shard.
    assert drawn.count() == drawn.select("row_no", "pass").distinct().count()


def test_many_repeats_take_linear_time():
    whole = [f"call +1 (9{i:02d}) 555-{1000 + i} now, then +1 (9{i:02d}) 555-{1000 + i} again in {i} days of 20{i:02d}" for i in range(40)]
    model = pii.train(whole)
    took = []
    for n in (1000, 4000):
        text = "call +1 (905) 555-1005 now. " + "In 2019 room 12, (905) 555-1005 again. " * n
        began = time.time()
        spans = pii.added_spans(model, text, pii.base_spans(text))
        took.append(time.time() - began)
        assert len(spans) == n
    assert took[1] < 12 * took[0]


def test_repeats_on_a_made_up_table(spark):
    """Trained on some numbers and tested on others: repeats without their prefix, and clean numbers."""
    rng = random.Random(5)

    def phone():
        return f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    def text(kind):
        full = phone()
        clean = f"In 20{rng.randint(10, 29)} room {rng.randint(1, 99)} held {rng.randint(100, 999)} seats, version {rng.randint(1, 9)}.{rng.randint(0, 9)}."
        again = {"whole": f"+1 {full}", "bare": full, "other": phone()}[kind]
        return f"Call +1 {full} today. {clean} They wrote {again} once more.", full

    train = [(i, text("whole")[0]) for i in range(300)]
    held = [(i, *text("other" if i % 2 else "bare")) for i in range(200)]
    model = pii.fit(spark.createDataFrame(train, "doc_id bigint, text string"))
    right = wrong = 0
    for i, body, full in held:
        for _, a, b in pii.added_spans(model, body, pii.base_spans(body)):
            good = i % 2 == 0 and body[a:b].strip("()") == full.strip("()")
            right, wrong = right + good, wrong + (not good)
    assert right >= 95 and wrong <= 2, (right, wrong)


def test_another_network_changes_the_language_stage(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = corpus_pipeline.language_id(spark, docs, SF).count()
    net = langid.fit(langid.train_rows(docs))
    flat = langid.Network(net.languages, net.bytes_, net.filters, net.bias, np.zeros_like(net.out), np.zeros_like(net.out_bias))
    monkeypatch.setattr(corpus_pipeline, "fit", lambda rows: flat)
    assert whole > 0.9 * docs.count() and corpus_pipeline.language_id(spark, docs, SF).count() == 0
