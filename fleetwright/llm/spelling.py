"""Spelling variants: words at one error from each other, grouped under their most frequent form.

1. Words are counted in whole texts, with partial sums before the shuffle.
2. Two words at one error share the left or the right half of either of them, hence their first
   or their last `ANCHOR` characters. Words are dealt out twice, by these; each shard gets a
   bidirectional FM-index (`fm_index.py`) over its words and is asked for all of them. Beginnings
   and endings that very many words share are cut into parts, each of which is asked for the
   words of each part.
3. The nearest form of a word is the most frequent of its near words, if that is frequent enough.
   Roots are found by pointer doubling; counts grow along every step, so there are no cycles.
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.lookup import look_up
from fleetwright.llm.common import store
from fleetwright.llm.fm_index import WordIndex

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
# One run in so many loses a character.
NOISE = 199
ANCHOR = MIN_LENGTH // 2
SHARD_WORDS = 32_768


def corpus_words(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of `MIN_LENGTH` characters or more with at least `min_count` occurrences.

    Runs of Latin letters, A-Z lower-cased. Where `NOISE` divides the checksum of a document and
    a run, the run loses the character that the checksum points to. Null texts have no words; a
    null doc_id counts as empty. Repeated rows count each, other columns are ignored.
    """
    # Shorter runs give no words, whether they lose a character or not.
    runs = F.regexp_extract_all("text", F.lit(rf"[A-Za-z\x{{C0}}-\x{{FF}}]{{{MIN_LENGTH},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run"))
    run = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    rows = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), run.alias("run"))
    check = F.crc32(F.concat("doc_id", F.lit(":"), "run"))
    at = F.pmod("check", F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("check") % NOISE == 0, short).otherwise(F.col("run"))
    words = rows.withColumn("check", check).select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _shards(words: DataFrame, shard_words: int) -> DataFrame:
    """(side, shard, one, two, word, held, asked): words that an index holds, and words it is asked for."""
    anchors = words.select(
        "word",
        F.explode(
            F.array(
                F.struct(F.lit("L").alias("side"), F.substring("word", 1, ANCHOR).alias("anchor")),
                F.struct(F.lit("R").alias("side"), F.right("word", F.lit(ANCHOR)).alias("anchor")),
            )
        ).alias("a"),
    ).select("word", "a.*")
    sizes = anchors.groupBy("side", "anchor").agg(F.ceil(F.count("*") / F.lit(shard_words)).cast("int").alias("parts"))
    shards = max(1, -(-words.count() // shard_words))
    known = look_up(anchors, store(sizes, "anchors"), ["side", "anchor"], ["word"])
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")
    # An anchor of its own parts has shards of its own, which no other anchor's numbers meet.
    own = F.when(F.col("parts") > 1, F.col("anchor")).otherwise(shard.cast("string"))
    dealt = known.select(
        "side", own.alias("shard"), "word", "parts", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    same = ["side", "shard"]
    held = dealt.select(*same, F.col("part").alias("one"), every.alias("two"), "word", F.lit(True).alias("held"))
    asked = dealt.select(*same, every.alias("one"), F.col("part").alias("two"), "word", F.lit(False).alias("held"))
    return held.union(asked)


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near): every ordered pair of distinct words at exactly one error, once."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        side = group["side"].iloc[0]
        held = group.loc[group["held"], "word"].to_numpy()
        asked = group.loc[~group["held"], "word"].to_numpy()
        parts = [
            pd.DataFrame({"word": asked[one], "near": held[two]})
            for one, two in WordIndex(held).one_error(asked, side)
        ]
        return pd.concat(parts) if parts else pd.DataFrame({"word": [], "near": []}, dtype=object)

    pairs = (
        _shards(words.select("word"), shard_words)
        .groupBy("side", "shard", "one", "two")
        .applyInPandas(search, "word string, near string")
    )
    return pairs.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's way over forms, by pointer doubling."""
    now = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        new = now.join(after, now["root"] == after["at"], "left")
        if new.where("further is not null").isEmpty():
            return now
        now = store(new.select("word", F.coalesce("further", "root").alias("root")), "roots")


def spelling_variants(
    docs: DataFrame, *, min_count: int = MIN_COUNT, ratio: int = RATIO, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus.

    `form` is the near word of largest n, the smallest in code-point order among equals, if that n
    is at least `ratio` times the word's; else null, as is `form_n`. `root` is where forms lead.
    An empty table gives no rows.
    """
    words = store(corpus_words(docs, min_count), "words")
    near = near_words(words, shard_words)
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = (
        near.join(counts, "near")
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rarity"), "near")).alias("best"))
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.rarity")).alias("near_n"))
    )
    enough = F.col("near_n") >= F.col("n") * ratio
    judged = store(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(enough, F.col("near")).alias("form"),
            F.when(enough, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
