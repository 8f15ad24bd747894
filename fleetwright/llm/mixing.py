"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are put in a random but fixed order and cut into blocks of about
`block_words` words. A source's target gives its exact quota of blocks: whole passes over the
source, then the first blocks of one more pass. A binary tree deals the quotas out among output
shards: each node splits the vector of block counts of its sources between its halves by a
multivariate hypergeometric draw, so every shard gets a fair random share of each source and
quotas stay exact. The blocks of a source, those of all passes together, are put in a random but
fixed order of their own, and each shard takes the next ones of that order, so that early and late
passes are spread over all shards. A shard shuffles its documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.functions.blocks import ordinal, running_total
from fleetwright.llm.common import free_names, row_key, store, word_count

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 1 << 14
SHARD_WORDS = 1 << 22
MAX_LEVELS = 24


def order_key(seed: int) -> Column:
    """Place of a document in its source's random order; the same in every run."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def targets(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: source_size and target, the fair shares under a limit.

    Sources share `share` times all words by weight; no target exceeds `most` times its source,
    and what is over goes to the others by weight. With sources in the order of limit / weight,
    that is one common level times weight for all that come after the limited ones.
    """
    names = ["none", "src"]
    one = sized.groupBy(*names).agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(*names)) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    one = one.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    one = one.withColumn("ratio", F.col("cap") / F.col("weight"))
    rise = Window.orderBy("ratio", *names)
    before = F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * float(share)
    one = one.withColumn("level", (total - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.coalesce(level["level"] * F.col("weight"), F.col("cap")))
    return one.withColumn("target", target).select(*names, "source_size", "target")


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(none, src, shard, first, quota): exact quotas of `quotas` (none, src, units) per shard.

    Each level is a grouped step over the nodes: the rows of a node are its sources.
    """

    def split(key: tuple, node: pd.DataFrame) -> pd.DataFrame:
        node = node.sort_values(["none", "src"]).reset_index(drop=True)
        counts = node["units"].to_numpy(dtype=np.int64)
        rng = np.random.default_rng([seed, int(node["level"].iloc[0]), int(key[0])])
        total = int(counts.sum())
        half = total // 2 + (total % 2) * int(rng.integers(0, 2))
        left = np.zeros(len(counts), dtype=np.int64)
        below, need = total, half
        for i, n in enumerate(counts):  # one margin after the other
            below -= int(n)
            left[i] = rng.hypergeometric(n, below, need) if need and n else 0
            need -= int(left[i])
        two = []
        for side, units in ((0, left), (1, counts - left)):
            first = node["first"].to_numpy() + (left if side else 0)
            two.append(node.assign(node=node["node"] * 2 + side, level=node["level"] + 1, units=units, first=first))
        return pd.concat(two)

    now = quotas.select(
        F.lit(0).cast("bigint").alias("node"), F.lit(0).alias("level"), "none", "src", "units",
        F.lit(0).cast("bigint").alias("first"),
    )
    schema = "node bigint, level int, none boolean, src string, units bigint, first bigint"
    for _ in range(levels):
        now = now.where("units > 0").groupBy("node").applyInPandas(split, schema)
    return now.where("units > 0").select("none", "src", F.col("node").alias("shard"), "first", F.col("units").alias("quota"))


def draws(
    docs: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    cut: bool = False,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """The documents and what is drawn of them.

    First table: row_no, doc_id, size, source_size, target for every row of `docs`. Second:
    row_no, doc_id, place (`order_key`), pass, words, shard, shuffle. A document is drawn at most
    ceil(`most`) times. With `cut`, the last document of a source's last pass is taken in part
    and a source's words are its target, rounded; else documents are whole, and the one at the
    border is taken if its middle lies inside.

    Null texts have size 0. Null sources are one source. Sources without words are taken once.
    """
    sized = store(
        docs.select(
            "doc_id",
            F.col("source").isNull().alias("none"),
            F.coalesce("source", F.lit("")).alias("src"),
            word_count("text").alias("size"),
            order_key(seed).alias("place"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "sized",
    )
    sources = store(targets(sized, weights, share, most), "sources")
    # Places are spread evenly, so a source falls into 16,384 even blocks of rows at most.
    spread = sized.withColumn("part", F.shiftright("place", 50))
    placed = running_total(spread, ["none", "src"], "part", ["place", "row_no"], F.col("size"), "above")
    placed = placed.join(sources, ["none", "src"])
    goal = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.floor(goal / F.col("source_size"))).cast("int")
    per_pass = F.floor((F.col("source_size") + (block_words - 1)) / block_words)
    placed = placed.select(
        "*",
        passes.alias("passes"),
        (goal - passes * F.col("source_size")).cast("bigint").alias("more"),
        F.greatest(per_pass, F.lit(1)).cast("bigint").alias("per_pass"),
        F.floor(F.col("above") / block_words).cast("bigint").alias("block"),
    )
    if cut:
        extra = F.greatest(F.least(F.col("more") - F.col("above"), F.col("size")), F.lit(0))
    else:
        inside = (2 * F.col("above") + F.col("size") <= 2 * F.col("more")) & (F.col("more") > 0)
        extra = F.when(inside, F.col("size")).otherwise(F.lit(0))
        extra = F.when(inside | (F.col("size") > 0), extra)
    extra = extra.cast("bigint")
    whole = F.transform(
        F.sequence(F.lit(1), F.greatest(F.col("passes"), F.lit(1))),
        lambda i: F.struct((i - 1).alias("pass"), F.col("size").alias("words")),
    )
    last = F.array(F.struct(F.col("passes").alias("pass"), extra.alias("words")))
    taken = F.concat(F.when(F.col("passes") > 0, whole).otherwise(F.slice(last, 1, 0)), last)
    each = placed.select("none", "src", "row_no", "doc_id", "place", "size", "per_pass", "block", F.explode(taken).alias("t"))
    each = each.where("t.words > 0 or (size = 0 and t.words is not null)").select(
        "none", "src", "row_no", "doc_id", "place", F.col("t.pass").alias("pass"), F.col("t.words").alias("words"),
        # An empty document after the last word belongs to the last block.
        (F.col("t.pass") * F.col("per_pass") + F.least("block", F.col("per_pass") - 1)).alias("unit"),
    )
    each = store(each, "drawn")
    # Blocks by the hash of their numbers; a source has few blocks for its rows.
    units = each.select("none", "src", "unit").distinct().withColumn("code", F.xxhash64(F.lit(seed), "src", "unit"))
    units = units.withColumn("part", F.shiftright("code", 50))
    units = ordinal(units, ["none", "src"], "part", ["code", "unit"], "spot", start=0)
    units = store(units.select("none", "src", "unit", "spot"), "units")
    quotas = store(units.groupBy("none", "src").agg(F.count("*").alias("units")), "quotas")
    total = each.agg(F.sum("words")).first()[0] or 0
    levels = min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, total / shard_words))))))
    spots = split_tree(quotas, levels, seed).select(
        "none", "src", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("spot")
    )
    dealt = store(units.join(spots, ["none", "src", "spot"]).select("none", "src", "unit", "shard"), "dealt")
    drawn = each.join(dealt, ["none", "src", "unit"]).select(
        "row_no", "doc_id", "place", "pass", "words", "shard",
        F.xxhash64(F.lit(seed), "shard", "place", "pass").alias("shuffle"),
    )
    return placed.select("row_no", "doc_id", "size", "source_size", "target"), drawn


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards, one row per row of `docs`."""
    rows, drawn = draws(docs, cut=True, **options)
    sums = drawn.groupBy("row_no").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards"))
    return rows.join(sums, "row_no", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "shards"
    )


def mix(docs: DataFrame, *, seed: int = 8, **options) -> DataFrame:
    """The mixed corpus: the columns of `docs`, whatever these are called, each row as often as it
    is drawn, whole; rows of a shard are together and shuffled."""
    none, name, place, many, one, shard, shuffle = free_names(docs, "_none", "_id", "_place", "_draws", "_draw", "shard", "shuffle")
    keys = [none, name, place]
    named = dict(zip((none, name), row_key("doc_id").values(), strict=True))
    _, drawn = draws(docs, seed=seed, cut=False, **options)
    times = (
        drawn.withColumns(named).withColumnRenamed("place", place).groupBy(*keys)
        .agg(F.collect_list(F.struct("shard", "shuffle")).alias(many))
    )
    # Rows that repeat doc_id and text are counted together and come back as often as drawn.
    marked = docs.withColumns({**named, place: order_key(seed)}).dropDuplicates(keys)
    out = marked.join(times, keys).select(*docs.columns, F.explode(many).alias(one))
    return (
        out.select(*docs.columns, F.col(one)["shard"].alias(shard), F.col(one)["shuffle"].alias(shuffle))
        .repartition(shard)
        .sortWithinPartitions(shard, shuffle)
        .select(*docs.columns)
    )
