"""Exact duplicates by an extendible-hash index on shared files, in DataFrame operations only.

1. Every row gets a 64-bit key of its normalised text; keys are stored.
2. The directory: distinct keys are counted under their first bits at every depth. A bucket is
   a prefix that is not overfull while its parent is, which is where doubling the directory and
   splitting overfull buckets ends. Buckets of the greatest depth may be larger.
3. Texts are aggregated by (bucket, key, text). Copies collapse where they are read, before
   anything is shuffled, and texts that share a key are told apart by their bytes.
4. Owner tasks take whole buckets, that is ranges of keys, and number the texts chained under
   each key. The index is one small row per distinct text, on shared files.
5. Rows look up their chain by key. Rows under a key with several texts also match the text's
   SHA-256, which step 3 has shown to name one text of that chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.llm.common import BLANKS, free_names, row_key, store

# A directory has 2**MAX_DEPTH slots at most (65,536 rows of two numbers), so it may be broadcast.
MAX_DEPTH = 16
BUCKET_ROWS = 100_000


def normalised(text: Column | str) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), BLANKS, " ")


def _key(norm: str, key_bits: int) -> Column:
    """The first `key_bits` bits of the text's hash; fewer than 64 only to test collisions."""
    drop = 64 - key_bits
    return F.shiftleft(F.shiftright(F.xxhash64(norm), drop), drop) if drop else F.xxhash64(norm)


def _slot(key: str) -> Column:
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH)


def directory(keys: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(slot, depth, bucket): the bucket of every occurring prefix of MAX_DEPTH bits.

    `bucket` is the bucket's prefix with a 1 before it, so that buckets of all depths differ.
    """
    slots = (
        keys.select("key").distinct().groupBy(_slot("key").alias("slot")).agg(F.count("*").alias("n"))
    )
    doubled = slots.select(
        "slot", "n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftright(slot, {MAX_DEPTH} - depth)"))
    fitting = (
        doubled.groupBy("depth", "prefix")
        .agg(F.sum("n").alias("size"))
        .where((F.col("size") <= bucket_rows) | (F.col("depth") == MAX_DEPTH))
        .drop("size")
    )
    return (
        doubled.join(fitting, ["depth", "prefix"])
        .groupBy("slot")
        .agg(F.min(F.struct("depth", "prefix")).alias("b"))
        .select(
            "slot",
            F.col("b.depth").alias("depth"),
            F.expr("shiftleft(1L, b.depth) + b.prefix").alias("bucket"),
        )
    )


def build_index(
    docs: DataFrame, keys: DataFrame, bucket_rows: int = BUCKET_ROWS, key_bits: int = 64
) -> DataFrame:
    """One row per distinct text: bucket, key, chain_no, chain_len, text_sha256."""
    slots = store(directory(keys, bucket_rows), "slots").select("slot", "bucket")
    texts = (
        docs.select(normalised("text").alias("norm"))
        .select("norm", _key("norm", key_bits).alias("key"))
        .withColumn("slot", _slot("key"))
        .join(F.broadcast(slots), "slot")  # 2**MAX_DEPTH rows at most
        .groupBy("bucket", "key", "norm")
        .agg(F.count("*").alias("copies"))
        .select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"))
    )
    chain = Window.partitionBy("bucket", "key")
    owned = texts.repartition("bucket").select(
        "bucket",
        "key",
        (F.row_number().over(chain.orderBy("text_sha256")) - 1).alias("chain_no"),
        F.count("*").over(chain).alias("chain_len"),
        "text_sha256",
    )
    return store(owned, "index")


def exact_dedup(
    docs: DataFrame, *, bucket_rows: int = BUCKET_ROWS, key_bits: int = 64
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and key for every row of `docs`.

    Of equal texts, the row with the smallest doc_id stays. A null doc_id comes after all
    others; if a group has no other, keep_id is null. Of rows that repeat both doc_id and text,
    one is kept. Null texts equal empty ones. Other columns are ignored.
    """
    keys = store(
        docs.select("doc_id", normalised("text").alias("norm")).select(
            "doc_id", _key("norm", key_bits).alias("key"), F.monotonically_increasing_id().alias("row_no")
        ),
        "keys",
    )
    index = build_index(docs, keys, bucket_rows, key_bits)
    chained = index.where("chain_len > 1")
    placed = keys.withColumn("chain_no", F.lit(0))
    if not chained.isEmpty():
        rows = docs.select("doc_id", normalised("text").alias("norm")).select(
            "doc_id",
            _key("norm", key_bits).alias("key"),
            F.monotonically_increasing_id().alias("row_no"),
            F.sha2("norm", 256).alias("text_sha256"),
        )
        several = store(
            rows.join(chained.select("key", "text_sha256", "chain_no"), ["key", "text_sha256"]).select(
                *keys.columns, "chain_no"
            ),
            "chained",
        )
        placed = placed.join(chained.select("key").distinct(), "key", "left_anti").unionByName(several)
    groups = (
        placed.groupBy("key", "chain_no")
        .agg(
            F.count("*").alias("group_size"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no")).alias("top"),
        )
        .join(index.select("key", "chain_no", "text_sha256"), ["key", "chain_no"])
    )
    return placed.join(store(groups, "groups"), ["key", "chain_no"]).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("top.row_no")).alias("kept"),
        "text_sha256",
        "key",
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever these are called."""
    none, name, sha = keys = free_names(docs, "_none", "_id", "_sha")
    named = dict(zip((none, name), row_key("doc_id").values(), strict=True))
    kept = exact_dedup(docs, **options).where("kept").withColumns(named)
    kept = kept.withColumnRenamed("text_sha256", sha).select(*keys)
    marked = docs.withColumns({**named, sha: F.sha2(normalised("text"), 256)})
    # Rows that repeat doc_id and text are in one partition by now; one of them stays.
    return marked.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
