"""Best-fit packing of documents into bins of fixed size, with conflicts.

Documents are cut into pieces of at most `capacity` words. Full pieces are bins by themselves.
The other pieces are dealt into groups at random, and each group is packed by best fit, largest
first: bins are kept in order of the room they have left, and carry bitmaps of the sources and
duplicate clusters they hold. The search starts at the tightest bin that has room and goes on to
the next until one is compatible; only then a new bin is opened.

A bin holds at most one piece of a duplicate cluster and at most `per_source` of a source.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.common import store, word_count
from fleetwright.llm.exact_dedup import normalised

CAPACITY = 2048
PER_SOURCE = 2
GROUP_ROWS = 8192


def best_fit(
    sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int
) -> list[int]:
    """Bin of every item, in the order given. `clusters` holds -1 for items without copies."""
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    held: list[list[int]] = []  # per bin: clusters, then sources seen once, twice, ...
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(room, (size, -1))
        while at < len(room) and (held[room[at][1]][0] & c or held[room[at][1]][per_source] & s):
            at += 1
        if at < len(room):
            left, bin_ = room.pop(at)
        else:
            left, bin_ = capacity, len(held)
            held.append([0] * (per_source + 1))
        maps = held[bin_]
        maps[0] |= c
        for i in range(1, per_source + 1):
            if not maps[i] & s:
                maps[i] |= s
                break
        if left > size:
            insort(room, (left - size, bin_))
        out.append(bin_)
    return out


def _pack(group: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    group = group.sort_values(["size", "cluster", "row_no"], ascending=[False, True, True])
    copies = group["cluster"].map(group["cluster"].value_counts())
    codes = pd.factorize(group["cluster"].where(copies > 1))[0]  # items without copies: -1
    sources = pd.factorize(group["source"], use_na_sentinel=False)[0]
    bins = best_fit(group["size"].tolist(), sources.tolist(), codes.tolist(), capacity, per_source)
    names = [f"g{g}-{b}" for g, b in zip(group["grp"], bins, strict=True)]
    return group.assign(bin_id=names)[["doc_id", "piece", "start", "size", "bin_id"]]


def pack(
    docs: DataFrame,
    *,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    group_rows: int = GROUP_ROWS,
    cluster: str | None = None,
) -> DataFrame:
    """doc_id, piece, start, size, bin_id: one row per piece; `start` and `size` in words.

    The duplicate cluster is the column `cluster`, else equal texts (white space aside) form
    one. Null texts and texts without words have one piece of size 0 in no bin (null). Repeated
    rows are copies of each other. A null source is a source like others. Other columns are
    ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    mark = F.xxhash64(F.col(cluster)) if cluster else F.xxhash64(normalised("text"))
    items = store(
        docs.select(
            F.col("doc_id").cast("string").alias("doc_id"),  # pandas has no integers with nulls
            "source",
            mark.alias("cluster"),
            word_count("text").alias("words"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "items",
    )
    last = F.greatest(F.ceil(F.col("words") / capacity) - 1, F.lit(0)).cast("bigint")
    pieces = items.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * capacity
    pieces = pieces.withColumn("start", start).withColumn("size", F.least(F.col("words") - start, F.lit(capacity)))
    lone = pieces.where((F.col("size") == capacity) | (F.col("size") == 0)).select(
        "doc_id", "piece", "start", "size",
        F.when(F.col("size") > 0, F.concat(F.lit("r"), "row_no", F.lit("-"), "piece")).alias("bin_id"),
    )
    rest = pieces.where((F.col("size") > 0) & (F.col("size") < capacity))
    groups = max(1, -(-rest.count() // group_rows))
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("row_no"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInPandas(
        lambda group: _pack(group, capacity, per_source),
        "doc_id string, piece bigint, start bigint, size bigint, bin_id string",
    )
    return packed.unionByName(lone).withColumn("doc_id", F.col("doc_id").cast(kind))
