"""Jaccard join of documents on word shingles, with a prefix filter, sketches of the sets and hubs.

1. A text becomes the set of its word shingles; equal sets collapse to one node.
2. Two sets that reach the threshold share at least `ceil(percent * n)` of the n shingles of either,
   hence one among the first `n - ceil(percent * n) + 1` of each, whatever order all shingles are
   put in (prefix filter). The order puts rare shingles first: frequencies come from a table
   of hashed counts over all documents, of fixed size. Any order finds all links; a rough count
   only makes lists longer.
3. A sketch says of each of 2 to 4 bits a shingle whether an odd number of the set's shingles hash
   to it. Two sketches differ in no more bits than the sets differ in shingles, and sets that
   reach the threshold differ in few; so pairs whose sketches differ in more are no links, and
   full sets, which are far larger, are only read and moved for the others.
4. Inverted lists over the prefixes generate pairs. Pairs of short lists must pass the filters of
   size, place (as many shingles must follow the first shared one as links share) and sketch; those
   that remain are verified on full sets.
5. A long list has a hub, the set whose shingles are the most frequent. Its members are compared
   with the hub only; linked members need no more.
6. Connected hubs are one family. Members that are not connected to it are open. They get further
   hubs of their own (`hubs` - 1 rounds), and are at last compared with all members of the family:
   the sketches in blocks of like sizes, and the full sets of those members only whose sketches are
   near one of another component, again in blocks. A task returns a spanning forest of the links it
   finds, never all pairs.
7. Components come from star contraction.

No step loses a link. Sketches of a family whose members are all unlinked and of like size are
still compared pair by pair, in blocks of bounded memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.lookup import SALTS, look_up
from fleetwright.llm.common import packed, row_key, store, unpacked
from fleetwright.llm.components import components
from fleetwright.llm.shingles import set_key, shingle_sets

WIDTH = 4
PERCENT = 85
# Hashed counts: two rows of so many counters, whatever the input.
SLOTS = 1 << 19
_ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_PART = 1 << 14
# Lists of up to this length give all their pairs.
SHORT = 16
HUBS = 2
BLOCK_VALUES = 1_000_000
_BATCH = 256
# Full sets are compared in tiles of up to so many rows, sketches in blocks of so many tiles.
_SIDE = 512
_TILES = 16
# Two bands of sizes, two blocks and two tiles that meet.
CELL = ["big", "big2", "one", "two", "tile", "tile2"]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def most_apart(total, percent: int):
    """How many shingles two linked sets of `total` shingles together have one without the other.

    Takes a number, an array of numbers or a column.
    """
    both = F.ceil(total * percent / (100 + percent)) if isinstance(total, Column) else -(-total * percent // (100 + percent))
    return total - 2 * both


def sketch(values: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of the values is i modulo the number of bits, 2 to 4 a value."""
    bits = max(64, 1 << (2 * len(values) - 1).bit_length())
    counts = np.bincount((values & np.uint64(bits - 1)).view(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """One row of 64-bit words per sketch, each brought to `size` bytes: as if made of so many bits."""
    out = np.zeros((len(sketches), size // 8), np.uint64)
    sizes = np.array([len(x) for x in sketches])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        rows = np.frombuffer(b"".join([sketches[i] for i in at]), np.uint64)
        out[at] = np.bitwise_xor.reduce(rows.reshape(len(at), -1, size // 8), axis=1)
    return out


def differences(one: pd.Series, two: pd.Series) -> pd.Series:
    """For each pair of sketches, in how many bits they differ."""
    sizes = np.minimum(one.map(len).to_numpy(), two.map(len).to_numpy())
    out = np.zeros(len(sizes), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x, y = (folded(side.iloc[at].tolist(), int(size)) for side in (one, two))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return pd.Series(out)


def _texts(frames: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    for frame in frames:
        for at in range(0, len(frame), _BATCH):
            part = frame.iloc[at : at + _BATCH]
            yield part, list(shingle_sets(part["text"].tolist(), width))


def _slots(row: int, values: np.ndarray) -> np.ndarray:
    return (values * _ROWS[row]) >> np.uint64(64 - (SLOTS.bit_length() - 1))


def corpus(docs: DataFrame, width: int) -> DataFrame:
    """Per row doc_id, n_shingles and set_key; and per task `part` and `counts` of the table of hashed counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((len(_ROWS), SLOTS), np.int64)
        seen: set[bytes] = set()
        for frame, sets in _texts(frames, width):
            keys = [set_key(v) for v in sets]
            new = []
            for key, values in zip(keys, sets, strict=True):
                if key not in seen:
                    seen.add(key)
                    new.append(values)
            if new:
                values = np.concatenate(new)
                for row in range(len(_ROWS)):
                    table[row] += np.bincount(_slots(row, values).view(np.int64), minlength=SLOTS)
            yield pd.DataFrame(
                {"id": frame["id"], "n": [len(v) for v in sets], "set_key": keys, "part": None, "counts": None}
            )
        parts = table.reshape(-1, _PART)
        for part in np.flatnonzero(parts.any(axis=1)):
            yield pd.DataFrame(
                {"id": None, "n": None, "set_key": None, "part": [part], "counts": [packed(parts[part])]}
            )

    # Names pass through pandas as text, so that nulls among them keep numbers whole.
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    out = rows.mapInPandas(run, "id string, n bigint, set_key binary, part int, counts binary")
    return out.withColumn("doc_id", F.col("id").cast(docs.schema["doc_id"].dataType)).drop("id")


def frequency_levels(counted: DataFrame) -> np.ndarray:
    """For each counter its level, four to a doubling: a table of `len(_ROWS) * SLOTS` bytes."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, counts in zip(frame["part"], frame["counts"], strict=True):
                held[part] = held.get(part, 0) + unpacked(counts)
        if held:
            yield pd.DataFrame({"part": list(held), "counts": [packed(c) for c in held.values()]})

    parts = counted.where("part is not null").select("part", "counts")
    table = np.zeros((len(_ROWS) * SLOTS // _PART, _PART), np.int64)
    for row in parts.repartition("part").mapInPandas(add, "part int, counts binary").collect():
        table[row["part"]] = unpacked(bytes(row["counts"]))
    return np.minimum(4 * np.log2(table + 1), 255).astype(np.uint8).reshape(len(_ROWS), SLOTS)


def rare_first(values: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, float]:
    """The values from rare to frequent, and their mean level. Order within a level is by value."""
    level = levels[0][_slots(0, values)]
    for row in range(1, len(_ROWS)):
        level = np.minimum(level, levels[row][_slots(row, values)])
    return values[np.argsort(level, kind="stable")], float(level.mean())


def prefixes(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(set_key, n, centre, first, sketch): each distinct set with its prefix and its sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for _, sets in _texts(frames, width):
            rows = []
            for values in sets:
                key = set_key(values)
                if not len(values) or key in seen:
                    continue
                seen.add(key)
                length = prefix_length(len(values), percent)
                ordered, centre = rare_first(values, shared.value)
                rows.append((key, len(values), centre, ordered[:length].view(np.int64), sketch(values)))
            if rows:
                yield pd.DataFrame(rows, columns=["set_key", "n", "centre", "first", "sketch"])

    schema = "set_key binary, n bigint, centre float, first array<bigint>, sketch binary"
    return docs.select("text").mapInPandas(run, schema)


def distinct_nodes(found: DataFrame) -> DataFrame:
    """One row per set, with a number `node` that is the larger, the more frequent its shingles are."""
    once = found.groupBy("set_key").agg(*[F.first(c).alias(c) for c in ("n", "centre", "first", "sketch")])
    rank = F.shiftleft(F.floor(F.col("centre") * 16).cast("bigint"), 48)
    return store(once.withColumn("node", rank + F.monotonically_increasing_id() % F.lit(1 << 48)), "ngram-nodes")


def lists(nodes: DataFrame, short: int) -> DataFrame:
    """(token, node, n, at, hub, long): the inverted lists with at least two members; `at` is the
    token's place in the node's prefix, from 0."""
    # Both the totals and the join use this partitioning. A prefix shingle is one of many of its
    # set, so a single list holds a small part of all rows even if a third of all sets is in it.
    listed = nodes.select("node", "n", F.posexplode("first").alias("at", "token")).repartition("token")
    # The hub is taken with all its columns: so both read the same rows, which are shuffled once.
    top = F.max(F.struct("node", "n", "at"))["node"].alias("hub")
    heads = listed.groupBy("token").agg(top, F.count("*").alias("members"))
    rows = listed.join(heads.where("members > 1"), "token")
    return store(rows.select("token", "node", "n", "at", "hub", (F.col("members") > short).alias("long")), "ngram-lists")


def sizes_allow(one: str, two: str, percent: int) -> Column:
    return F.least(one, two) * 100 >= F.greatest(one, two) * percent


def short_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of short lists whose sizes and places in the list allow a link.

    No shingle before the first that two sets share is in both, so that it is at a place with
    enough shingles from there on in either. If its list is long, the pair meets at the hub.
    """
    few = rows.where("not long").select("token", "node", "n", "at")
    one, two = few.toDF("token", "a", "n_a", "at_a"), few.toDF("token", "b", "n_b", "at_b")
    total = F.col("n_a") + F.col("n_b")
    both = (total - most_apart(total, percent)) / 2
    met = one.join(two, "token").where("a < b").where(sizes_allow("n_a", "n_b", percent))
    met = met.where((F.col("n_a") - F.col("at_a") >= both) & (F.col("n_b") - F.col("at_b") >= both))
    return store(met.select("a", "b").distinct(), "ngram-raw")


def ends(pairs: DataFrame, *names: str) -> DataFrame:
    """One column of the values of two columns."""
    return pairs.select(names[0]).union(pairs.select(names[1])).distinct()


def near_pairs(pairs: DataFrame, sketches: DataFrame, percent: int, salts: int) -> DataFrame:
    """(a, b, key_a, key_b): those of the pairs (a, b) that sizes and sketches let through, with
    their set_keys. A hub among the `a` is dealt out over `salts` parts."""
    one = sketches.select(*[F.col(c).alias(f"{c}_a") for c in ("node", "n", "sketch", "set_key")])
    two = sketches.select(*[F.col(c).alias(f"{c}_b") for c in ("node", "n", "sketch", "set_key")])
    one = one.withColumnRenamed("node_a", "a").join(pairs.select("a").distinct(), "a", "left_semi")
    met = pairs.join(two.withColumnRenamed("node_b", "b"), "b")
    met = look_up(met, one, ["a"], ["b"], salts=salts).where(sizes_allow("n_a", "n_b", percent))
    apart = F.pandas_udf(differences, "bigint")("sketch_a", "sketch_b")
    met = met.where(apart <= most_apart(F.col("n_a") + F.col("n_b"), percent))
    return met.select("a", "b", F.col("set_key_a").alias("key_a"), F.col("set_key_b").alias("key_b"))


def full_sets(docs: DataFrame, counted: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(set_key, shingles) for the sets of `wanted` (set_key), from the texts of their documents;
    also those of other texts with the same doc_ids.

    The small tables are stored first, so that Spark knows their size when it plans: as long as
    they fit into its limit for broadcasts, no text is shuffled to find the documents.
    """
    named = counted.join(wanted, "set_key").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    owners = named.select(*[c.alias(n) for n, c in row_key("doc_id").items()]).distinct()
    texts = docs.select(*[c.alias(n) for n, c in row_key("doc_id").items()], "text")
    texts = texts.join(store(owners, "ngram-owners"), ["_none", "_id"], "left_semi").dropDuplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, sets in _texts(frames, width):
            yield pd.DataFrame({"set_key": [set_key(v) for v in sets], "shingles": [v.view(np.int64) for v in sets]})

    return texts.select("text").mapInPandas(run, "set_key binary, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the linked ones of the pairs (a, b, key_a, key_b), by full sets."""
    one = sets.select(F.col("set_key").alias("key_a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("set_key").alias("key_b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    every = F.size("x") + F.size("y") - both
    met = pairs.join(two, "key_b").join(one, "key_a")
    # A set that several texts of one doc_id have in common may be there twice.
    return met.where(both * 100 >= every * percent).select("a", "b").distinct()


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each array of `one` shares with each of `two`."""
    out = np.zeros((len(one), len(two)), np.int64)
    a, b = np.concatenate(one), np.concatenate(two)
    common = np.intersect1d(a, b)
    cells = []
    for values, arrays in ((a, one), (b, two)):
        at = np.searchsorted(common, values)
        hit = (at < len(common)) & (common[np.minimum(at, max(len(common) - 1, 0))] == values) if len(common) else np.zeros(len(values), bool)
        cells.append((np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])[hit], at[hit]))
    for low in range(0, len(common), 4096):
        grids = []
        for (rows, at), arrays in zip(cells, (one, two), strict=True):
            inside = (at >= low) & (at < low + 4096)
            grid = np.zeros((len(arrays), min(4096, len(common) - low)), np.float32)
            grid[rows[inside], at[inside] - low] = 1
            grids.append(grid)
        out += (grids[0] @ grids[1].T).astype(np.int64)
    return out


class _Union:
    def __init__(self, names: list[int]) -> None:
        self.up = {n: n for n in names}

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def _tiles(sizes: np.ndarray, block_values: int) -> list[np.ndarray]:
    """Positions of the rows, cut so that a tile is bounded in rows and in values."""
    held = np.cumsum(np.maximum(sizes, -(-block_values // _SIDE)))
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(held // block_values)) + 1)


def _near(one: pd.DataFrame, two: pd.DataFrame, percent: int) -> np.ndarray:
    """Which rows of `one` and `two` are of different components, and may be linked by size and sketch."""
    n = [side["n"].to_numpy() for side in (one, two)]
    least, most = np.minimum.outer(*n), np.maximum.outer(*n)
    may = (least * 100 >= most * percent) & np.not_equal.outer(one["component"].to_numpy(), two["component"].to_numpy())
    lengths = [side["sketch"].map(len).to_numpy() for side in (one, two)]
    for length in np.unique(lengths[0]):
        for length2 in np.unique(lengths[1]):
            rows, cols = np.flatnonzero(lengths[0] == length), np.flatnonzero(lengths[1] == length2)
            cells = np.ix_(rows, cols)
            if not may[cells].any():
                continue
            size = int(min(length, length2))
            x, y = (folded(side["sketch"].iloc[at].tolist(), size) for side, at in ((one, rows), (two, cols)))
            apart = np.zeros((len(rows), len(cols)), np.int32)
            for words in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
                apart += np.bitwise_count(np.bitwise_xor.outer(*words))
            may[cells] &= apart <= most_apart((least + most)[cells], percent)
    return may


def _candidates(percent: int, block_values: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The rows of a block whose sketches are near one of the other side, by pairs of tiles."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n", kind="stable")
        sides = [side.reset_index(drop=True) for side in (group[group["is_open"]], group[~group["is_open"]])]
        cut = [[side.iloc[at] for at in _tiles(side["n"].to_numpy(), block_values)] for side in sides]
        out = [group.iloc[:0].assign(tile=0, tile2=0)]
        for i, mine in enumerate(cut[0]):
            for j, other in enumerate(cut[1]):
                may = _near(mine, other, percent)
                for side, axis in ((mine, 1), (other, 0)):
                    out.append(side[may.any(axis=axis)].assign(tile=i, tile2=j))
        return pd.concat(out)

    return run


def _forest(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between the open and the other sets of a pair of tiles that join different components."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        tree = _Union(group["component"].unique().tolist())
        one, two = group[group["is_open"]], group[~group["is_open"]]
        may = _near(one, two, percent)
        both = overlaps(one["shingles"].tolist(), two["shingles"].tolist()) if may.any() else np.zeros_like(may, int)
        every = np.add.outer(one["n"].to_numpy(), two["n"].to_numpy()) - both
        links = []
        for row, col in zip(*np.nonzero(may & (both * 100 >= every * percent)), strict=True):
            x, y = tree.find(one["component"].iat[row]), tree.find(two["component"].iat[col])
            if x != y:
                tree.up[max(x, y)] = min(x, y)
                links.append((one["node"].iat[row], two["node"].iat[col]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def block_candidates(members: DataFrame, sketches: DataFrame, percent: int, block_values: int) -> DataFrame:
    """Open members of a family and its other members whose sketches are near each other.

    `members` has family, node, component and `is_open`. A cell is a family that fits into one block,
    or its sets of one band of sizes; linked sets are in the same or in adjacent bands. Rows with
    equal values of `family` and `CELL` belong together: open ones are compared with the others.
    """
    big = F.floor(F.log("n") / (math.log(100 / percent) + 1e-6)).cast("int")
    held = F.greatest("n", F.lit(-(-block_values // _SIDE)))
    most = F.lit(block_values * _TILES)
    rows = members.join(sketches.select("node", "n"), "node")
    rows = store(rows, "ngram-sized")
    small = store(rows.groupBy("family").agg((F.sum(held) <= most).alias("small")), "ngram-small")
    rows = look_up(rows, small, ["family"], ["node"]).withColumn("big", F.when(F.col("small"), 0).otherwise(big)).drop("small")
    rows = store(rows, "ngram-cells-of")
    cells = rows.groupBy("family", "big").agg(
        F.ceil(F.sum(held) / most).cast("int").alias("blocks"),
        F.ceil(F.sum(F.when(F.col("is_open"), held)) / most).cast("int").alias("open_blocks"),
    )
    cells = store(cells, "ngram-cells")
    meet = (
        cells.where("open_blocks > 0")
        .select("family", "big", "open_blocks", F.explode(F.array(*[F.col("big") + i for i in (-1, 0, 1)])).alias("big2"))
        .join(cells.select("family", F.col("big").alias("big2"), "blocks"), ["family", "big2"])
    )
    meet = store(meet, "ngram-meet")

    def dealt(side: DataFrame, own: str, every: str, is_open: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.col(every) - 1))
        names = [mine.alias("one"), others.alias("two")] if is_open else [others.alias("one"), mine.alias("two")]
        return side.select("family", "big", "big2", *names, "node", "n", "component", F.lit(is_open).alias("is_open"))

    asks = dealt(rows.where("is_open").join(meet, ["family", "big"]), "open_blocks", "blocks", True)
    there = rows.withColumnRenamed("big", "big2").join(meet, ["family", "big2"])
    answers = dealt(there, "blocks", "open_blocks", False)
    met = asks.union(answers).join(sketches.select("node", "sketch", "set_key"), "node")
    schema = f"{', '.join(f'{c} int' for c in CELL)}, node bigint, n bigint, component bigint, is_open boolean, sketch binary, set_key binary"
    found = met.groupBy("family", *CELL[:-2]).applyInPandas(_candidates(percent, block_values), f"family bigint, {schema}")
    return store(found, "ngram-candidates")


def _with_component(rows: DataFrame, found: DataFrame, node: str, out: str) -> DataFrame:
    """Adds the component of `node`: the node itself where no link is known."""
    known = found.select(F.col("node").alias(node), F.col("component").alias(out))
    return rows.join(known, node, "left").withColumn(out, F.coalesce(out, node))


def linked_nodes(
    docs: DataFrame, counted: DataFrame, nodes: DataFrame, width: int, percent: int, short: int, hubs: int, block_values: int
) -> DataFrame:
    """(node, component) for every node with a link."""

    def sets_of(wanted: DataFrame) -> DataFrame:
        return store(full_sets(docs, counted, store(wanted, "ngram-wanted"), width), "ngram-sets")

    def links(pairs: DataFrame) -> DataFrame:
        pairs = store(pairs, "ngram-pairs")
        return verified(pairs, sets_of(ends(pairs, "key_a", "key_b").toDF("set_key")), percent)

    rows = lists(nodes, short)
    star = store(rows.where("long").select("hub", "node").distinct(), "ngram-star")
    around = star.where("hub <> node").toDF("a", "b")
    few = short_pairs(rows, percent)
    asked = store(ends(few, "a", "b").toDF("node").union(star.select("node")).distinct(), "ngram-asked")
    sketches = store(nodes.select("node", "n", "sketch", "set_key").join(asked, "node", "left_semi"), "ngram-sketches")
    pairs = near_pairs(few, sketches, percent, 1).union(near_pairs(around, sketches, percent, SALTS))
    edges = store(links(pairs), "ngram-edges")
    found = store(components(edges, spread=True), "ngram-components")
    # Connected hubs are one family, known by the component that they had when it was made.
    members = _with_component(star, found, "hub", "family").select("family", "node").distinct()
    members = store(members, "ngram-members")
    for _ in range(hubs - 1):
        left = store(_open(members, found).where("is_open"), "ngram-left")
        if left.isEmpty():
            return found
        chosen = store(left.groupBy("family").agg(F.max("node").alias("second")), "ngram-hubs")
        asked = look_up(left, chosen, ["family"], ["node"]).where("node <> second")
        asked = store(asked.select(F.col("second").alias("a"), F.col("node").alias("b")).distinct(), "ngram-asked")
        edges = store(edges.union(links(near_pairs(asked, sketches, percent, SALTS))), "ngram-edges")
        found = store(components(edges, spread=True), "ngram-components")
    apart = store(_open(members, found), "ngram-apart")
    busy = store(apart.where("is_open").select("family").distinct(), "ngram-busy")
    apart = look_up(apart, busy, ["family"], ["node"])
    met = block_candidates(apart, sketches, percent, block_values)
    met = met.join(sets_of(met.select("set_key").distinct()), "set_key")
    more = met.groupBy("family", *CELL).applyInPandas(_forest(percent), "a bigint, b bigint")
    return components(store(edges.union(more), "ngram-edges"), spread=True)


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the component of each node, and whether it is another than its family's."""
    rows = _with_component(_with_component(members, found, "node", "component"), found, "family", "of_family")
    return rows.withColumn("is_open", F.col("component") != F.col("of_family")).drop("of_family")


def ngram_join(
    docs: DataFrame,
    *,
    width: int = WIDTH,
    percent: int = PERCENT,
    short: int = SHORT,
    hubs: int = HUBS,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Two texts are linked if 100 * shared shingles >= percent * all shingles; `component_id` is
    the smallest doc_id that can be reached over links. Null and blank texts have no shingles and
    link with nothing. A row without doc_id gets the component of its text, which is null if all
    its rows are without one. Rows that repeat a doc_id are judged each by its own text. Other
    columns are ignored; an empty table gives no rows.
    """
    counted = store(corpus(docs, width), "ngram-corpus")
    nodes = distinct_nodes(prefixes(docs, width, percent, frequency_levels(counted)))
    rows = counted.where("part is null").select("doc_id", F.col("n").alias("n_shingles"), "set_key")
    found = linked_nodes(docs, rows.where("n_shingles > 0"), nodes, width, percent, short, hubs, block_values)
    first = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    named = nodes.select("node", "set_key").join(first, "set_key").join(found, "node", "left")
    named = store(named.select("set_key", "rep", F.coalesce("component", "node").alias("component")), "ngram-named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = store(named.join(least, "component").select("set_key", "component_id"), "ngram-least")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(named, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"))
