"""Nearest neighbours by one navigable small-world graph per shard.

Rows are dealt into shards of bounded size. Each shard becomes a hierarchical graph whose layers
are flat arrays of neighbour numbers, stored as one row. Queries are gathered in blocks, every
block visits every shard, and the shards' best rows are merged. All of a shard's insertions and
of a block's searches advance together in numpy, in double precision; vectors are kept in the
precision they came in. Blocks are copied once per group of shards, and these copies are shuffled.

Equal vectors of a shard are one node with a list of ids, so copies cannot crowd a graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from fleetwright.llm.common import store

SHARD_ROWS = 4096
QUERY_BLOCK = 512
# Groups of shards that get the queries, on small clusters; a group is searched by one task.
SHARD_GROUPS = 64
LINKS = 16  # of a node in upper layers; twice as many in the lowest
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
_STEP = 4  # nodes expanded at once


@dataclass
class Graph:
    """Vectors in order of falling level; layers[i] is (nodes, links), -1 where there is none."""

    vectors: np.ndarray
    layers: list[np.ndarray]


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    # In double precision a square can still overflow; such nodes are the farthest, but no less found.
    with np.errstate(over="ignore"):
        diff = x[ids] - q[:, None, :]
        return np.minimum(np.einsum("bmd,bmd->bm", diff, diff), np.finfo(np.float64).max)


def search_layer(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The `width` nearest found nodes of each query and their squared distances, nearest first."""
    n = len(q)
    ids = np.full((n, width), -1, dtype=np.int64)
    dist = np.full((n, width), np.inf, dtype=x.dtype)
    done = np.zeros((n, width), dtype=bool)
    seen = np.zeros((n, len(x) + 1), dtype=bool)
    seen[:, -1] = True  # -1 stands for no node
    new, rows = start, np.arange(n)
    while True:
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new[seen[rows[:, None], new]] = -1
        seen[rows[:, None], new] = True
        d = np.where(new >= 0, _distances(x, new, q[rows]), np.inf)
        all_ids = np.concatenate([ids[rows], new], axis=1)
        all_d = np.concatenate([dist[rows], d], axis=1)
        all_done = np.concatenate([done[rows], np.zeros(new.shape, dtype=bool)], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        ids[rows] = np.take_along_axis(all_ids, order, 1)
        dist[rows] = np.take_along_axis(all_d, order, 1)
        done[rows] = np.take_along_axis(all_done, order, 1)
        open_ = ~done & np.isfinite(dist)
        rows = np.flatnonzero(open_.any(axis=1))
        if not len(rows):
            return ids, dist
        place = np.argsort(~open_[rows], axis=1, kind="stable")[:, :_STEP]
        live = np.take_along_axis(open_[rows], place, 1)
        done[rows[:, None], place] |= live
        nodes = np.where(live, np.take_along_axis(ids[rows], place, 1), -1)
        new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(rows), -1)


def _diverse(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` neighbours of each row, nearest first, none nearer to a chosen one than to
    the row itself; free places are filled with the nearest others."""
    n, width = ids.shape
    out = np.full((n, most), -1, dtype=np.int64)
    count = np.zeros(n, dtype=np.int64)
    left = np.zeros((n, width), dtype=bool)
    for j in range(width):
        ok = np.isfinite(dist[:, j]) & (count < most)
        if not ok.any():
            continue
        gap = _distances(x, np.maximum(out, 0), x[ids[:, j]])
        near = ((gap < dist[:, j, None]) & (out >= 0)).any(axis=1)
        take = np.flatnonzero(ok & ~near)
        out[take, count[take]] = ids[take, j]
        count[take] += 1
        left[:, j] = ok & near
    for j in range(width):
        take = np.flatnonzero(left[:, j] & (count < most))
        out[take, count[take]] = ids[take, j]
        count[take] += 1
    return out


def _link(x: np.ndarray, links: np.ndarray, new: np.ndarray, picked: np.ndarray) -> None:
    """Set the links of `new` nodes and the links back to them, pruned where a node is full."""
    most = links.shape[1]
    links[new, : picked.shape[1]] = picked
    src = np.repeat(new, picked.shape[1])
    dst = picked.reshape(-1)
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    wide = np.full((len(nodes), most + int(count.max(initial=0))), -1, dtype=np.int64)
    wide[:, :most] = links[nodes]
    wide[np.repeat(np.arange(len(nodes)), count), most + np.arange(len(dst)) - np.repeat(first, count)] = src
    wide.sort(axis=1)
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
    d = np.where(wide >= 0, _distances(x, np.maximum(wide, 0), x[nodes]), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    wide, d = np.take_along_axis(wide, order, 1), np.take_along_axis(d, order, 1)
    full = np.isfinite(d).sum(axis=1) > most
    links[nodes[~full]] = wide[~full][:, :most]
    if full.any():
        links[nodes[full]] = _diverse(x, wide[full], d[full], most)


def build(vectors: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 5) -> tuple[Graph, np.ndarray]:
    """Graph of distinct vectors, and the order in which it holds them.

    Nodes enter in batches that double up to 256; those of a batch also see each other.
    """
    n = len(vectors)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
    order = np.argsort(-level, kind="stable")
    level, x = level[order], np.ascontiguousarray(vectors[order])
    top = int(level[0]) if n else 0
    layers = [np.full((n, links * 2 if i == 0 else links), -1, dtype=np.int64) for i in range(top + 1)]
    at = 1
    while at < n:
        batch = np.arange(at, min(n, at + min(at, 256)))
        start = np.zeros((len(batch), 1), dtype=np.int64)
        for i in range(top, -1, -1):
            mine = level[batch] >= i
            if not mine.any():
                start = search_layer(x, layers[i], x[batch], start, 4)[0]
                continue
            ids, dist = search_layer(x, layers[i], x[batch], start, width)
            start = ids[:, :4].copy()
            new = batch[mine]
            other = np.broadcast_to(new, (len(new), len(new))).copy()
            d = _distances(x, other, x[new])
            np.fill_diagonal(d, np.inf)
            ids, dist = np.concatenate([ids[mine], other], 1), np.concatenate([dist[mine], d], 1)
            best = np.argsort(dist, axis=1, kind="stable")[:, :width]
            picked = _diverse(x, np.take_along_axis(ids, best, 1), np.take_along_axis(dist, best, 1), links)
            _link(x, layers[i], new, picked)
        at = int(batch[-1]) + 1
    return Graph(x, layers), order


def search(graph: Graph, q: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
    """(queries, width) nodes, -1 where fewer were found."""
    start = np.zeros((len(q), 1), dtype=np.int64)
    for links in graph.layers[:0:-1]:
        start = search_layer(graph.vectors, links, q, start, 4)[0]
    return search_layer(graph.vectors, graph.layers[0], q, start, width)[0]


def usable(vector: str = "embedding") -> Column:
    """Not null, not all zero, and every component finite."""
    v = F.col(vector)
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def _precision(rows: DataFrame) -> str:
    return "float32" if isinstance(rows.schema["embedding"].dataType.elementType, FloatType) else "float64"


INDEX = "dim int, shard int, nodes int, vectors binary, offsets binary, ids binary, layers array<binary>"


def build_index(rows: DataFrame) -> DataFrame:
    """One row per shard of `rows` (dim, shard, vec_id, embedding): the graph as flat arrays."""
    precision = _precision(rows)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["embedding"].tolist(), dtype=np.float64)
        ids = group["vec_id"].to_numpy(dtype=np.int64)
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        graph, order = build(distinct, seed=int(key[1]))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        node = place[node.reshape(-1)]
        by_node = np.lexsort((ids, node))
        offsets = np.searchsorted(node[by_node], np.arange(len(order) + 1))
        return pd.DataFrame(
            [[key[0], key[1], len(order), distinct[order].astype(precision).tobytes(), offsets.astype(np.int64).tobytes(), ids[by_node].tobytes(),
              [layer.astype(np.int32).tobytes() for layer in graph.layers]]],
            columns=["dim", "shard", "nodes", "vectors", "offsets", "ids", "layers"],
        )

    return rows.groupBy("dim", "shard").applyInPandas(run, INDEX)


def query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """Queries (vec_id, embedding) of one dimension as rows of up to about QUERY_BLOCK queries."""
    precision = _precision(queries)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.array(group["embedding"].tolist(), dtype=precision)
        ids = group["vec_id"].to_numpy(dtype=np.int64)
        return pd.DataFrame([[key[0], ids.tobytes(), x.tobytes()]], columns=["dim", "query_ids", "query_vectors"])

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return dealt.groupBy("dim", "block").applyInPandas(run, "dim int, query_ids binary, query_vectors binary")


def _answers(row: dict, k: int, width: int, precision: str) -> pd.DataFrame:
    """The best k rows of one shard for each query of one block."""
    n, dim = row["nodes"], row["dim"]
    x = np.frombuffer(row["vectors"], precision).reshape(n, dim).astype(np.float64)
    layers = [np.frombuffer(b, dtype=np.int32).reshape(n, -1).astype(np.int64) for b in row["layers"]]
    offsets, ids = np.frombuffer(row["offsets"], dtype=np.int64), np.frombuffer(row["ids"], dtype=np.int64)
    query_ids = np.frombuffer(row["query_ids"], dtype=np.int64)
    q = np.frombuffer(row["query_vectors"], precision).reshape(-1, dim).astype(np.float64)
    graph, asked, found, scores = Graph(x, layers), [], [], []
    for at in range(0, len(q), 256):
        for own, vector, nodes in zip(query_ids[at:], q[at:], search(graph, q[at : at + 256], width), strict=False):
            nodes = nodes[nodes >= 0]
            exact = np.sqrt(((x[nodes] - vector) ** 2).sum(axis=1))
            got_ids, got_d = [], []
            for node, d in zip(nodes, exact, strict=True):
                some = ids[offsets[node] : offsets[node + 1]]
                some = some[some != own][:k]  # ascending; farther ones of this node cannot count
                got_ids.append(some)
                got_d.append(np.full(len(some), d))
            got_ids, got_d = np.concatenate(got_ids), np.concatenate(got_d)
            best = np.lexsort((got_ids, got_d))[:k]
            asked.append(np.full(len(best), own))
            found.append(got_ids[best])
            scores.append(got_d[best])
    return pd.DataFrame({"query_id": np.concatenate(asked), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})


def nearest(
    embeddings: DataFrame,
    *,
    k: int = 10,
    every: int = 100,
    shard_rows: int = SHARD_ROWS,
    width: int = SEARCH_WIDTH,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found rows of each query.

    Queries are the rows whose vec_id is divisible by `every`; of rows that repeat a query's
    vec_id, the smallest vector asks. Candidates are all rows with another vec_id and as many
    components. Score is the Euclidean distance in double precision; ties go to the smaller
    vec_id. Unusable vectors and rows without vec_id take no part. Other columns are ignored.
    """
    precision = _precision(embeddings)
    good = embeddings.where(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<float>" if precision == "float32" else "array<double>").alias("embedding"),
        F.size("embedding").alias("dim"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    count = good.select("vec_id", "embedding").count()
    shards = max(1, -(-count // shard_rows))
    rows = store(
        good.withColumn("shard", F.pmod(F.xxhash64("row_no"), F.lit(shards)).cast("int")).drop("row_no"), "vectors"
    )
    index = store(build_index(rows), "graphs")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("embedding", "dim")).alias("q"))
    asked = asked.select("vec_id", "q.embedding", "q.dim")
    blocks = query_blocks(asked, max(1, -(-count // (every * QUERY_BLOCK))))
    # Each block of queries goes to each group of shards once; nothing is paired row by row. The copies
    # lie in a small file, but are too many to be broadcast.
    groups = min(shards, max(SHARD_GROUPS, 4 * embeddings.sparkSession.sparkContext.defaultParallelism))
    sent = store(blocks, "queries").select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    dealt = index.withColumn("group", F.col("shard") % F.lit(groups))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                yield _answers(row, k, width, precision)

    found = dealt.join(sent.hint("merge"), ["dim", "group"]).mapInPandas(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
