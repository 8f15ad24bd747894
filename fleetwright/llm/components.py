"""Connected components of an undirected graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.lookup import look_up
from fleetwright.llm.common import store


def _large_star(edges: DataFrame, spread: bool) -> DataFrame:
    """Every node sends its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    above = both.where("b > a")
    joined = look_up(above, least, ["a"], ["b"]) if spread else above.join(least, "a")
    return joined.select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame, spread: bool) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.col("b").alias("n"), F.col("a").alias("s"))
    least = down.groupBy("n").agg(F.min("s").alias("m"))
    joined = look_up(down, least, ["n"], ["s"]) if spread else down.join(least, "n")
    moved = joined.select(F.col("m").alias("a"), F.col("s").alias("b")).where("a < b")
    return moved.union(least.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct()


def components(edges: DataFrame, spread: bool = False) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the smallest node it is linked with.

    With `spread`, the neighbours of a hub are dealt out over several parts.

    Each round is stored. It ends when a round changes nothing, that is, when all edges go from
    a component's smallest node to another of its nodes. Edges never grow in number.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    now = store(edges.select(*pair).where("a < b").distinct(), "edges")
    mark = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    seen = now.agg(*mark).first()
    while True:
        now = store(_small_star(_large_star(now, spread), spread), "edges")
        new = now.agg(*mark).first()
        if new == seen:
            break
        seen = new
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return leaves.union(roots)
