"""Dependency order and cycles of a module graph, by iterated joins.

Edges are (module, dep): the module needs the dep. Every round writes its result to reliable
storage (`session.cut_lineage`) and ends with an exact test for change; there is no limit on
rounds. Graphs are never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.blocks import TABLE_BLOCK_ROWS, ordinal, row_block
from fleetwright.functions.lookup import look_up
from fleetwright.session import cut_lineage

# Levels gathered before they are written out together.
_GATHER = 8


def _trim(edges: DataFrame) -> DataFrame:
    """Edges left after removing, again and again, nodes without an edge in or out."""
    left = cut_lineage(edges)
    size = left.count()
    while size:
        needs = left.select(F.col("module").alias("dep")).distinct()
        needed = left.select(F.col("dep").alias("module")).distinct()
        inner = look_up(left, needs, ["dep"], ["module"], "left_semi", 1)
        left = cut_lineage(look_up(inner, needed, ["module"], ["dep"], "left_semi", 1))
        smaller = left.count()
        if smaller == size:
            break
        size = smaller
    return left.select("module", "dep")


def _furthest(edges: DataFrame, start: str, end: str) -> DataFrame:
    """Greatest node from which each node is reached along start → end, itself included.

    Only nodes whose value rose in the last round send it on.
    """
    best = edges.select(F.col(start).alias("node")).union(edges.select(end)).distinct()
    best = cut_lineage(best.withColumn("top", F.col("node")))
    moved = best
    while True:
        sent = (
            look_up(edges.withColumnRenamed(start, "node"), moved, ["node"], [end], salts=1)
            .groupBy(F.col(end).alias("node"))
            .agg(F.max("top").alias("_sent"))
        )
        step = cut_lineage(
            best.join(sent, "node", "left").select(
                "node",
                F.greatest("top", "_sent").alias("top"),
                F.coalesce(F.col("_sent") > F.col("top"), F.lit(False)).alias("_rose"),
            )
        )
        best = step.select("node", "top")
        moved = step.where("_rose").select("node", "top")
        if moved.isEmpty():
            return best


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that may sit on a cycle; nodes on no cycle and on no
    way between cycles are left out.

    Each node learns the greatest node that reaches it and the greatest node it reaches. Where
    both are the same, the node shares a cycle with it: that is its component. The edges
    between nodes that agree in both values but are not settled yet go into the next round.
    """
    left = _trim(edges.select("module", "dep").distinct())
    settled = []
    while not left.isEmpty():
        ahead = _furthest(left, "module", "dep")
        behind = _furthest(left, "dep", "module")
        marks = cut_lineage(
            ahead.withColumnRenamed("top", "a").join(
                behind.withColumnRenamed("top", "b"), "node"
            )
        )
        settled.append(
            marks.where(F.col("a") == F.col("b")).select("node", F.col("a").alias("component"))
        )
        todo = marks.where(F.col("a") != F.col("b"))
        one = todo.select(F.col("node").alias("module"), F.struct("a", "b").alias("_m"))
        two = todo.select(F.col("node").alias("dep"), F.struct("a", "b").alias("_d"))
        rest = left.join(one, "module").join(two, "dep").where(F.col("_m") == F.col("_d"))
        left = _trim(rest.select("module", "dep"))
    if not settled:
        node = left.select(F.col("module").alias("node"))
        return node.withColumn("component", F.col("node"))
    return reduce(DataFrame.unionByName, settled)


def cycle_members(edges: DataFrame) -> DataFrame:
    """The modules that sit on a cycle."""
    found = components(edges)
    loops = edges.where(F.col("module") == F.col("dep")).select("module").distinct()
    shared = found.groupBy("component").count().where(F.col("count") > 1).select("component")
    on_cycle = found.join(shared, "component", "left_semi").select(F.col("node").alias("module"))
    return on_cycle.unionByName(loops).distinct()


def dependency_order(
    modules: DataFrame, edges: DataFrame, module: str = "module", seq: str = "seq"
) -> DataFrame:
    """Modules with their level and position: dependencies come before dependants.

    The level is the longest way down. Dependencies outside `modules` are ignored. The modules
    of one cycle share a level, and whatever needs them comes later. Inside a level modules
    keep their discovery order `seq`.
    """
    nodes = modules.select(F.col(module).alias("module"), F.col(seq).alias("seq"))
    known = nodes.select("module")
    inner = edges.select("module", "dep").where(F.col("module") != F.col("dep")).distinct()
    inner = look_up(inner, known, ["module"], ["dep"], "left_semi", 1)
    inner = look_up(inner, known.withColumnRenamed("module", "dep"), ["dep"], ["module"], "left_semi", 1)
    left = cut_lineage(inner.select("module", "dep"))
    waiting = known
    members = None
    level, size = 0, left.count()
    levels: list[DataFrame] = []
    while True:
        blocked = left.select("module").distinct()
        ready = waiting.join(blocked, "module", "left_anti")
        levels.append(ready.select("module", F.lit(level).cast("bigint").alias("level")))
        if len(levels) > _GATHER:
            levels = [cut_lineage(reduce(DataFrame.unionByName, levels))]
        if not size:
            break
        waiting = blocked
        left = cut_lineage(
            look_up(
                left, blocked.withColumnRenamed("module", "dep"), ["dep"], ["module"], "left_semi", 1
            ).select("module", "dep")
        )
        smaller = left.count()
        level += 1
        if smaller == size:
            if ready.isEmpty():
                levels.pop()
                level -= 1
            # Every edge left waits for another one: melt each cycle into one node and go on.
            parts = cut_lineage(components(left))
            members = parts
            waiting = _melt(waiting, parts, "module").distinct()
            left = _melt(_melt(left, parts, "module"), parts, "dep")
            left = cut_lineage(left.where(F.col("module") != F.col("dep")).distinct())
            smaller = left.count()
        size = smaller
    placed = reduce(DataFrame.unionByName, levels)
    if members is not None:
        inside = members.withColumnRenamed("component", "module")
        placed = placed.join(inside, "module", "left").select(
            F.coalesce("node", "module").alias("module"), "level"
        )
    ordered = placed.join(nodes, "module").withColumn(
        "_block", F.col("level") * F.lit(1 << 40) + row_block("seq", TABLE_BLOCK_ROWS)
    )
    return ordinal(ordered, [], "_block", ["level", "seq"], "ord").select("module", "level", "ord")


def _melt(df: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """Replace the nodes of `name` by their component, where they have one."""
    named = parts.withColumnRenamed("node", name)
    return look_up(df, named, [name], df.columns, "left", 1).withColumn(name, F.coalesce("component", name)).drop(
        "component"
    )
