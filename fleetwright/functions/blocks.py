"""Ordered computations over groups of any size.

A window over a whole group puts that group into one task. The helpers here cut a group into
blocks of neighbouring rows (a range of line numbers, a stretch of time), run the window inside
each block and carry one small row per block across. A file, lock or source that holds a third
of all rows is thereby spread over as many tasks as it has blocks.

`block` names a column that must not decrease along `order` inside a group. The caller adds it
(`range_blocks`, or `row_block` where rows carry a running number) and drops it when done; steps that
share a block column also share one shuffle. Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.session import cut_lineage

BLOCK_ROWS = 65_536
# Rows per block where the totals of all blocks of a table meet in one task.
TABLE_BLOCK_ROWS = 1 << 20


def row_block(ordinal: Column | str, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a row that carries a running number."""
    col = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor(col / F.lit(rows)).cast("bigint")


def micros(ts: Column | str) -> Column:
    """Timestamp as microseconds since the epoch (session time zone UTC)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def range_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None, out: str = "_block"
) -> DataFrame:
    """Add `out`: blocks of about equal size, whatever the keys and the spread of `order` are.

    Spark samples the rows for splitters over (keys, order) and cuts the table into ranges; the
    number of a range is the block. A key with a third of all rows, all within one hour, is thereby
    as many blocks as a third of the ranges. `order` must tell rows of a key apart. The result is
    stored, because the numbers belong to one run. `ranges` is Spark's own choice if not given.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return cut_lineage(dealt.withColumn(out, F.spark_partition_id().cast("bigint")))


def _cols(names: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(n).desc() if descending else F.col(n).asc() for n in names]


def carry(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    value: Column,
    out: str,
    *,
    inclusive: bool = True,
    backward: bool = False,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Add `out`: the nearest non-null `value` at or above the row (below it if `backward`).

    With `inclusive=False` the row itself does not count, which makes this a lag or lead.
    The big side is shuffled once, on (keys, block); the carried side holds one row per block.
    `edges` may give the same rows by a cheaper plan, if `value` needs no column that only `df`
    has; the block rows are then taken from there.
    """
    tagged = df.withColumn("_value", value)
    plain = tagged if edges is None else edges.withColumn("_value", value)
    pick = F.min_by if backward else F.max_by
    spot = F.when(F.col("_value").isNotNull(), F.struct(*order))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(*_cols([block], backward))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        plain.groupBy(*keys, block)
        .agg(pick("_value", spot).alias("_edge"))
        .withColumn("_carry", F.last("_edge", ignorenulls=True).over(earlier))
        .where(F.col("_carry").isNotNull())
        .select(*keys, block, "_carry")
    )
    stop = Window.currentRow if inclusive else -1
    inside = (
        Window.partitionBy(*keys, block)
        .orderBy(*_cols(order, backward))
        .rowsBetween(Window.unboundedPreceding, stop)
    )
    return (
        tagged.join(carried, [*keys, block], "left")
        .withColumn(
            out, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carry"))
        )
        .drop("_value", "_carry")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    value: Column,
    out: str,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add `out`: the sum of `value` over all rows above the row, in `order`, per `keys`.

    Without `keys` the sum runs over the whole table; only the block totals then meet in one
    task, one row per block. `sizes` may give those totals (`keys`, block, `_total`) where they
    are cheaper to get than from `df`; several rows per block are added up.
    """
    tagged = df.withColumn("_value", value)
    if sizes is None:
        sizes = tagged.select(*keys, block, F.col("_value").alias("_total"))
    above = (Window.unboundedPreceding, -1)
    by_block = Window.partitionBy(*keys).orderBy(block).rowsBetween(*above)
    offsets = (
        sizes.groupBy(*keys, block)
        .agg(F.sum("_total").alias("_total"))
        .select(*keys, block, F.sum("_total").over(by_block).alias("_above"))
        .where(F.col("_above").isNotNull())
    )
    inside = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(*above)
    zero = F.lit(0)
    return (
        tagged.join(offsets, [*keys, block], "left")
        .withColumn(
            out, F.coalesce("_above", zero) + F.coalesce(F.sum("_value").over(inside), zero)
        )
        .drop("_value", "_above")
    )


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    out: str = "ord",
    start: int = 1,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add `out`: the dense position of the row in `order`, per `keys` or over the whole table.

    The order columns must identify a row inside its group. `sizes`: see `running_total`.
    """
    one = F.lit(1).cast("bigint")
    counted = running_total(df, keys, block, order, one, "_rows_above", sizes)
    return counted.withColumn(out, F.col("_rows_above") + F.lit(start).cast("bigint")).drop(
        "_rows_above"
    )
