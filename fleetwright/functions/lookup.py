"""Joining a big table to one row per key when a few keys may hold most of the big table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def look_up(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join `small`, with at most one row per key, to every row of `big`.

    The rows of a key are dealt out over `salts` parts by the `spread` columns, and the one row
    of `small` is given to each part. Adaptive execution may split the parts further: it can do
    so only where both sides are shuffled for the join, which the salt also brings about if
    `small` comes out of an aggregation by the same keys. With one part nothing is copied, and
    hot keys are left to adaptive execution: for a `small` that is about as large as `big`.
    """
    if salts == 1:
        one = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
        return big.withColumn("_salt", one).join(small.withColumn("_salt", one), [*keys, "_salt"], how).drop("_salt")
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return dealt.join(small.withColumn("_salt", parts), [*keys, "_salt"], how).drop("_salt")
