import random

from pyspark.sql import functions as F

from fleetwright.functions.blocks import carry, ordinal, row_block, running_total


def numbered(spark, seed=1, n=400):
    rng = random.Random(seed)
    rows = [
        ("big" if rng.random() < 0.6 else f"s{rng.randrange(5)}", i, rng.choice([None, None, i]))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "grp string, pos bigint, val bigint")
    return rows, df.withColumn("_block", row_block("pos", 7))


def test_carry_forward_and_backward(spark):
    rows, df = numbered(spark)
    for inclusive in (True, False):
        for backward in (True, False):
            want, last = {}, {}
            for grp, pos, val in reversed(rows) if backward else rows:
                if inclusive and val is not None:
                    last[grp] = val
                want[pos] = last.get(grp)
                if val is not None:
                    last[grp] = val
            out = carry(
                df, ["grp"], "_block", ["pos"], F.col("val"), "near",
                inclusive=inclusive, backward=backward,
            )
            assert {r["pos"]: r["near"] for r in out.collect()} == want


def test_running_total_per_group_and_over_the_table(spark):
    rows, df = numbered(spark, 2)
    total, per_group, seen = 0, {}, {}
    for grp, pos, val in rows:
        seen[pos] = (per_group.get(grp, 0), total)
        per_group[grp] = per_group.get(grp, 0) + (val or 0)
        total += val or 0
    value = F.coalesce("val", F.lit(0))
    one = running_total(df, ["grp"], "_block", ["pos"], value, "above")
    assert {r["pos"]: r["above"] for r in one.collect()} == {p: s[0] for p, s in seen.items()}
    both = running_total(df, [], "_block", ["pos"], value, "above")
    assert {r["pos"]: r["above"] for r in both.collect()} == {p: s[1] for p, s in seen.items()}


def test_ordinal(spark):
    rows, df = numbered(spark, 3)
    counts, want = {}, {}
    for grp, pos, _ in rows:
        counts[grp] = counts.get(grp, 0) + 1
        want[pos] = counts[grp]
    out = ordinal(df, ["grp"], "_block", ["pos"])
    assert {r["pos"]: r["ord"] for r in out.collect()} == want
