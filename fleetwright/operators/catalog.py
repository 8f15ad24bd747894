"""Choosing modules from a catalogue: blocklist, locale, first hit per name, lists."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.blocks import TABLE_BLOCK_ROWS, ordinal, row_block
from fleetwright.functions.text import or_default

# Fixed value: the languages taken where none are given.
DEFAULT_LANGUAGES = "en_AU,en_CA,en_IN,en_NZ,en_UK,en_US"

_ALTERNATIVES = 200


def blocklist_patterns(raw: str | None) -> list[str]:
    """Patterns of a comma or blank separated list; only the first line counts."""
    first_line = (raw or "").partition("\n")[0]
    return [p for p in re.split(r"[, \t]+", first_line) if p]


def blocked(name: Column | str, raw: str | None) -> Column:
    """True where the name matches any pattern of the list, anywhere in the name.

    Patterns are Java regular expressions. A quantifier at the very start has nothing to
    repeat and is dropped, as POSIX extended expressions do.
    """
    col = F.col(name) if isinstance(name, str) else name
    patterns = [p.lstrip("*+?") for p in blocklist_patterns(raw)]
    hit = F.lit(False)
    alone = [p for p in patterns if re.search(r"\\\d", p)]
    joined = [p for p in patterns if p not in alone]
    for start in range(0, len(joined), _ALTERNATIVES):
        part = joined[start : start + _ALTERNATIVES]
        hit = hit | col.rlike("|".join(f"(?:{p})" for p in part))
    for pattern in alone:
        hit = hit | col.rlike(pattern)
    return hit


def blocklist_filter(df: DataFrame, name: str, raw: str | None) -> DataFrame:
    """Drop the rows whose name matches the blocklist."""
    return df.where(~blocked(name, raw)) if blocklist_patterns(raw) else df


def locale_module_filter(df: DataFrame, name: str, codes: Sequence[str]) -> DataFrame:
    """Keep locale modules only for the given country codes; all other modules pass.

    A locale module has `l10n` anywhere in its name. Its codes are the `_` separated parts of
    exactly two letters a to z.
    """
    parts = F.filter(F.split(F.col(name), "_"), lambda p: p.rlike("^[a-z]{2}$"))
    wanted = F.array(*[F.lit(c) for c in codes]) if codes else F.array().cast("array<string>")
    return df.where(~F.contains(F.col(name), F.lit("l10n")) | F.arrays_overlap(parts, wanted))


def country_codes(languages: str | None) -> list[str]:
    """Country codes of one language list, for use as a setting (see `locale_codes`)."""
    entries = (languages or DEFAULT_LANGUAGES).split(",")
    return list(dict.fromkeys(e.split("_", 1)[1].lower() for e in entries if "_" in e))


def locale_codes(df: DataFrame, list_id: str, languages: str) -> DataFrame:
    """Distinct country codes of each language list, numbered by first appearance.

    Entries without `_` are dropped; only the first `_` cuts. A missing or empty list stands
    for the default languages.
    """
    entries = F.split(or_default(languages, DEFAULT_LANGUAGES), ",")
    kept = F.filter(entries, lambda e: F.contains(e, F.lit("_")))
    cut = F.transform(
        kept, lambda e: F.lower(F.substring(e, F.instr(e, "_") + 1, F.length(e)))
    )
    # One list is one short text, so the work stays inside the row: no shuffle.
    return df.select(
        list_id, F.posexplode(F.array_distinct(cut)).alias("_pos", "code")
    ).select(list_id, (F.col("_pos") + 1).cast("bigint").alias("ord"), "code")


def first_wins_dedup(
    catalogue: DataFrame,
    name: str = "name",
    rank: str = "path_rank",
    seq: str = "seq",
    *others: str,
) -> DataFrame:
    """First hit per name over the search roots, numbered in discovery order.

    Roots are searched by `rank`, the entries of one root by `seq`. The minimum is combined on
    the map side, so a name that occurs very often costs one row per task.
    """
    rest = list(others)
    winners = (
        catalogue.groupBy(name)
        .agg(F.min(F.struct(rank, seq, *rest)).alias("_first"))
        .select(name, *[F.col(f"_first.{c}").alias(c) for c in [rank, seq, *rest]])
    )
    block = F.col(rank).cast("bigint") * F.lit(1 << 40) + row_block(seq, TABLE_BLOCK_ROWS)
    placed = ordinal(winners.withColumn("_block", block), [], "_block", [rank, seq], "ord")
    return placed.drop("_block")


def search_roots(*roots: DataFrame, optional: DataFrame | None = None) -> DataFrame:
    """Stack catalogues in search order; the optional root takes part only if it has modules."""
    stacked = [
        root.withColumn("path_rank", F.lit(i).cast("int"))
        for i, root in enumerate([*roots, *([optional] if optional is not None else [])])
    ]
    result = stacked[0]
    for root in stacked[1:]:
        result = result.unionByName(root)
    return result


def mandatory_append(
    df: DataFrame, required: Sequence[str], name: str = "name", order: str = "ord"
) -> DataFrame:
    """Add the required names that are absent, behind all others, in the given order."""
    wanted = F.array(*[F.lit(r) for r in required])
    last = df.agg(
        F.coalesce(F.max(order), F.lit(0)).alias("_last"),
        F.collect_set(F.when(F.col(name).isin(*required), F.col(name))).alias("_present"),
    )
    missing = last.select(
        "_last", F.posexplode(F.array_except(wanted, F.col("_present"))).alias("_pos", name)
    ).select(
        F.col(name), (F.col("_last") + F.col("_pos") + 1).cast(df.schema[order].dataType).alias(order)
    )
    return df.select(name, order).unionByName(missing)


def ordered_list_agg(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    block: Column,
    by: Sequence[str] = (),
    chunk: int = 10_000,
    out: str = "names",
) -> DataFrame:
    """Comma lists in the given order, per `by` or over the whole table.

    A list is returned as numbered chunks of at most `chunk` names (`chunk_no` from 0): short
    lists are one row, and a list of any length stays within task memory. Putting the chunks
    of a list one after another, separated by commas, gives the list.
    """
    keys = list(by)
    placed = ordinal(df.withColumn("_block", block), keys, "_block", order, "_ord", start=0)
    return (
        placed.withColumn("chunk_no", F.floor(F.col("_ord") / F.lit(chunk)).cast("bigint"))
        .groupBy(*keys, "chunk_no")
        .agg(F.sort_array(F.collect_list(F.struct("_ord", F.col(value).alias("_v")))).alias("_l"))
        .select(*keys, "chunk_no", F.array_join(F.col("_l._v"), ",").alias(out))
    )
