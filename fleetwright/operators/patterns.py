"""A blocklist kept as a table of patterns.

Names are compared with the patterns that share a rare literal with them, never with all. A
pattern's literal is a run of characters that every match must hold. Three neighbouring
characters of it (the rarest three among the names) are looked up in an inverted index over the
names; what is found is verified by the whole pattern. Patterns without such a literal are joined
to alternations of bounded length, each of which is one pass over the names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.lookup import look_up
from fleetwright.session import cut_lineage

GRAM = 3
# Patterns without a literal that one pass over the names tests together.
TOGETHER = 200


def literal(pattern: str) -> str:
    """The longest run of plain characters that every match of the pattern holds, or an empty text.

    Only what lies outside groups, classes and alternatives counts, and a character that a
    quantifier makes optional ends its run. Flags that ignore case leave no literal.
    """
    if "|" in pattern or "(?" in pattern or r"\Q" in pattern:
        return ""
    best, run, depth, at = "", "", 0, 0
    while at < len(pattern):
        char, after = pattern[at], at + 1
        plain = ""
        if char == "\\":
            after = at + 2
            if at + 1 < len(pattern) and not pattern[at + 1].isalnum():
                plain = pattern[at + 1]
            elif at + 1 < len(pattern) and pattern[at + 1] not in "bBdDsSwW":
                return best if len(best) > len(run) else run  # codes of characters and references
        elif char == "[":
            after = at + 2 if pattern[at + 1 : at + 2] == "]" else at + 1
            after = at + 3 if pattern[at + 1 : at + 3] == "^]" else after
            level = 1
            while after < len(pattern) and level:
                level += {"[": 1, "]": -1}.get(pattern[after], 0)
                after += 2 if pattern[after] == "\\" else 1
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "{":
            close = pattern.find("}", at)
            after = close + 1 if close > 0 else len(pattern)
        elif char not in ".^$*+?":
            plain = char
        follow = pattern[after : after + 1]
        if plain and not depth and follow not in ("*", "?", "{"):
            run += plain
        else:
            best, run = max(best, run, key=len), ""
        if plain and follow == "+":
            best, run = max(best, run, key=len), ""
        at = after
    return max(best, run, key=len)


def _grams(text: str, out: str):
    places = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    found = F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, F.lit(GRAM))))
    return F.explode(F.when(F.length(text) >= GRAM, found)).alias(out)


def matched_names(df: DataFrame, patterns: DataFrame, name: str = "name", pattern: str = "pattern") -> DataFrame:
    """(name, pattern): each distinct name with the smallest pattern that matches it anywhere.

    Patterns are Java regular expressions; a quantifier at the very start is dropped, and blank
    and null patterns do not count. Names without a match are not in the result.
    """

    @F.pandas_udf("string")
    def literals(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(literal)

    names = cut_lineage(df.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct())
    clean = F.regexp_replace(F.col(pattern), r"^[*+?]+", "")
    listed = patterns.select(clean.alias("pattern")).where("pattern <> ''").distinct()
    listed = cut_lineage(listed.withColumn("literal", literals("pattern")))
    index = names.select("name", _grams("name", "gram"))
    wanted = listed.select("pattern", _grams("literal", "gram"))
    held = cut_lineage(index.groupBy("gram").agg(F.count("*").alias("names")))
    # A gram that no name has: the pattern matches nothing.
    rated = look_up(wanted, held, ["gram"], ["pattern"], "left").withColumn("names", F.coalesce("names", F.lit(0)))
    rare = rated.groupBy("pattern").agg(F.min(F.struct("names", "gram")).alias("best")).where("best.names > 0")
    rare = cut_lineage(rare.select("pattern", F.col("best.gram").alias("gram")))
    pairs = index.join(rare, "gram").where("name rlike pattern").select("name", "pattern")
    loose = listed.where(F.length("literal") < GRAM).select("pattern")
    refers = F.col("pattern").rlike(r"\\[0-9k]|\(\?[a-zA-Z-]+\)")
    chunk = F.pmod(F.xxhash64("pattern"), F.ceil(F.lit(loose.count()) / F.lit(TOGETHER)).cast("bigint"))
    chunk = F.when(refers, F.concat(F.lit("="), "pattern")).otherwise(chunk.cast("string"))
    together = F.array_join(F.transform(F.array_sort(F.collect_list("pattern")), lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|")
    joined = loose.groupBy(chunk.alias("chunk")).agg(together.alias("any"), F.array_sort(F.collect_list("pattern")).alias("all"))
    # Each alternation is one test per name; of the names it lets through, each pattern.
    for row in joined.collect() if not loose.isEmpty() else []:
        some = names.where(F.col("name").rlike(row["any"]))
        each = some.select("name", F.explode(F.array(*[F.lit(p) for p in row["all"]])).alias("pattern"))
        pairs = pairs.union(each.where("name rlike pattern"))
    return pairs.groupBy("name").agg(F.min("pattern").alias("pattern"))


def blocklist_by_table(df: DataFrame, patterns: DataFrame, name: str = "name", pattern: str = "pattern") -> DataFrame:
    """Drop the rows whose name matches a pattern of the table. Rows without a name stay."""
    gone = cut_lineage(matched_names(df, patterns, name, pattern).select(F.col("name").alias(name)))
    return look_up(df, gone, [name], df.columns, "left_anti")
