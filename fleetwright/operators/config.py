"""Large sets of ini files as tables of lines (file_id, line_no, line).

`line_no` orders the lines of a file and need not be dense. Files without lines have no rows;
operators that must know such files take them in `files`, a table of file_id. Changing
operators return the table with new dense line numbers.

The section of a line is carried down from the last header above it in blocks of lines
(`functions.blocks`), so that one huge file does not end up in one task.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.blocks import BLOCK_ROWS, carry, ordinal, row_block
from fleetwright.functions.lookup import look_up
from fleetwright.functions.text import non_blank, strip
from fleetwright.session import cut_lineage

FILE, NO, LINE = "file_id", "line_no", "line"


def _line_columns() -> dict[str, Column]:
    stripped = strip(LINE)
    at = F.instr(F.col(LINE), "=")
    kind = (
        F.when(F.startswith(stripped, F.lit("[")), "header")
        .when(stripped == "", "blank")
        .when(stripped.rlike("^[;#]"), "comment")
        .when(at > 0, "option")
        .otherwise("text")
    )
    option = kind == "option"
    return {
        "kind": kind,
        "key": F.when(option, strip(F.substring(F.col(LINE), F.lit(1), at - 1))),
        "value": F.when(option, strip(F.substring(F.col(LINE), at + 1, F.length(LINE)))),
    }


def _with_header(lines: DataFrame, rows: int) -> DataFrame:
    """Lines with their kind, key and value, and the header above: its text and number."""
    parsed = lines.select(FILE, NO, LINE).withColumns(_line_columns())
    head = F.when(
        F.col("kind") == "header",
        F.struct(F.lower(strip(LINE)).alias("text"), F.col(NO).alias("at")),
    )
    blocks = parsed.withColumn("_block", row_block(NO, rows))
    return carry(blocks, [FILE], "_block", [NO], head, "_head").drop("_block")


def _section_name() -> Column:
    return F.btrim(F.col("_head.text"), F.lit("[]"))


def config_parse(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every line with its section, kind, key and value.

    The first `=` splits key and value, both trimmed. Kinds: header, option, comment, blank,
    text. Section names are lower case; lines above the first header have none.
    """
    return _with_header(lines, block_rows).select(
        FILE, NO, LINE, _section_name().alias("section"), "kind", "key", "value"
    )


def config_get(parsed: DataFrame, section: str, key: str) -> DataFrame:
    """First value of the key in any section of that name, per file that has one.

    Section names match in any case, keys exactly.
    """
    hits = parsed.where(
        (F.col("kind") == "option")
        & (F.col("section") == section.lower())
        & (F.col("key") == key)
    )
    return hits.groupBy(FILE).agg(F.min_by("value", NO).alias("value"))


def commented_definition(keys: Sequence[str], line: str = LINE) -> Column:
    """True for a commented-out definition of one of the keys."""
    names = "|".join(re.escape(k) for k in keys)
    return F.col(line).rlike(rf"^\s*[;#]\s*(?:{names})\s*=")


def config_drop_commented(lines: DataFrame, *keys: str) -> DataFrame:
    """Remove commented-out definitions of the keys in every section."""
    return lines.where(~commented_definition(keys))


def _renumber(
    kept: DataFrame, others: DataFrame, plain: DataFrame, block_rows: int
) -> DataFrame:
    """Dense line numbers by (line_no, _sub), counted in blocks of the old numbers.

    `plain` are the lines behind `kept`, row for row: they are counted without working out
    their sections a second time.
    """
    block = row_block(NO, block_rows).alias("_block")
    rows = kept.unionByName(others).select(FILE, F.col(NO).alias("_no"), "_sub", LINE, block)
    counted = plain.select(FILE, NO).unionByName(others.select(FILE, NO))
    sizes = counted.select(FILE, block, F.lit(1).cast("bigint").alias("_total"))
    placed = ordinal(rows, [FILE], "_block", ["_no", "_sub"], NO, sizes=sizes)
    return placed.select(FILE, NO, LINE)


def _pairs(settings: Mapping[str, str | None] | Sequence[tuple[str, str | None]]):
    items = settings.items() if isinstance(settings, Mapping) else settings
    return [(k, v) for k, v in items if v is not None]


def _value_map(pairs: Sequence[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def _setting_lines(pairs: Sequence[tuple[str, str]], present: Column, first_sub: int) -> Column:
    """Array of (sub, line) for the keys not in `present`, in the order of the pairs."""
    rows = F.array(
        *[
            F.struct(
                F.lit(first_sub + i).alias("_sub"),
                F.lit(k).alias("_key"),
                F.lit(f"{k} = {v}").alias(LINE),
            )
            for i, (k, v) in enumerate(pairs)
        ]
    )
    return F.filter(rows, lambda r: ~F.array_contains(present, r["_key"]))


def _file_summary(sections: DataFrame, match: Column, files: DataFrame | None) -> DataFrame:
    """One row per file from one row per section: where the first matching section ends, the
    keys seen in matching sections, and the first and last line of the file."""
    summary = sections.groupBy(FILE).agg(
        F.min(F.when(match, F.struct(F.col("_at"), F.col("_end")))).alias("_first"),
        F.flatten(F.collect_set(F.when(match, F.col("_keys")))).alias("_present"),
        F.coalesce(F.bool_or(F.when(match, F.col("_differs"))), F.lit(False)).alias("_differs"),
        F.min("_start").alias("_top"),
        F.max("_end").alias("_bottom"),
        F.max(F.when(F.col("_at").isNull(), F.col("_end"))).alias("_above_headers"),
        F.max_by("_header", "_at").alias("_last_header"),
    )
    if files is not None:
        summary = files.select(FILE).distinct().join(summary, FILE, "left").withColumns(
            {
                "_present": F.coalesce("_present", F.array().cast("array<string>")),
                "_differs": F.coalesce("_differs", F.lit(False)),
                "_top": F.coalesce("_top", F.lit(1)),
                "_bottom": F.coalesce("_bottom", F.lit(0)),
            }
        )
    return summary


def _sections(parsed: DataFrame, wanted: Column, differs: Column) -> DataFrame:
    """One row per section instance; partial aggregation keeps at most the given keys."""
    return parsed.groupBy(FILE, F.col("_head.at").alias("_at")).agg(
        F.first("_head.text").alias("_header"),
        F.min(NO).alias("_start"),
        F.max(NO).alias("_end"),
        F.collect_set(F.when(wanted, F.col("key"))).alias("_keys"),
        F.coalesce(F.bool_or(wanted & differs), F.lit(False)).alias("_differs"),
    )


def config_set(
    lines: DataFrame,
    section: str,
    settings: Mapping[str, str | None] | Sequence[tuple[str, str | None]],
    files: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Set the keys in the section of every file.

    Every occurrence in any section of that name is replaced and commented-out definitions are
    removed. A key that does not occur is added at the end of the first such section; without
    such a section, section and key are appended to the file. Null values are skipped.
    """
    pairs = _pairs(settings)
    if not pairs:
        return lines
    keys = [k for k, _ in pairs]
    parsed = _with_header(lines, block_rows)
    name = section.lower()
    in_section = _section_name() == name
    wanted = (F.col("kind") == "option") & F.col("key").isin(*keys)
    replaced = F.when(
        wanted & in_section, F.concat(F.col("key"), F.lit(" = "), _value_map(pairs)[F.col("key")])
    ).otherwise(F.col(LINE))
    stays = ~commented_definition(keys)
    kept = parsed.where(stays).select(FILE, NO, F.lit(0).alias("_sub"), replaced.alias(LINE))
    sections = _sections(parsed, wanted, F.lit(False))
    match = F.btrim(F.col("_header"), F.lit("[]")) == name
    # One small row per file, stored: the lines are read once for it and once for the result.
    summary = cut_lineage(_file_summary(sections, match, files))
    header = F.when(
        F.col("_first").isNull(),
        F.array(
            F.struct(
                F.lit(1).alias("_sub"),
                F.lit(None).cast("string").alias("_key"),
                F.lit(f"[{section}]").alias(LINE),
            )
        ),
    ).otherwise(F.array().cast("array<struct<_sub:int,_key:string,line:string>>"))
    added = summary.select(
        FILE,
        F.coalesce("_first._end", "_bottom").alias(NO),
        F.explode(
            F.concat(header, _setting_lines(pairs, F.col("_present"), 2))
        ).alias("_new"),
    ).select(FILE, NO, "_new._sub", f"_new.{LINE}")
    return _renumber(kept, added, lines.where(stays), block_rows)


def config_apply_defaults(
    lines: DataFrame,
    defaults: Mapping[str, str | None] | Sequence[tuple[str, str | None]],
    files: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Bring the `[options]` section of every file to the defaults: (lines, changed per file).

    A differing value is replaced by the default. Absent keys are added at the end of the first
    `[options]` section, but only if the last header of the file is `[options]` too; a file
    without that section gets its header as first line. Commented-out definitions are removed.
    A file in which no value changes and no key is added stays as it is, comments included.
    """
    pairs = _pairs(defaults)
    keys = [k for k, _ in pairs]
    parsed = _with_header(lines, block_rows)
    in_options = F.coalesce(F.col("_head.text") == "[options]", F.lit(False))
    wanted = (F.col("kind") == "option") & F.col("key").isin(*keys)
    differs = ~F.col("value").eqNullSafe(_value_map(pairs)[F.col("key")])
    sections = _sections(parsed, wanted, differs)
    summary = _file_summary(
        sections, F.coalesce(F.col("_header") == "[options]", F.lit(False)), files
    )
    adds = F.col("_first").isNull() | (F.col("_last_header") == "[options]")
    absent = F.when(adds, _setting_lines(pairs, F.col("_present"), 2)).otherwise(
        F.array().cast("array<struct<_sub:int,_key:string,line:string>>")
    )
    # One small row per file decides about the rest; it is stored, because three parts of the
    # result read it and the lines should not be parsed for each.
    report = cut_lineage(
        summary.select(
            FILE,
            F.col("_first").isNull().alias("_headless"),
            F.coalesce("_first._end", "_above_headers", F.col("_top")).alias(NO),
            (F.col("_first").isNull() & F.col("_above_headers").isNull()).alias("_on_top"),
            "_top",
            absent.alias("_absent"),
            (F.col("_differs") | (F.size(absent) > 0)).alias("changed"),
        )
    )
    # Only commented-out definitions depend on the outcome for the whole file; all other lines
    # are settled where they stand.
    twin = commented_definition(keys)
    replaced = F.when(
        in_options & wanted & differs,
        F.concat(F.col("key"), F.lit(" = "), _value_map(pairs)[F.col("key")]),
    ).otherwise(F.col(LINE))
    plain = parsed.where(~twin).select(FILE, NO, F.lit(0).alias("_sub"), replaced.alias(LINE))
    twins = look_up(
        lines.where(twin), report.where(~F.col("changed")), [FILE], [NO], "left_semi"
    )
    # A new header goes above everything. Without any line above the first old header the added
    # keys go right below the new one.
    above = len(pairs) + 2
    header = report.where(F.col("changed") & F.col("_headless")).select(
        FILE, F.col("_top").alias(NO), F.lit(-above).alias("_sub"), F.lit("[options]").alias(LINE)
    )
    sub = F.col("_new._sub") - F.when(F.col("_on_top"), above).otherwise(0)
    added = report.withColumn("_new", F.explode("_absent")).select(
        FILE, NO, sub.alias("_sub"), f"_new.{LINE}"
    )
    others = (
        twins.select(FILE, NO, F.lit(0).alias("_sub"), LINE).unionByName(header).unionByName(added)
    )
    changed = report.select(FILE, "changed")
    return _renumber(plain, others, lines.where(~twin), block_rows), changed


def config_render(
    lines: DataFrame, files: DataFrame | None = None, chunk_lines: int = 100_000
) -> DataFrame:
    """Lines back to text, one row per file and chunk of `chunk_lines` lines.

    A text that holds no `[options]` anywhere gets that header on top. Chunks (from 0) put one
    after another give the file; usual files have one.
    """
    chunk = F.floor((F.col(NO) - 1) / F.lit(chunk_lines)).cast("bigint")
    has = F.coalesce(F.contains(F.col(LINE), F.lit("[options]")), F.lit(False))
    chunks = (
        lines.withColumn("chunk_no", chunk)
        .groupBy(FILE, "chunk_no")
        .agg(
            F.sort_array(F.collect_list(F.struct(NO, LINE))).alias("_l"),
            F.bool_or(has).alias("_has"),
        )
        .select(
            FILE,
            "chunk_no",
            F.concat(F.array_join(F.col(f"_l.{LINE}"), "\n"), F.lit("\n")).alias("text"),
            "_has",
        )
    )
    per_file = chunks.groupBy(FILE).agg(
        F.bool_or("_has").alias("_any"), F.min("chunk_no").alias("_lowest")
    )
    if files is not None:
        per_file = files.select(FILE).distinct().join(per_file, FILE, "left")
    joined = per_file.join(chunks.drop("_has"), FILE, "left")
    on_top = ~F.coalesce(F.col("_any"), F.lit(False)) & (
        F.col("chunk_no").isNull() | (F.col("chunk_no") == F.col("_lowest"))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    return joined.select(
        FILE,
        F.coalesce("chunk_no", F.lit(0)).cast("bigint").alias("chunk_no"),
        F.when(on_top, F.concat(F.lit("[options]\n"), text)).otherwise(text).alias("text"),
    )


def validate_options(df: DataFrame, line: str = LINE) -> tuple[DataFrame, DataFrame]:
    """Split VAR=VAL lines into (good, bad).

    Lines whose very first character is `#` are skipped. All other lines are trimmed and must
    be word characters, `=`, word characters; a blank line is bad. Bad lines are kept apart.
    """
    used = df.where(~F.startswith(F.col(line), F.lit("#"))).withColumn(line, strip(line))
    fine = F.col(line).rlike(r"(?U)^\w+=\w+$")
    parts = F.split(F.col(line), "=", 2)
    good = used.where(fine).withColumns({"var": parts[0], "val": parts[1]}).drop(line)
    return good, used.where(~fine)


def option_present(args: Column | str, option: str) -> Column:
    """True where the argument list holds the option, alone or as `option=...`."""
    col = F.col(args) if isinstance(args, str) else args
    return F.exists(
        col, lambda a: (a == option) | F.startswith(a, F.lit(f"{option}="))
    )


def layered_settings(
    layers: DataFrame,
    by: Sequence[str] = ("host_id",),
    name: str = "name",
    rank: str = "layer_rank",
    value: str = "value",
    presence_ranks: Sequence[int] = (),
) -> DataFrame:
    """Per key the first layer with a value, and whether lower layers say something else.

    A blank value counts as unset, except in the layers of `presence_ranks`, where being given
    at all is enough (a command-line option that is present, even without text).
    """
    counts = F.col(value).isNotNull() & (
        (F.col(value) != "") | F.col(rank).isin(*presence_ranks) if presence_ranks else F.col(value) != ""
    )
    used = F.when(counts, F.col(value))
    top = F.min(F.when(counts, F.struct(F.col(rank).alias("r"), F.col(value).alias("v"))))
    return (
        layers.groupBy(*by, name)
        .agg(
            top.alias("_top"),
            (F.min(used) != F.max(used)).alias("_differ"),
        )
        .select(
            *by,
            name,
            F.col("_top.v").alias("value"),
            F.col("_top.r").alias("layer"),
            F.coalesce("_differ", F.lit(False)).alias("conflict"),
        )
    )


def paired_connection(
    df: DataFrame,
    default_host: str = "postgres",
    default_port: str = "5432",
    default_mode: str = "disable",
) -> DataFrame:
    """Host, port and mode switch together: all from the pooler if it has a host, else all from
    the database. Blank values fall back to the defaults."""
    pooled = F.coalesce(F.col("pooler_host") != "", F.lit(False))
    host, port, mode = F.lit(default_host), F.lit(default_port), F.lit(default_mode)

    def pick(field: str, default: Column) -> Column:
        return F.coalesce(
            F.when(pooled, non_blank(f"pooler_{field}")).otherwise(non_blank(f"db_{field}")), default
        )

    return df.withColumns(
        {
            "use_host": pick("host", host),
            "use_port": pick("port", port),
            "use_mode": pick("mode", mode),
        }
    )

