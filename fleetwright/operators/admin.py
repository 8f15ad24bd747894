"""Requirements, wanted extras and deletes by subquery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.lookup import look_up


def missing_requirements(
    records: DataFrame,
    present: DataFrame,
    required: Sequence[str],
    waived: DataFrame | None = None,
    record: str = "record_id",
    field: str = "field",
    value: str | None = None,
) -> DataFrame:
    """Which of the required fields each record lacks, in the order of `required`.

    `present` holds (record, field); with `value` a blank value counts as missing. `waived`
    holds (record, field) pairs that are not asked for. Only required fields are grouped, so a
    group never holds more entries than the list is long.
    """
    have = present
    if value is not None:
        have = have.where(F.col(value) != "")
    have = have.select(record, field)
    if waived is not None:
        have = have.unionByName(waived.select(record, field))
    found = (
        have.where(F.col(field).isin(*required))
        .groupBy(record)
        .agg(F.collect_set(field).alias("_have"))
    )
    wanted = F.array(*[F.lit(r) for r in required])
    empty = F.array().cast("array<string>")
    return (
        records.select(record)
        .distinct()
        .join(found, record, "left")
        .select(
            record, F.array_except(wanted, F.coalesce(F.col("_have"), empty)).alias("missing")
        )
    )


def repository_url(repo: Column | str) -> Column:
    """The address with `https://` in front."""
    col = F.col(repo) if isinstance(repo, str) else repo
    return F.when(F.startswith(col, F.lit("https://")), col).otherwise(
        F.concat(F.lit("https://"), col)
    )


def select_extras(
    requests: DataFrame, available: DataFrame, entry: str = "entry_id"
) -> DataFrame:
    """Wanted add-ons per request with their state: selected, missing, or skipped.

    `addons` is a comma list or an array. A request without repository or add-ons is one
    skipped row.
    """
    listed = F.col("addons")
    if requests.schema["addons"].dataType.typeName() == "string":
        blank = F.coalesce(listed, F.lit("")) == ""
        listed = F.split(listed, ",")
    else:
        blank = F.coalesce(F.size(listed), F.lit(0)) <= 0
    skipped = (F.coalesce(F.col("repo"), F.lit("")) == "") | blank
    wanted = requests.select(
        entry,
        skipped.alias("_skipped"),
        F.when(~skipped, repository_url("repo")).alias("url"),
        F.explode_outer(F.when(~skipped, listed)).alias("addon"),
    )
    there = available.select(entry, "addon").distinct().withColumn("_there", F.lit(True))
    return wanted.join(there, [entry, "addon"], "left").select(
        entry,
        "url",
        "addon",
        F.when(F.col("_skipped"), "skipped")
        .when(F.col("_there"), "selected")
        .otherwise("missing")
        .alias("status"),
    )


def delete_by_subquery(df: DataFrame, condition: Column, key: str = "id") -> DataFrame:
    """The rows left after deleting every row whose key is among those meeting the condition.

    The keys are selected with their filter pushed to the scan and made distinct on the map
    side; rows for which the condition is null stay.
    """
    doomed = df.where(condition).select(key).distinct()
    others = [c for c in df.columns if c != key] or [key]
    return look_up(df, doomed, [key], others, "left_anti")


def asset_rows() -> Column:
    """Rows of generated page assets: view attachments named like `%assets_%`, where `_` stands
    for any one character."""
    return (F.col("res_model") == "ir.ui.view") & F.col("name").like("%assets_%")
