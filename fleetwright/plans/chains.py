"""Operators in the order in which they are used together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.operators import archives, catalog, graph, trees
from fleetwright.session import cut_lineage

# Fixed value: modules that are always installed.
REQUIRED = ["web", "base"]


def install_list(
    catalogue: DataFrame,
    edges: DataFrame,
    languages: str | None = None,
    blocklist: str | None = None,
    required: Sequence[str] = REQUIRED,
) -> DataFrame:
    """(name, ord): the modules to install, dependencies first, required ones in any case.

    `catalogue` holds name, path_rank and seq of every module found, `edges` (module, dep).
    """
    found = catalog.blocklist_filter(catalogue, "name", blocklist)
    found = catalog.locale_module_filter(found, "name", catalog.country_codes(languages))
    # The graph joins this list once per level, so it is worked out only once.
    chosen = cut_lineage(catalog.first_wins_dedup(found).select("name", "ord"))
    ordered = graph.dependency_order(chosen, edges, module="name", seq="ord")
    named = ordered.select(F.col("module").alias("name"), "ord")
    return catalog.mandatory_append(named, required)


def restore_choice(
    catalogue: DataFrame,
    contents: DataFrame,
    sidecars: DataFrame,
    version: str,
    db: str | None = None,
    skip_hash: bool = False,
) -> DataFrame:
    """(db, version, file, status): the newest archive to restore and the state of its hash.

    Without `db` the newest archive of the version is taken. `contents` holds (file, content);
    only the chosen archive is hashed.
    """
    newest = archives.latest_archive(catalogue, version, db, by_db=db is not None)
    chosen = archives.parse_archive_name(newest.select(F.col("filename").alias("file")), "file")
    chosen = chosen.select("db", "version", "file")
    wanted = contents.join(chosen.select("file"), "file", "left_semi")
    return chosen.join(trees.checksum_verify(wanted, sidecars, skip=skip_hash), "file").select(
        "db", "version", "file", "status"
    )
