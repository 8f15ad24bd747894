"""Registered queries: the operators wired to inputs over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.functions.blocks import TABLE_BLOCK_ROWS, row_block
from fleetwright.functions.text import record_fingerprint, render_template, truthy_flag
from fleetwright.operators import admin, archives, catalog, config, graph, patterns, runs, trees, waiting, web
from fleetwright.plans import chains
from fleetwright.plans.fixtures import SNAPSHOT_TABLES, fixture, load, run_sql
from fleetwright.plans.oracle import CONNECTIONS, DUMP_FILES, NAMED_DEPS
from fleetwright.session import cut_lineage, new_scratch_path
from fleetwright.sources import files as sources
from fleetwright.sources import lines as line_sources
from fleetwright.sources import snapshot
from fleetwright.sources.logtail import LogTailSource
from fleetwright.streaming import lease, requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


# sources and sinks


@query
def scan_module_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Writes one manifest per part below a folder per module, then scans them."""
    edges = fixture(spark, sf, "FX_DEPS").groupBy("module").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("dep")), lambda d: F.concat(F.lit("'m"), d, F.lit("'"))), ", ").alias("deps")
    )
    root = new_scratch_path(spark, "manifests")
    manifests = (
        load(spark, sf, "part")
        .select(F.col("p_partkey").alias("module"))
        .join(edges, "module", "left")
        .select(
            F.concat(F.lit(f"{root}/m"), "module").alias("folder"),
            F.format_string("{'depends': [%s]}", F.coalesce("deps", F.lit(""))).alias("content"),
        )
    )
    spread = manifests.repartition(spark.sparkContext.defaultParallelism * 4, "folder")
    spread.mapInPandas(_write_manifests, "folder string").write.format("noop").mode(
        "overwrite"
    ).save()
    found = sources.scan_module_manifests(spark, [root])
    return found.select("name", F.array_join("depends", ",").alias("depends"))


def _write_manifests(batches):
    """Writes `content` as the manifest of `folder`."""
    for pdf in batches:
        for folder, content in pdf.itertuples(index=False, name=None):
            _write_file(f"{folder}/{sources.MANIFEST}", content)
        yield pdf[["folder"]]


def _write_texts(batches):
    for pdf in batches:
        for path, text in pdf.itertuples(index=False, name=None):
            _write_file(path, text)
        yield pdf[["path"]]


def _write_file(path: str, content: str) -> None:
    store, name = sources.open_store(path)
    store.create_dir(name.rpartition("/")[0])
    with store.open_output_stream(name) as out:
        out.write(content.encode())


@query
def scan_config_files(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the config lines as files of at most one block of lines, then scans them."""
    root = new_scratch_path(spark, "config")
    part = row_block(F.col("line_no") - 1)
    (
        fixture(spark, sf, "FX_CONFIG_LINES")
        .withColumn("part_no", part)
        .repartition(spark.sparkContext.defaultParallelism * 4, "file_id", "part_no")
        .sortWithinPartitions("file_id", "part_no", "line_no")
        .select("line", "file_id", "part_no")
        .write.partitionBy("file_id", "part_no")
        .text(root)
    )

    def named(name: str):
        return F.regexp_extract("file_id", f"/{name}=([0-9]+)/", 1).cast("bigint")

    return line_sources.scan_config_files(spark, root, hidden=False).select(
        named("file_id").cast("int").alias("file_id"), named("part_no").alias("part_no"), "line_no", "line"
    )


@query
def scan_file_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Writes every document as a file in one of 50 folders, then scans them."""
    root = new_scratch_path(spark, "texts")
    path = F.format_string(f"{root}/g%d/d%d.txt", F.col("doc_id") % 50, F.col("doc_id"))
    texts = load(spark, sf, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    spread = texts.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    spread.mapInPandas(_write_texts, "path string").write.format("noop").mode("overwrite").save()
    return sources.scan_file_inventory(spark, root).select("grp", "file_key", "size", "content_hash")


def _exported(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    folder = new_scratch_path(spark, "snapshot")
    tables = {t: load(spark, sf, t) for t in SNAPSHOT_TABLES}
    return folder, snapshot.export_snapshot(spark, tables, folder)


@query
def export_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    _, manifest = _exported(spark, sf)
    return manifest.select(F.col("table").alias("table_name"), F.col("rows").alias("n_rows"))


@query
def import_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    folder, _ = _exported(spark, sf)
    target = new_scratch_path(spark, "restored")
    name = target.rsplit("/", 1)[1].replace("-", "_")
    loaded = snapshot.import_snapshot(spark, folder, name, "refuse", location=target)
    report = cut_lineage(
        loaded.select(F.col("table").alias("table_name"), F.col("rows").alias("n_rows"), "verified")
    )
    spark.sql(f"DROP DATABASE `{name}` CASCADE")
    return report


@query
def import_snapshot_replace(spark: SparkSession, sf: str) -> DataFrame:
    """The database that is replaced holds a table that the snapshot has not."""
    folder, _ = _exported(spark, sf)
    target = new_scratch_path(spark, "replaced")
    name = target.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE `{name}` LOCATION '{target}'")
    load(spark, sf, "region").write.saveAsTable(f"`{name}`.`left_over`")
    loaded = snapshot.import_snapshot(spark, folder, name, "replace", location=target)
    tables_now = spark.sql(f"SHOW TABLES IN `{name}`").where("NOT isTemporary").count()
    report = cut_lineage(
        loaded.select(
            F.col("table").alias("table_name"),
            F.col("rows").alias("n_rows"),
            "verified",
            F.lit(tables_now).cast("int").alias("tables_now"),
        )
    )
    spark.sql(f"DROP DATABASE `{name}` CASCADE")
    return report


def _log_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.posexplode(F.split("text", "\n")).alias("piece", "line")
    return load(spark, sf, "conversations").select("conv_id", "turn", lines)


@query
def log_tail_from_offset(spark: SparkSession, sf: str) -> DataFrame:
    lines = _log_lines(spark, sf).withColumn("_block", row_block("turn", 1_000))
    return line_sources.log_tail_from_offset(
        lines, 333, file="conv_id", order=["turn", "piece"]
    ).select("conv_id", "byte_start", "line")


def _log_folder(spark: SparkSession, sf: str) -> str:
    root = new_scratch_path(spark, "logs")
    (
        _log_lines(spark, sf)
        .repartition(spark.sparkContext.defaultParallelism * 4, "conv_id")
        .sortWithinPartitions("conv_id", "turn", "piece")
        .select("line", "conv_id")
        .write.partitionBy("conv_id")
        .text(root)
    )
    return root


def _conv_id(c: str):
    return F.regexp_extract(c, "/conv_id=([0-9]+)/", 1).cast("bigint").alias("conv_id")


@query
def log_tail_files(spark: SparkSession, sf: str) -> DataFrame:
    found = line_sources.scan_log_lines(spark, _log_folder(spark, sf), hidden=False)
    return found.select(_conv_id("file"), "byte_start", "line")


@query
def log_tail_stream(spark: SparkSession, sf: str) -> DataFrame:
    root = _log_folder(spark, sf)
    spark.dataSource.register(LogTailSource)
    tail = (
        spark.readStream.format("log_tail").option("path", root).option("glob", "conv_id=*/part-*").load()
    )
    return _drain(spark, tail, "log_tail").select(_conv_id("file"), "byte_start", "line")


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, append it to files and read those."""
    out, marks = new_scratch_path(spark, name), new_scratch_path(spark, f"{name}-marks")
    (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", marks)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(out)


# rules on single rows


@query
def blocklist_filter(spark: SparkSession, sf: str) -> DataFrame:
    modules = fixture(spark, sf, "FX_CATALOG")
    return catalog.blocklist_filter(modules, "name", "^red_.*, _1[0-5]$ us_4").select(
        "path_rank", "seq", "name"
    )


@query
def blocklist_by_table(spark: SparkSession, sf: str) -> DataFrame:
    modules = fixture(spark, sf, "FX_CATALOG")
    return patterns.blocklist_by_table(modules, fixture(spark, sf, "FX_PATTERNS")).select("path_rank", "seq", "name")


@query
def locale_module_filter(spark: SparkSession, sf: str) -> DataFrame:
    modules = fixture(spark, sf, "FX_CATALOG")
    return catalog.locale_module_filter(modules, "name", ["au", "us"]).select(
        "path_rank", "seq", "name"
    )


@query
def path_hygiene_filter(spark: SparkSession, sf: str) -> DataFrame:
    return trees.path_hygiene_filter(fixture(spark, sf, "FX_PATHS"))


@query
def validate_options(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = config.validate_options(fixture(spark, sf, "FX_OPTIONS"))
    return good.unionByName(
        bad.withColumnRenamed("line", "bad"), allowMissingColumns=True
    ).select("line_no", "var", "val", "bad")


@query
def classify_request(spark: SparkSession, sf: str) -> DataFrame:
    return web.classify_request(fixture(spark, sf, "FX_REQUESTS")).select("page_id", "class", "status")


@query
def forwarded_headers(spark: SparkSession, sf: str) -> DataFrame:
    port = F.when(F.col("page_id") % 2 == 0, "8443").otherwise("")
    upgrade = F.when(F.col("page_id") % 3 == 0, "websocket").otherwise("")
    return web.forwarded_headers(
        fixture(spark, sf, "FX_REQUESTS"), forwarded_port=port, upgrade=upgrade
    ).select("page_id", "proto", "port", "ssl", "connection", "client_ip", "csp")


@query
def rewrite_insecure_links(spark: SparkSession, sf: str) -> DataFrame:
    return web.rewrite_insecure_links(fixture(spark, sf, "FX_REQUESTS")).select("page_id", "body")


@query
def classify_health_probe(spark: SparkSession, sf: str) -> DataFrame:
    return web.classify_health_probe(fixture(spark, sf, "FX_HEALTH")).select(
        "event_id", "kind", "verdict"
    )


@query
def classify_dump_file(spark: SparkSession, sf: str) -> DataFrame:
    dumps = run_sql(spark, sf, f"SELECT * FROM ({DUMP_FILES})", "FX_ARCHIVES")
    return archives.classify_dump_file(dumps).select("file_id", "base", "ext", "valid")


@query
def parse_archive_name(spark: SparkSession, sf: str) -> DataFrame:
    return archives.parse_archive_name(fixture(spark, sf, "FX_ARCHIVES")).select(
        "file_id", "db", "version", "stamp", "valid"
    )


@query
def refresh_gate(spark: SparkSession, sf: str) -> DataFrame:
    return runs.refresh_gate(fixture(spark, sf, "FX_GATES")).select("artifact_id", "needed", "reason")


TEMPLATE = "server {{HOST}}:{{PORT}}; # {{HOST}}"
SNIPPET = '<tag id="{{KEY}}"/>'


@query
def render_template_(spark: SparkSession, sf: str) -> DataFrame:
    text = render_template(TEMPLATE, {"HOST": "n_name", "PORT": "n_regionkey"})
    snippet = render_template(SNIPPET, {"KEY": "n_name"}, show=F.col("n_regionkey") != 0)
    return load(spark, sf, "nation").select(
        "n_nationkey", text.alias("text"), snippet.alias("snippet")
    )



@query
def truthy_flag_(spark: SparkSession, sf: str) -> DataFrame:
    rules = ["any_true", "only_true", "exact_true", "not_off", "non_blank"]
    return fixture(spark, sf, "FX_FLAGS").select(
        "id", *[truthy_flag("flag", r).alias(r) for r in rules]
    )



@query
def rpc_response_extract(spark: SparkSession, sf: str) -> DataFrame:
    return web.rpc_response_extract(fixture(spark, sf, "FX_RPC")).select(
        "event_id", "outcome", "message", "result"
    )


# lookups


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf, "FX_SNAP_SOURCE"), fixture(spark, sf, "FX_SNAP_TARGET")


@query
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return trees.snapshot_diff(*_snapshots(spark, sf))


@query
def group_change_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return trees.group_change_rollup(trees.snapshot_diff(*_snapshots(spark, sf)))


@query
def upsert_groups(spark: SparkSession, sf: str) -> DataFrame:
    return trees.upsert_groups(*_snapshots(spark, sf))


@query
def overlay_merge(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _snapshots(spark, sf)
    return trees.overlay_merge(base=target, new=source)


def _folder_trees(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fixture(spark, sf, "FX_TREE_SOURCE"), fixture(spark, sf, "FX_TREE_TARGET")


@query
def tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    return trees.snapshot_diff(*_folder_trees(spark, sf))


@query
def tree_changes(spark: SparkSession, sf: str) -> DataFrame:
    return trees.tree_changes(*_folder_trees(spark, sf))


@query
def differing_folders(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _folder_trees(spark, sf)
    return trees.differing_folders(trees.tree_digests(source), trees.tree_digests(target))


@query
def tree_merge(spark: SparkSession, sf: str) -> DataFrame:
    source, target = _folder_trees(spark, sf)
    return trees.overlay_merge(base=target, new=source)


@query
def mandatory_append(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue in its sparse order plus `base`; `web` has to be appended."""
    chosen = run_sql(
        spark,
        sf,
        "SELECT name, path_rank * 1000000 + seq AS ord FROM fx_catalog UNION ALL SELECT 'base', -1",
        "FX_CATALOG",
    )
    return catalog.mandatory_append(chosen, ["web", "base"])


@query
def missing_requirements(spark: SparkSession, sf: str) -> DataFrame:
    present = fixture(spark, sf, "FX_FIELDS")
    records = load(spark, sf, "orders").select(F.col("o_custkey").alias("record_id"))
    waived = records.where(F.col("record_id") % 5 == 0).withColumn("field", F.lit("k6"))
    required = [f"k{i}" for i in range(7)]
    lacking = admin.missing_requirements(records, present, required, waived)
    return lacking.select("record_id", F.array_join("missing", ",").alias("missing"))


@query
def select_extras(spark: SparkSession, sf: str) -> DataFrame:
    return admin.select_extras(fixture(spark, sf, "FX_EXTRAS"), fixture(spark, sf, "FX_AVAILABLE"))


@query
def delete_by_subquery(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixture(spark, sf, "FX_ATTACHMENTS")
    return admin.delete_by_subquery(rows, admin.asset_rows()).select("id", "res_model", "name")


@query
def overlay_lookup(spark: SparkSession, sf: str) -> DataFrame:
    layers = fixture(spark, sf, "FX_CATALOG").select(
        F.col("name").alias("path"), F.col("path_rank").alias("layer_rank")
    )
    suffix = F.when(F.col("p_partkey") % 7 == 0, "x").otherwise("")
    path = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), "p_size", suffix)
    wanted = load(spark, sf, "part").select(F.col("p_partkey").alias("request_id"), path.alias("path"))
    return trees.overlay_lookup(wanted, layers, ["extras", "enterprise", "community"])


@query
def checksum_verify(spark: SparkSession, sf: str) -> DataFrame:
    files = fixture(spark, sf, "FX_SIDECAR")
    noted = F.when(F.col("tampered"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    sidecars = files.where("has_sidecar").select("doc_id", F.sha2(noted, 256).alias("recorded_hash"))
    return trees.checksum_verify(files, sidecars, key="doc_id", content="text")


@query
def wait_until_ready(spark: SparkSession, sf: str) -> DataFrame:
    seen = fixture(spark, sf, "FX_READINESS")
    waiters = seen.where("is_waiter").select(F.col("event_id").alias("waiter_id"), "target", "ts")
    return waiting.wait_until_ready(waiters, seen, sleep_seconds=600, max_checks=10)


@query
def related_setting_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixture(spark, sf, "FX_SITES")
    sites = rows.select("website_id", "container_key").distinct()
    configs = rows.select("config_id", "website_id", "enabled")
    return web.related_setting_join(configs, sites).select(
        "config_id", "key", "has_key", "new_key", "valid"
    )


@query
def layered_settings(spark: SparkSession, sf: str) -> DataFrame:
    return config.layered_settings(fixture(spark, sf, "FX_LAYERS"))


@query
def paired_connection(spark: SparkSession, sf: str) -> DataFrame:
    hosts = run_sql(spark, sf, f"SELECT * FROM ({CONNECTIONS})", "FX_LAYERS")
    return config.paired_connection(hosts).select("host_id", "use_host", "use_port", "use_mode")


# aggregates


@query
def locale_codes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.locale_codes(fixture(spark, sf, "FX_LANGS"), "list_id", "langs")


@query
def ordered_list_agg(spark: SparkSession, sf: str) -> DataFrame:
    modules = fixture(spark, sf, "FX_CATALOG")
    block = F.col("path_rank").cast("bigint") * F.lit(1 << 40) + row_block("seq", TABLE_BLOCK_ROWS)
    return catalog.ordered_list_agg(modules, "name", ["path_rank", "seq"], block)


@query
def record_fingerprint_(spark: SparkSession, sf: str) -> DataFrame:
    print_of = record_fingerprint("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return load(spark, sf, "orders").select("o_orderkey", print_of.alias("fingerprint"))



@query
def retry_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return runs.retry_outcome(fixture(spark, sf, "FX_ATTEMPTS"))


@query
def run_verdict(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = runs.retry_outcome(fixture(spark, sf, "FX_ATTEMPTS"))
    return runs.run_verdict(cut_lineage(outcomes))


@query
def health_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return web.health_rollup(web.classify_health_probe(fixture(spark, sf, "FX_HEALTH")))


# order and choice


@query
def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.first_wins_dedup(fixture(spark, sf, "FX_CATALOG"))


@query
def search_roots(spark: SparkSession, sf: str) -> DataFrame:
    """Three roots and a fourth one that counts only if it holds a module; discovery over all."""
    found = fixture(spark, sf, "FX_CATALOG")
    roots = [found.where(F.col("path_rank") == i).select("name", "seq") for i in range(3)]
    own = load(spark, sf, "supplier").select(
        F.concat(F.lit("own_"), F.col("s_suppkey") % 97).alias("name"), F.col("s_suppkey").alias("seq")
    )
    with_fourth = catalog.first_wins_dedup(catalog.search_roots(*roots, optional=own))
    empty = own.where("name = 'no such module'")
    without = catalog.first_wins_dedup(catalog.search_roots(*roots, optional=empty))
    return with_fourth.withColumn("fourth", F.lit(True)).unionByName(without.withColumn("fourth", F.lit(False)))


@query
def latest_archive(spark: SparkSession, sf: str) -> DataFrame:
    return archives.latest_archive(fixture(spark, sf, "FX_ARCHIVES"))


@query
def latest_archive_by_version(spark: SparkSession, sf: str) -> DataFrame:
    return archives.latest_archive(fixture(spark, sf, "FX_ARCHIVES"), by_db=False)


@query
def lifecycle_audit(spark: SparkSession, sf: str) -> DataFrame:
    return runs.lifecycle_audit(fixture(spark, sf, "FX_LIFECYCLE"))


# chains


@query
def install_list(spark: SparkSession, sf: str) -> DataFrame:
    edges = run_sql(spark, sf, f"SELECT * FROM ({NAMED_DEPS})", "FX_CATALOG", "FX_DEPS")
    return chains.install_list(
        fixture(spark, sf, "FX_CATALOG"), edges, "en_AU,en_US", "^red_.*, _1[0-5]$ us_4"
    )


@query
def restore_choice(spark: SparkSession, sf: str) -> DataFrame:
    found = fixture(spark, sf, "FX_ARCHIVES")
    file = F.col("filename").alias("file")
    tampered = F.when(F.col("file_id") % 5 == 0, F.concat("filename", F.lit("!"))).otherwise(F.col("filename"))
    sidecars = found.where("file_id % 3 <> 0").select(file, F.sha2(tampered, 256).alias("recorded_hash"))
    return chains.restore_choice(found, found.select(file, F.col("filename").alias("content")), sidecars, "17")


@query
def write_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Stores the target tree by group, writes the upsert over it and reads it back."""
    source, target = (d.withColumn("grp", F.col("grp") % 100) for d in _snapshots(spark, sf))
    path = new_scratch_path(spark, "tree")
    by_group = target.select("file_key", "content_hash", "grp").repartition("grp")
    by_group.write.partitionBy("grp").parquet(path)
    stored = spark.read.schema(by_group.schema).parquet(path)
    trees.write_upsert(source, stored, path)
    return spark.read.schema(by_group.schema).parquet(path).select("grp", "file_key", "content_hash")


# config tables


@query
def config_parse(spark: SparkSession, sf: str) -> DataFrame:
    return config.config_parse(fixture(spark, sf, "FX_CONFIG_LINES"))


@query
def config_get(spark: SparkSession, sf: str) -> DataFrame:
    parsed = config.config_parse(fixture(spark, sf, "FX_CONFIG_LINES"))
    return config.config_get(parsed, "options", "key3")


@query
def config_drop_commented(spark: SparkSession, sf: str) -> DataFrame:
    return config.config_drop_commented(fixture(spark, sf, "FX_CONFIG_LINES"), "key5")


@query
def config_set(spark: SparkSession, sf: str) -> DataFrame:
    lines = fixture(spark, sf, "FX_CONFIG_LINES")
    return config.config_set(lines, "Building", {"key2": "fresh"})


DEFAULTS = {"key1": "d1", "key3": "v3=x", "fresh_key": "d9", "unset_key": None}


@query
def config_apply_defaults(spark: SparkSession, sf: str) -> DataFrame:
    lines = fixture(spark, sf, "FX_CONFIG_LINES")
    return config.config_apply_defaults(lines, DEFAULTS)[0]


@query
def config_apply_defaults_report(spark: SparkSession, sf: str) -> DataFrame:
    lines = fixture(spark, sf, "FX_CONFIG_LINES")
    return config.config_apply_defaults(lines, DEFAULTS)[1]


@query
def config_render(spark: SparkSession, sf: str) -> DataFrame:
    return config.config_render(fixture(spark, sf, "FX_CONFIG_LINES"))


# graph


@query
def dependency_order(spark: SparkSession, sf: str) -> DataFrame:
    modules = load(spark, sf, "part").select(
        F.col("p_partkey").alias("module"), F.col("p_partkey").alias("seq")
    )
    return graph.dependency_order(modules, fixture(spark, sf, "FX_DEPS"))


@query
def cycle_members(spark: SparkSession, sf: str) -> DataFrame:
    edges = fixture(spark, sf, "FX_DEPS").unionByName(fixture(spark, sf, "FX_BACK_EDGES"))
    return graph.cycle_members(edges)


# state


@query
def lease_state(spark: SparkSession, sf: str) -> DataFrame:
    return lease.lease_state(fixture(spark, sf, "FX_LEASES"))


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = load(spark, sf, "events").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )


def _lease_stream(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("lock_"), (F.col("user_id") % 20).cast("string"))
    op = F.when(F.col("event_type") == "error", "release").otherwise("acquire")
    return _event_stream(spark, sf).select(
        "event_id", name.alias("lock_name"), "ts", op.alias("op")
    )


@query
def lease_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _drain(spark, lease.lease_state_stream(_lease_stream(spark, sf)), "leases")


@query
def lease_state_micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    out, marks = new_scratch_path(spark, "leases"), new_scratch_path(spark, "leases-marks")
    lease.start_lease_state(_lease_stream(spark, sf), out, marks).awaitTermination()
    return lease.read_lease_state(spark, out)


@query
def request_state(spark: SparkSession, sf: str) -> DataFrame:
    return runs.request_state(fixture(spark, sf, "FX_LIFECYCLE"))


@query
def request_state_stream(spark: SparkSession, sf: str) -> DataFrame:
    state = (
        F.when(F.col("event_type") == "signup", "new")
        .when(F.col("event_type") == "view", "pending")
        .when(F.col("event_type") == "click", "progress")
        .when(F.col("event_type") == "purchase", "done")
        .otherwise("failed")
    )
    events = _event_stream(spark, sf).select(
        "event_id", F.col("user_id").alias("request_id"), "ts", state.alias("state")
    )
    out, marks = new_scratch_path(spark, "requests"), new_scratch_path(spark, "requests-marks")
    requests.start_request_state(events, out, marks).awaitTermination()
    return requests.read_request_state(spark, out).drop("event_id")

