"""Scale inputs derived from the given tables, as SQL that Spark and DuckDB both run.

Each entry is a query over the tables of one data folder. Two of them number rows inside groups that
may be very large; on Spark they are built with `functions.blocks` instead of one window per group.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.functions.blocks import ordinal, row_block

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "pages",
    "conversations",
]
SNAPSHOT_TABLES = [*TABLES, "embeddings", "benchmark", "labels"]

# fmt: off
SQL: dict[str, str] = {
    # discovered modules under three roots (rank 0 wins)
    "FX_CATALOG": r"""
SELECT CAST(p_partkey % 3 AS INT) AS path_rank, p_partkey AS seq,
       CASE WHEN p_partkey % 4 = 0
            THEN concat('l10n_', CASE p_partkey % 5 WHEN 0 THEN 'au' WHEN 1 THEN 'de' WHEN 2 THEN 'us' WHEN 3 THEN 'fr' ELSE 'generic' END, '_', CAST(p_size AS STRING))
            ELSE concat(replace(p_name, ' ', '_'), '_', CAST(p_size AS STRING)) END AS name
FROM part
""",
    # blocklist patterns, as many as every twentieth module
    "FX_PATTERNS": r"""
SELECT p_partkey AS pattern_id,
       CASE p_partkey % 6 WHEN 0 THEN concat('^', replace(p_name, ' ', '_'), '_', CAST(p_size AS STRING), '$')
            WHEN 1 THEN concat('*', replace(substring(p_name, 3, 9), ' ', '.'), '_[0-9]*', CAST(p_size AS STRING), '$')
            WHEN 2 THEN concat('^l10n_(au|de)_', CAST(p_size AS STRING), '$')
            WHEN 3 THEN concat('^[a-d]+_', substring(p_name, 2, 2), '.*_', CAST(p_size AS STRING), '$')
            WHEN 4 THEN concat(substring(replace(p_name, ' ', '_'), 1, 7), 'x?_+', CAST(p_size AS STRING))
            ELSE concat('nothing_', CAST(p_partkey AS STRING)) END AS pattern
FROM part WHERE p_partkey % 20 < 1
""",
    # module → dependency edges, acyclic; deps above 1000000 do not exist
    "FX_DEPS": r"""
SELECT p_partkey AS module, CAST(floor(p_partkey / 2) AS BIGINT) AS dep FROM part WHERE p_partkey >= 2
UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 3) AS BIGINT) FROM part WHERE p_partkey >= 3
UNION ALL SELECT p_partkey, p_partkey + 1000000 FROM part WHERE p_partkey % 10 = 0
""",
    # added to FX_DEPS these close cycles (2m already depends on m)
    "FX_BACK_EDGES": r"""
SELECT p_partkey AS module, p_partkey * 2 AS dep FROM part
WHERE p_partkey % 100 = 7 AND p_partkey * 2 < (SELECT count(*) FROM part)
""",
    # file inventory of the source tree (grp = one addon, key = file)
    "FX_SNAP_SOURCE": r"""
SELECT o_custkey AS grp, o_orderkey AS file_key,
       md5(concat(o_orderstatus, o_orderpriority, CAST(o_orderkey % 17 AS STRING))) AS content_hash
FROM orders WHERE o_orderkey % 11 <> 0 AND o_custkey % 10 <> 9
""",
    # file inventory of the target tree
    "FX_SNAP_TARGET": r"""
SELECT o_custkey AS grp, o_orderkey AS file_key,
       md5(concat(o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 170 = 0 THEN 'old' ELSE CAST(o_orderkey % 17 AS STRING) END)) AS content_hash
FROM orders WHERE o_custkey % 10 <> 8 AND (o_custkey % 4 <> 1 OR o_orderkey % 13 <> 0) AND (o_orderkey % 11 <> 0 OR o_custkey % 6 = 0)
""",
    # trees with folders; some have a file where the other side has a folder
    "FX_TREE_SOURCE": r"""
SELECT grp, file_key, min(content_hash) AS content_hash FROM (
    SELECT CAST(o_custkey % 500 AS BIGINT) AS grp, md5(concat(o_orderstatus, CAST(o_orderkey % 17 AS STRING))) AS content_hash,
           CASE WHEN o_custkey % 500 % 7 = 0 AND o_orderkey % 5 = 0 THEN 'd0' WHEN o_orderkey % 31 = 0 THEN concat('top', CAST(o_orderkey AS STRING))
                ELSE concat('d', CAST(o_orderkey % 5 AS STRING), '/s', CAST(o_orderkey % 3 AS STRING), '/f', CAST(o_orderkey AS STRING)) END AS file_key
    FROM orders WHERE o_orderkey % 11 <> 0 OR o_custkey % 500 % 4 <> 0) t GROUP BY grp, file_key
""",
    "FX_TREE_TARGET": r"""
SELECT grp, file_key, min(content_hash) AS content_hash FROM (
    SELECT CAST(o_custkey % 500 AS BIGINT) AS grp,
           md5(concat(o_orderstatus, CASE WHEN o_orderkey % 190 = 0 THEN 'old' ELSE CAST(o_orderkey % 17 AS STRING) END)) AS content_hash,
           CASE WHEN o_custkey % 500 % 6 = 1 AND o_orderkey % 5 = 1 AND o_orderkey % 3 = 0 THEN 'd1/s0' WHEN o_orderkey % 31 = 0 THEN concat('top', CAST(o_orderkey AS STRING))
                ELSE concat('d', CAST(o_orderkey % 5 AS STRING), '/s', CAST(o_orderkey % 3 AS STRING), '/f', CAST(o_orderkey AS STRING)) END AS file_key
    FROM orders WHERE o_orderkey % 13 <> 0 OR o_custkey % 500 % 3 <> 0) t GROUP BY grp, file_key
""",
    # backup file catalogue; 'bad.tar.gz' is malformed
    "FX_ARCHIVES": r"""
SELECT o_orderkey AS file_id,
       concat(CASE WHEN o_orderkey % 97 = 0 THEN 'bad'
                   ELSE concat('db_', CAST(o_custkey % 40 AS STRING), '_', CAST(16 + o_orderkey % 3 AS STRING), '_', CAST(20240000000000 + o_orderkey AS STRING)) END, '.tar.gz') AS filename,
       CAST((o_orderkey * 7919) % 1000003 AS BIGINT) AS mtime_s
FROM orders
""",
    # recorded digest tag per document; absent for every 20th, wrong where tampered
    "FX_SIDECAR": r"""
SELECT doc_id, text, doc_id % 20 <> 0 AS has_sidecar, doc_id % 15 = 1 AS tampered FROM documents
""",
    # one ini file per nation
    "FX_CONFIG_LINES": r"""
SELECT file_id, line_no,
       CASE WHEN line_no = 1 OR line_no % 9 = 0 THEN concat('[', CASE WHEN c_custkey % 3 = 0 THEN 'Options' ELSE lower(c_mktsegment) END, ']')
            WHEN c_custkey % 5 = 0 THEN concat('; key', CAST(c_custkey % 7 AS STRING), ' = old')
            WHEN c_custkey % 11 = 0 THEN ''
            ELSE concat('key', CAST(c_custkey % 7 AS STRING), ' = v', CAST(c_custkey AS STRING), '=x ') END AS line
FROM (SELECT c_nationkey AS file_id, c_custkey, c_mktsegment,
             CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS line_no FROM customer) t
""",
    # module upgrade attempts per run
    "FX_ATTEMPTS": r"""
SELECT l_suppkey AS run_id, l_partkey % 50 AS module,
       CAST(row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS BIGINT) AS attempt,
       CASE WHEN l_suppkey % 10 = 0 THEN false WHEN l_suppkey % 10 = 1 THEN true ELSE l_quantity > 35 END AS ok
FROM lineitem
""",
    # lock operations, default lease 3600 s
    "FX_LEASES": r"""
SELECT event_id, concat('lock_', CAST(user_id % 20 AS STRING)) AS lock_name, user_id AS actor, ts,
       CASE WHEN event_type = 'error' THEN 'release' ELSE 'acquire' END AS op
FROM events
""",
    # request status changes
    "FX_LIFECYCLE": r"""
SELECT event_id, user_id AS request_id, ts,
       CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'done' ELSE 'failed' END AS state
FROM events
""",
    # up/down observations; FX_WAITERS = the rows with is_waiter
    "FX_READINESS": r"""
SELECT event_id, user_id % 20 AS target, ts, event_type <> 'error' AS up, event_type = 'error' AS is_waiter FROM events
""",
    # proxied requests
    "FX_REQUESTS": r"""
SELECT page_id, url,
       CASE page_id % 8 WHEN 0 THEN '/index.PHP' WHEN 1 THEN '/blog/WP-Admin/x' WHEN 2 THEN '/.well-known/acme' WHEN 3 THEN '/web/static/src/a.js'
            WHEN 4 THEN '/web/filestore/ab/cd' WHEN 5 THEN '/web/static/x.cgi' WHEN 6 THEN '/shop' ELSE '/static/a.js' END AS path,
       CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'https' ELSE 'http' END AS x_forwarded_proto,
       CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('10.0.0.', CAST(page_id % 250 AS STRING)) ELSE concat('10.0.0.', CAST(page_id % 250 AS STRING), ', 192.168.0.1') END AS x_forwarded_for,
       concat('172.16.0.', CAST(page_id % 9 AS STRING)) AS remote_addr,
       CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/css' WHEN 2 THEN 'application/pdf' ELSE 'text/html' END AS content_type,
       concat(html, '<a href="http://shop', CAST(page_id % 5 AS STRING), '.example/x">') AS body,
       concat('shop', CAST(page_id % 3 AS STRING), '.example') AS host
FROM pages
""",
    # probe responses grouped by check
    "FX_HEALTH": r"""
SELECT event_id, user_id AS check_id,
       CASE WHEN event_id % 3 = 0 THEN 'wss://h/websocket' ELSE 'https://h/web/health' END AS url,
       CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS http_status,
       CASE WHEN event_id % 7 = 0 THEN 'text/html' ELSE 'application/json; charset=utf-8' END AS content_type,
       CASE WHEN event_id % 11 = 0 THEN '{"status": "warn"}' WHEN event_id % 13 = 0 THEN 'oops' ELSE '{"status": "pass"}' END AS body
FROM events
""",
    # VAR=VAL lines
    "FX_OPTIONS": r"""
SELECT c_custkey AS line_no,
       CASE c_custkey % 6 WHEN 0 THEN '# comment' WHEN 1 THEN concat('BAD-KEY=', CAST(c_custkey AS STRING)) WHEN 2 THEN 'K='
            ELSE concat('VAR_', CAST(c_custkey AS STRING), '=', c_mktsegment) END AS line
FROM customer
""",
    # rows for delete-by-subquery (null model and null name kept on purpose)
    "FX_ATTACHMENTS": r"""
SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'ir.ui.view' WHEN 1 THEN 'res.partner' WHEN 2 THEN 'ir.ui.view' ELSE CAST(NULL AS STRING) END AS res_model,
       CASE doc_id % 6 WHEN 0 THEN 'web.assets_common' WHEN 1 THEN 'assets' WHEN 2 THEN 'web.assetsX' WHEN 3 THEN CAST(NULL AS STRING) ELSE concat('doc_', lang) END AS name
FROM documents
""",
    # settings rows pointing at a site with an optional key
    "FX_SITES": r"""
SELECT c_custkey AS config_id, c_nationkey AS website_id, c_custkey % 3 = 0 AS enabled,
       CASE WHEN c_nationkey % 4 = 0 THEN '' WHEN c_nationkey % 4 = 1 THEN CAST(NULL AS STRING) ELSE concat('GTM-', CAST(c_nationkey AS STRING)) END AS container_key
FROM customer
""",
    # requested addons per repository (comma list; blank repo or list = skipped entry)
    "FX_EXTRAS": r"""
SELECT s_suppkey AS entry_id, CASE WHEN s_suppkey % 9 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN concat('https://git.example/r', CAST(s_suppkey AS STRING)) ELSE concat('git.example/r', CAST(s_suppkey AS STRING)) END AS repo,
       CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE concat('addon_', CAST(s_suppkey AS STRING), ',addon_', CAST(s_suppkey + 3 AS STRING)) END AS addons
FROM supplier
""",
    # addons that exist in each repository
    "FX_AVAILABLE": r"""
SELECT s_suppkey AS entry_id, concat('addon_', CAST(s_suppkey AS STRING)) AS addon FROM supplier
UNION ALL SELECT s_suppkey, concat('addon_', CAST(s_suppkey + 3 AS STRING)) FROM supplier WHERE s_suppkey % 3 <> 0
""",
    # build stamp against recorded stamp
    "FX_GATES": r"""
SELECT o_orderkey AS artifact_id,
       CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '12a' ELSE CAST(1000 + o_orderkey % 13 AS STRING) END AS build_stamp,
       CASE o_orderkey % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'x9' ELSE CAST(1000 + o_orderkey % 11 AS STRING) END AS recorded_stamp
FROM orders
""",
    # file paths for hygiene filtering
    "FX_PATHS": r"""
SELECT page_id, concat('/r', CASE page_id % 5 WHEN 0 THEN '/.git/config' WHEN 1 THEN '/a/.gitignore' WHEN 2 THEN '/.github/w.yml' WHEN 3 THEN '/a.git/b.py' ELSE '/a/b.py' END) AS path FROM pages
""",
    # language lists
    "FX_LANGS": r"""
SELECT n_nationkey AS list_id, concat('en_', substring(n_name, 1, 2), ',fr,de_', substring(n_name, 1, 2), ',zh_Hant_', substring(n_name, 2, 2)) AS langs FROM nation
""",
    # raw flag texts
    "FX_FLAGS": r"""
SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'yes' WHEN 4 THEN 'off' WHEN 5 THEN ' No ' WHEN 6 THEN '' WHEN 7 THEN CAST(NULL AS STRING) ELSE 'other' END AS flag FROM customer
""",
    # settings by layer, one value per host, key and layer (rank 0 wins)
    "FX_LAYERS": r"""
SELECT c_custkey AS host_id, l.layer_rank, 'db_host' AS name,
       CASE WHEN (c_custkey + l.layer_rank) % 4 = 0 THEN '' WHEN (c_custkey + l.layer_rank) % 4 = 1 THEN CAST(NULL AS STRING) ELSE concat('v', CAST(l.layer_rank AS STRING), '_', CAST(c_custkey % 2 AS STRING)) END AS value
FROM customer CROSS JOIN (SELECT 0 AS layer_rank UNION ALL SELECT 1 UNION ALL SELECT 2) l
""",
    # fields present per record; required are k0 … k6
    "FX_FIELDS": r"""
SELECT DISTINCT o_custkey AS record_id, concat('k', CAST(o_orderkey % 7 AS STRING)) AS field FROM orders
""",
    # JSON-RPC responses
    "FX_RPC": r"""
SELECT event_id, CASE WHEN event_id % 6 = 5 THEN 'text/html' ELSE 'application/json' END AS content_type,
       CASE event_id % 6 WHEN 0 THEN '{"jsonrpc": "2.0", "result": {"request_id": 1, "token": "t"}}' WHEN 1 THEN '{"result": {"error": "bad contract"}}' WHEN 2 THEN '{"error": {"data": {"message": "boom"}}}' WHEN 3 THEN '{"error": {}}' WHEN 4 THEN '' ELSE '<html></html>' END AS body
FROM events
""",
}
# fmt: on

# Spark multiplies the rows in place instead of joining three rows to the table.
_THREE_LAYERS = (
    "CROSS JOIN (SELECT 0 AS layer_rank UNION ALL SELECT 1 UNION ALL SELECT 2) l",
    "LATERAL VIEW explode(array(0, 1, 2)) l AS layer_rank",
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input over the tables of `sf_dir`."""
    if name == "FX_CONFIG_LINES":
        return _config_lines(spark, sf_dir)
    return run_sql(spark, sf_dir, SQL[name])


def run_sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Run a query over the tables and the named inputs."""
    full = oracle(text, *names).replace(*_THREE_LAYERS)
    for table in TABLES:
        if re.search(rf"\b(FROM|JOIN) {table}\b", full):
            load(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(full)


def oracle(text: str, *names: str) -> str:
    """The query with the named inputs in front, as one SQL text."""
    if not names:
        return text
    parts = ",\n".join(f"{n.lower()} AS ({SQL[n].strip()})" for n in names)
    head = "WITH RECURSIVE" if "RECURSIVE" in text else "WITH"
    body = text.replace("WITH RECURSIVE", "WITH", 1)
    if body.lstrip().startswith("WITH"):
        return f"{head} {parts},\n{body.lstrip()[4:]}"
    return f"{head} {parts}\n{body}"


def _config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX_CONFIG_LINES with the line numbers counted in blocks: a nation holds a twenty-fifth of
    all customers, too much for one window."""
    customers = load(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("file_id"),
        "c_custkey",
        "c_mktsegment",
        row_block("c_custkey").alias("_block"),
    )
    numbered = ordinal(customers, ["file_id"], "_block", ["c_custkey"], "line_no").drop("_block")
    line = SQL["FX_CONFIG_LINES"].split("FROM (")[0]
    numbered.createOrReplaceTempView("fx_config_numbered")
    return spark.sql(f"{line} FROM fx_config_numbered")
