"""The same results in plain SQL, for DuckDB over the same tables."""

from __future__ import annotations

from fleetwright.plans.fixtures import SNAPSHOT_TABLES, oracle

_PARSED = r"""
stripped AS (
    SELECT file_id, line_no, line, trim(line, E' \t\n\r') AS s FROM fx_config_lines),
kinds AS (
    SELECT *, CASE WHEN starts_with(s, '[') THEN 'header' WHEN s = '' THEN 'blank'
                   WHEN s[1] IN (';', '#') THEN 'comment' WHEN contains(line, '=') THEN 'option'
                   ELSE 'text' END AS kind
    FROM stripped),
parsed AS (
    SELECT file_id, line_no, line, kind,
           last_value(CASE WHEN kind = 'header' THEN lower(s) END IGNORE NULLS) OVER w AS header,
           last_value(CASE WHEN kind = 'header' THEN line_no END IGNORE NULLS) OVER w AS header_no,
           CASE WHEN kind = 'option' THEN trim(line[1:instr(line, '=') - 1]) END AS key,
           CASE WHEN kind = 'option' THEN trim(line[instr(line, '=') + 1:]) END AS value
    FROM kinds
    WINDOW w AS (PARTITION BY file_id ORDER BY line_no))
"""

_DIFF = """
diff AS (
    SELECT coalesce(s.grp, t.grp) AS grp, coalesce(s.file_key, t.file_key) AS file_key,
           s.content_hash AS src, t.content_hash AS tgt,
           CASE WHEN t.grp IS NULL THEN 'source_only' WHEN s.grp IS NULL THEN 'target_only'
                WHEN s.content_hash = t.content_hash THEN 'same' ELSE 'changed' END AS status
    FROM fx_snap_source s FULL JOIN fx_snap_target t USING (grp, file_key)),
actions AS (
    SELECT grp, CASE WHEN NOT bool_or(status <> 'source_only') THEN 'added'
                     WHEN NOT bool_or(status <> 'target_only') THEN 'target_only'
                     WHEN bool_and(status = 'same') THEN 'same' ELSE 'changed' END AS action
    FROM diff GROUP BY grp)
"""

_TREES = """
s_dirs AS (SELECT DISTINCT grp, file_key, array_to_string(p[1:i], '/') AS folder
           FROM (SELECT grp, file_key, string_split(file_key, '/') AS p, unnest(range(1, len(string_split(file_key, '/')))) AS i
                 FROM fx_tree_source)),
t_dirs AS (SELECT DISTINCT grp, file_key, array_to_string(p[1:i], '/') AS folder
           FROM (SELECT grp, file_key, string_split(file_key, '/') AS p, unnest(range(1, len(string_split(file_key, '/')))) AS i
                 FROM fx_tree_target)),
s_blocked AS (SELECT s.grp, s.file_key FROM fx_tree_source s JOIN t_dirs t ON t.grp = s.grp AND t.folder = s.file_key
              UNION SELECT s.grp, s.file_key FROM s_dirs s JOIN fx_tree_target t ON t.grp = s.grp AND t.file_key = s.folder),
t_blocked AS (SELECT t.grp, t.file_key FROM fx_tree_target t JOIN s_dirs s ON s.grp = t.grp AND s.folder = t.file_key
              UNION SELECT t.grp, t.file_key FROM t_dirs t JOIN fx_tree_source s ON s.grp = t.grp AND s.file_key = t.folder),
tree AS (
    SELECT grp, file_key, s.content_hash AS src, t.content_hash AS tgt,
           CASE WHEN (grp, file_key) IN (SELECT (grp, file_key) FROM s_blocked UNION ALL SELECT (grp, file_key) FROM t_blocked)
                THEN 'changed'
                WHEN t.content_hash IS NULL THEN 'source_only' WHEN s.content_hash IS NULL THEN 'target_only'
                WHEN s.content_hash = t.content_hash THEN 'same' ELSE 'changed' END AS status
    FROM fx_tree_source s FULL JOIN fx_tree_target t USING (grp, file_key)),
contents AS (
    SELECT 's' AS side, grp, folder, list((f.file_key, f.content_hash) ORDER BY f.file_key) AS held
    FROM (SELECT * FROM s_dirs UNION ALL SELECT grp, file_key, '' FROM fx_tree_source) d JOIN fx_tree_source f USING (grp, file_key)
    GROUP BY grp, folder
    UNION ALL
    SELECT 't', grp, folder, list((f.file_key, f.content_hash) ORDER BY f.file_key)
    FROM (SELECT * FROM t_dirs UNION ALL SELECT grp, file_key, '' FROM fx_tree_target) d JOIN fx_tree_target f USING (grp, file_key)
    GROUP BY grp, folder)
"""

_ARCHIVES = r"""
parsed AS (
    SELECT file_id, filename, mtime_s, string_split(replace(filename, '.tar.gz', ''), '_') AS p
    FROM fx_archives),
named AS (
    SELECT file_id, filename, mtime_s, len(p) >= 3 AS valid,
           CASE WHEN len(p) >= 3 THEN array_to_string(p[1:len(p) - 2], '_') END AS db,
           CASE WHEN len(p) >= 3 THEN p[len(p) - 1] END AS version,
           CASE WHEN len(p) >= 3 THEN p[len(p)] END AS stamp
    FROM parsed)
"""

_PROBES = r"""
verdicts AS (
    SELECT event_id, check_id,
           CASE WHEN regexp_matches(url, '^https?://') THEN 'web'
                WHEN regexp_matches(url, '^wss?://') THEN 'websocket' END AS kind,
           CASE WHEN http_status >= 400 THEN 'error'
                WHEN regexp_matches(url, '^wss?://') THEN 'healthy'
                WHEN NOT contains(content_type, 'application/json') THEN 'not_json'
                WHEN NOT json_valid(body) THEN 'error'
                WHEN json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.status') = 'pass'
                THEN 'healthy' ELSE 'not_pass' END AS verdict
    FROM fx_health)
"""

_OUTCOMES = """
outcomes AS (
    SELECT run_id, module, bool_or(ok) AS ok,
           coalesce(min(attempt) FILTER (WHERE ok), max(attempt)) AS attempts_used
    FROM fx_attempts WHERE attempt <= 3 GROUP BY run_id, module)
"""

_LEASES = """
    WITH RECURSIVE ops AS (
        SELECT *, row_number() OVER (PARTITION BY lock_name ORDER BY ts, event_id) AS rn
        FROM fx_leases),
    walk AS (
        SELECT lock_name, event_id, op, ts, rn, op = 'acquire' AS granted,
               CASE WHEN op = 'acquire' THEN ts + INTERVAL 3600 SECOND END AS expires_at
        FROM ops WHERE rn = 1
        UNION ALL
        SELECT o.lock_name, o.event_id, o.op, o.ts, o.rn,
               o.op = 'acquire' AND (w.expires_at IS NULL OR w.expires_at <= o.ts),
               CASE WHEN o.op = 'release' THEN NULL
                    WHEN w.expires_at IS NULL OR w.expires_at <= o.ts THEN o.ts + INTERVAL 3600 SECOND
                    ELSE w.expires_at END
        FROM walk w JOIN ops o ON o.lock_name = w.lock_name AND o.rn = w.rn + 1)
    SELECT lock_name, event_id, op, ts, granted, expires_at FROM walk"""

_LATEST_REQUEST = """
    SELECT request_id, coalesce(arg_min(state, (ts, event_id)) FILTER (state IN ('done', 'failed', 'cancelled')),
                                arg_max(state, (ts, event_id))) AS state,
           coalesce(min(ts) FILTER (state IN ('done', 'failed', 'cancelled')), max(ts)) AS since,
           bool_or(state IN ('done', 'failed', 'cancelled')) AS terminal
    FROM fx_lifecycle GROUP BY request_id"""

_LOG_LINES = r"""
pieces AS (
    SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS piece
    FROM conversations),
log_lines AS (
    SELECT conv_id, turn, piece, line, strlen(line) + 1 AS size,
           coalesce(sum(strlen(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn, piece
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
    FROM pieces)
"""

# The rest of a line cut inside a character starts with one replacement character per left byte.
_LOG_TAIL = (
    "WITH "
    + _LOG_LINES
    + r""",
cut AS (
    SELECT conv_id, line, begins, 333 - begins AS skip,
           coalesce(list_min(list_filter(range(1, length(line) + 1),
               lambda i: strlen(line[1:i - 1]) >= 333 - begins)), length(line) + 1) AS pos
    FROM log_lines WHERE begins < 333 AND begins + size > 333)
SELECT conv_id, begins AS byte_start, line FROM log_lines WHERE begins >= 333
UNION ALL
SELECT conv_id, 333::BIGINT AS byte_start,
       repeat(chr(65533), (strlen(line[1:pos - 1]) - skip)::BIGINT) || line[pos:] AS line
FROM cut"""
)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # sources
    q["scan_module_manifests"] = oracle(
        """SELECT concat('m', p_partkey) AS name,
           coalesce((SELECT string_agg(concat('m', dep), ',' ORDER BY dep) FROM fx_deps d
                     WHERE d.module = p.p_partkey), '') AS depends FROM part p""",
        "FX_DEPS",
    )
    q["scan_config_files"] = oracle(
        """SELECT file_id, (line_no - 1) // 65536 AS part_no, (line_no - 1) % 65536 + 1 AS line_no,
           line FROM fx_config_lines""",
        "FX_CONFIG_LINES",
    )
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in SNAPSHOT_TABLES)
    q["export_snapshot"] = counts
    q["import_snapshot"] = f"SELECT *, true AS verified FROM ({counts})"
    q["import_snapshot_replace"] = (
        f"SELECT *, true AS verified, {len(SNAPSHOT_TABLES)} AS tables_now FROM ({counts})"
    )
    q["scan_file_inventory"] = """
        SELECT concat('g', doc_id % 50) AS grp, concat('d', doc_id, '.txt') AS file_key,
               strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS content_hash FROM documents"""
    q["log_tail_from_offset"] = _LOG_TAIL
    q["log_tail_files"] = q["log_tail_stream"] = (
        "WITH " + _LOG_LINES + " SELECT conv_id, begins AS byte_start, line FROM log_lines"
    )

    # rules on single rows
    q["blocklist_filter"] = oracle(
        """SELECT path_rank, seq, name FROM fx_catalog
           WHERE NOT regexp_matches(name, '^red_.*') AND NOT regexp_matches(name, '_1[0-5]$')
             AND NOT regexp_matches(name, 'us_4')""",
        "FX_CATALOG",
    )
    q["blocklist_by_table"] = oracle(
        """WITH bad AS (SELECT DISTINCT m.name FROM (SELECT DISTINCT name FROM fx_catalog) m
                       JOIN fx_patterns p ON regexp_matches(m.name, ltrim(p.pattern, '*')))
           SELECT path_rank, seq, name FROM fx_catalog WHERE name NOT IN (SELECT name FROM bad)""",
        "FX_CATALOG",
        "FX_PATTERNS",
    )
    q["locale_module_filter"] = oracle(
        """SELECT path_rank, seq, name FROM fx_catalog
           WHERE NOT contains(name, 'l10n')
              OR list_has_any(list_filter(string_split(name, '_'),
                     lambda p: regexp_full_match(p, '[a-z]{2}')), ['au', 'us'])""",
        "FX_CATALOG",
    )
    q["path_hygiene_filter"] = oracle(
        r"""SELECT page_id, path FROM fx_paths
            WHERE NOT regexp_matches(path, '(^|/)\.git/')
              AND NOT regexp_matches(path, '(^|/)\.[^/]*$')""",
        "FX_PATHS",
    )
    q["validate_options"] = oracle(
        r"""SELECT line_no, CASE WHEN ok THEN string_split(line, '=')[1] END AS var,
                   CASE WHEN ok THEN string_split(line, '=')[2] END AS val,
                   CASE WHEN NOT ok THEN line END AS bad
            FROM (SELECT line_no, trim(line) AS line, regexp_full_match(trim(line), '\w+=\w+') AS ok
                  FROM fx_options WHERE NOT starts_with(line, '#'))""",
        "FX_OPTIONS",
    )
    q["classify_request"] = oracle(
        r"""SELECT page_id, class,
                   CASE WHEN class NOT IN ('static', 'app') THEN 404 END AS status
            FROM (SELECT page_id, CASE
                WHEN regexp_matches(path, '\.(php|asp|aspx|jsp|cgi)$', 'i') THEN 'attack_extension'
                WHEN regexp_matches(path, '/(wp-admin|wp-login\.php|wp-content|wp-includes|xmlrpc\.php)', 'i')
                THEN 'attack_path'
                WHEN starts_with(path, '/.well-known/') THEN 'well_known'
                WHEN regexp_matches(path, '^/[^/]+/static/.+$') THEN 'static'
                WHEN starts_with(path, '/web/filestore') THEN 'internal' ELSE 'app' END AS class
                FROM fx_requests)""",
        "FX_REQUESTS",
    )
    q["forwarded_headers"] = oracle(
        """SELECT page_id, CASE WHEN x_forwarded_proto = '' THEN 'http' ELSE x_forwarded_proto END AS proto,
                  CASE WHEN page_id % 2 = 0 THEN '8443' ELSE '80' END AS port,
                  CASE WHEN page_id % 3 = 0 THEN 'upgrade' ELSE 'close' END AS connection,
                  'off' AS ssl,
                  CASE WHEN x_forwarded_for = '' THEN remote_addr
                       ELSE trim(string_split(x_forwarded_for, ',')[1]) END AS client_ip,
                  CASE WHEN starts_with(content_type, 'image/') THEN 'default-src ''none''' ELSE '' END AS csp
           FROM fx_requests""",
        "FX_REQUESTS",
    )
    q["rewrite_insecure_links"] = oracle(
        """SELECT page_id, CASE WHEN content_type IN ('text/html', 'text/css')
                  THEN regexp_replace(body, regexp_escape(concat('http://', host)),
                                      concat('https://', host), 'gi') ELSE body END AS body
           FROM fx_requests""",
        "FX_REQUESTS",
    )
    q["classify_health_probe"] = oracle(
        "WITH " + _PROBES + " SELECT event_id, kind, verdict FROM verdicts", "FX_HEALTH"
    )
    q["classify_dump_file"] = oracle(
        """WITH files AS (""" + DUMP_FILES + """)
           SELECT file_id, CASE WHEN ext IS NOT NULL AND suffix THEN path[1:length(path) - length(ext)]
                                WHEN ext IS NOT NULL THEN path END AS base, ext,
                  CASE WHEN ext IS NULL THEN false WHEN is_dir THEN has_toc
                       WHEN ext = '.zip' THEN coalesce(has_sql_member, true)
                       WHEN ext = '.sql.gz' THEN starts_with(hex(head), '1F8B') OR hex(head) = '' ELSE true END AS valid
           FROM (SELECT *, CASE WHEN suffix THEN regexp_extract(path, '\\.(sql|dump|zip|sql\\.gz)$')
                                WHEN is_dir THEN '.dump' END AS ext
                 FROM (SELECT *, regexp_matches(path, '\\.(sql|dump|zip|sql\\.gz)$') AS suffix FROM files))""",
        "FX_ARCHIVES",
    )
    q["parse_archive_name"] = oracle(
        "WITH " + _ARCHIVES + " SELECT file_id, db, version, stamp, valid FROM named",
        "FX_ARCHIVES",
    )
    q["refresh_gate"] = oracle(
        """SELECT artifact_id, reason, starts_with(reason, 'record') AS needed
           FROM (SELECT artifact_id, CASE WHEN build_stamp = '' THEN 'build_missing'
                   WHEN NOT regexp_full_match(build_stamp, '[0-9]+') THEN 'build_invalid'
                   WHEN recorded_stamp IS NULL THEN 'record_missing'
                   WHEN NOT regexp_full_match(recorded_stamp, '[0-9]+') THEN 'record_invalid'
                   WHEN try_cast(recorded_stamp AS BIGINT) < try_cast(build_stamp AS BIGINT)
                   THEN 'record_older' ELSE 'up_to_date' END AS reason FROM fx_gates)""",
        "FX_GATES",
    )
    q["render_template"] = """
        SELECT n_nationkey, concat('server ', n_name, ':', n_regionkey, '; # ', n_name) AS text,
               CASE WHEN n_regionkey <> 0 THEN concat('<tag id="', n_name, '"/>') ELSE '' END AS snippet
        FROM nation"""
    q["truthy_flag"] = oracle(
        """SELECT id, coalesce(lower(flag) IN ('true', '1', 'yes'), false) AS any_true,
                  coalesce(lower(flag) = 'true', false) AS only_true,
                  coalesce(flag = 'true', false) AS exact_true,
                  coalesce(lower(trim(flag)) NOT IN ('0', 'off', 'no'), true) AS not_off,
                  coalesce(flag <> '', false) AS non_blank FROM fx_flags""",
        "FX_FLAGS",
    )
    q["rpc_response_extract"] = oracle(
        """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'result' WHEN 4 THEN 'empty' WHEN 5 THEN 'html'
                            ELSE 'error' END AS outcome,
                  CASE event_id % 6 WHEN 1 THEN json_extract_string(body, '$.result.error')
                       WHEN 2 THEN concat('Error: ', json_extract_string(body, '$.error.data.message'))
                       WHEN 3 THEN 'Error: Upgrade server bad JSONRPC response' END AS message,
                  CASE event_id % 6 WHEN 0 THEN json_extract(body, '$.result')::VARCHAR
                       WHEN 5 THEN body END AS result
           FROM fx_rpc""",
        "FX_RPC",
    )

    # lookups
    snaps = ("FX_SNAP_SOURCE", "FX_SNAP_TARGET")
    q["snapshot_diff"] = oracle("WITH " + _DIFF + " SELECT grp, file_key, status FROM diff", *snaps)
    q["group_change_rollup"] = oracle("WITH " + _DIFF + " SELECT grp, action FROM actions", *snaps)
    q["upsert_groups"] = oracle(
        "WITH "
        + _DIFF
        + """ SELECT s.grp, s.file_key, s.content_hash FROM fx_snap_source s JOIN actions a USING (grp)
              WHERE a.action IN ('added', 'changed')
              UNION ALL SELECT t.grp, t.file_key, t.content_hash FROM fx_snap_target t
              JOIN actions a USING (grp) WHERE a.action IN ('same', 'target_only')""",
        *snaps,
    )
    q["overlay_merge"] = oracle(
        "WITH " + _DIFF + " SELECT grp, file_key, coalesce(src, tgt) AS content_hash FROM diff", *snaps
    )
    folders = ("FX_TREE_SOURCE", "FX_TREE_TARGET")
    q["tree_diff"] = oracle("WITH " + _TREES + " SELECT grp, file_key, status FROM tree", *folders)
    q["tree_changes"] = oracle("WITH " + _TREES + " SELECT grp, file_key, status FROM tree WHERE status <> 'same'", *folders)
    q["differing_folders"] = oracle(
        "WITH "
        + _TREES
        + """ SELECT grp, folder, CASE WHEN t.held IS NULL THEN 'source_only' WHEN s.held IS NULL THEN 'target_only'
                                       ELSE 'changed' END AS status
              FROM (SELECT * FROM contents WHERE side = 's') s
              FULL JOIN (SELECT * FROM contents WHERE side = 't') t USING (grp, folder)
              WHERE s.held IS DISTINCT FROM t.held""",
        *folders,
    )
    q["tree_merge"] = oracle(
        "WITH "
        + _TREES
        + """ SELECT grp, file_key, coalesce(src, tgt) AS content_hash FROM tree
              WHERE (grp, file_key) NOT IN (SELECT (grp, file_key) FROM t_blocked)""",
        *folders,
    )
    q["mandatory_append"] = oracle(
        """WITH base AS (SELECT name, path_rank * 1000000 + seq AS ord FROM fx_catalog
                         UNION ALL SELECT 'base', -1),
           top AS (SELECT max(ord) AS m FROM base)
           SELECT name, ord FROM base UNION ALL SELECT 'web', m + 1 FROM top""",
        "FX_CATALOG",
    )
    q["missing_requirements"] = oracle(
        """SELECT record_id, coalesce(array_to_string(list_filter(
               ['k0', 'k1', 'k2', 'k3', 'k4', 'k5', 'k6'],
               lambda k: NOT list_contains(list(field), k)
                     AND NOT (k = 'k6' AND record_id % 5 = 0)), ','), '') AS missing
           FROM fx_fields GROUP BY record_id""",
        "FX_FIELDS",
    )
    q["select_extras"] = oracle(
        """WITH wanted AS (
               SELECT entry_id, CASE WHEN starts_with(repo, 'https://') THEN repo
                                     ELSE concat('https://', repo) END AS url,
                      unnest(string_split(addons, ',')) AS addon
               FROM fx_extras WHERE repo <> '' AND addons <> '')
           SELECT w.entry_id, w.url, w.addon,
                  CASE WHEN a.addon IS NULL THEN 'missing' ELSE 'selected' END AS status
           FROM wanted w LEFT JOIN (SELECT DISTINCT * FROM fx_available) a USING (entry_id, addon)
           UNION ALL SELECT entry_id, NULL, NULL, 'skipped' FROM fx_extras
           WHERE repo = '' OR addons = ''""",
        "FX_EXTRAS",
        "FX_AVAILABLE",
    )
    q["delete_by_subquery"] = oracle(
        """SELECT id, res_model, name FROM fx_attachments WHERE id NOT IN (
               SELECT id FROM fx_attachments WHERE res_model = 'ir.ui.view' AND name LIKE '%assets_%')""",
        "FX_ATTACHMENTS",
    )
    q["overlay_lookup"] = oracle(
        """SELECT p.p_partkey AS request_id, w.path,
                  coalesce(['extras', 'enterprise', 'community'][l.r + 1], 'backend') AS layer
           FROM part p, LATERAL (SELECT concat(replace(p.p_name, ' ', '_'), '_',
               CAST(p.p_size AS VARCHAR), CASE WHEN p.p_partkey % 7 = 0 THEN 'x' ELSE '' END) AS path) w
           LEFT JOIN (SELECT name, min(path_rank) AS r FROM fx_catalog GROUP BY name) l
             ON l.name = w.path""",
        "FX_CATALOG",
    )
    q["checksum_verify"] = oracle(
        """SELECT doc_id, CASE WHEN NOT has_sidecar THEN 'no_sidecar' WHEN tampered THEN 'mismatch'
                               ELSE 'ok' END AS status FROM fx_sidecar""",
        "FX_SIDECAR",
    )
    q["wait_until_ready"] = oracle(
        """WITH spans AS (
               SELECT target, epoch_us(ts) AS a,
                      epoch_us(lead(ts) OVER (PARTITION BY target ORDER BY ts)) AS b, up
               FROM fx_readiness),
           hits AS (
               SELECT w.event_id, min(greatest(0, ceil((s.a - epoch_us(w.ts)) / 600000000.0)))::BIGINT AS k
               FROM fx_readiness w JOIN spans s ON s.target = w.target AND s.up
                AND coalesce(s.b, 9000000000000000) > epoch_us(w.ts)
                AND s.a < epoch_us(w.ts) + 6000000000
               WHERE w.is_waiter
                AND epoch_us(w.ts) + greatest(0, ceil((s.a - epoch_us(w.ts)) / 600000000.0)) * 600000000
                    < coalesce(s.b, 9000000000000000)
                AND greatest(0, ceil((s.a - epoch_us(w.ts)) / 600000000.0)) < 10
               GROUP BY w.event_id)
           SELECT w.event_id AS waiter_id, coalesce(h.k + 1, 10)::BIGINT AS attempts,
                  w.ts + to_microseconds(h.k * 600000000) AS ready_ts,
                  CASE WHEN h.k IS NULL THEN 'timeout' ELSE 'ready' END AS outcome
           FROM fx_readiness w LEFT JOIN hits h USING (event_id) WHERE w.is_waiter""",
        "FX_READINESS",
    )
    q["related_setting_join"] = oracle(
        """SELECT config_id, coalesce(container_key, '') AS key, coalesce(container_key, '') <> '' AS has_key,
                  CASE WHEN enabled THEN container_key END AS new_key,
                  NOT enabled OR coalesce(container_key, '') <> '' AS valid
           FROM fx_sites""",
        "FX_SITES",
    )
    q["layered_settings"] = oracle(
        """SELECT host_id, name, arg_min(value, layer_rank) FILTER (WHERE value <> '') AS value,
                  min(layer_rank) FILTER (WHERE value <> '') AS layer,
                  count(DISTINCT value) FILTER (WHERE value <> '') > 1 AS conflict
           FROM fx_layers GROUP BY host_id, name""",
        "FX_LAYERS",
    )
    q["paired_connection"] = oracle(
        """SELECT host_id, coalesce(CASE WHEN pooled THEN pooler_host ELSE nullif(db_host, '') END, 'postgres') AS use_host,
                  coalesce(CASE WHEN pooled THEN pooler_port ELSE db_port END, '5432') AS use_port,
                  coalesce(CASE WHEN pooled THEN pooler_mode ELSE db_mode END, 'disable') AS use_mode
           FROM (SELECT *, coalesce(pooler_host <> '', false) AS pooled FROM ("""
        + CONNECTIONS
        + "))",
        "FX_LAYERS",
    )

    # aggregates
    q["locale_codes"] = oracle(
        """SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY first_at) AS ord, code
           FROM (SELECT list_id, code, min(i) AS first_at
                 FROM (SELECT list_id, lower(item[instr(item, '_') + 1:]) AS code, i
                       FROM (SELECT list_id, unnest(string_split(langs, ',')) AS item,
                                    generate_subscripts(string_split(langs, ','), 1) AS i FROM fx_langs)
                       WHERE contains(item, '_')) GROUP BY list_id, code)""",
        "FX_LANGS",
    )
    q["ordered_list_agg"] = oracle(
        """SELECT n // 10000 AS chunk_no, string_agg(name, ',' ORDER BY n) AS names
           FROM (SELECT name, row_number() OVER (ORDER BY path_rank, seq) - 1 AS n FROM fx_catalog)
           GROUP BY chunk_no""",
        "FX_CATALOG",
    )
    q["record_fingerprint"] = """
        SELECT o_orderkey, concat('dump_', sha256(concat(o_orderkey, chr(30), o_custkey, chr(30),
               o_orderstatus, chr(30), o_orderpriority, chr(30)))) AS fingerprint FROM orders"""
    q["retry_outcome"] = oracle(
        "WITH " + _OUTCOMES + " SELECT run_id, module, ok, attempts_used FROM outcomes", "FX_ATTEMPTS"
    )
    q["run_verdict"] = oracle(
        "WITH "
        + _OUTCOMES
        + """, verdicts AS (
               SELECT run_id, CASE WHEN bool_and(ok) THEN 'success' WHEN NOT bool_or(ok) THEN 'fatal'
                                   ELSE 'partial' END AS verdict,
                      count(*) FILTER (WHERE NOT ok) AS failed_count, bool_or(ok) AS stamp
               FROM outcomes GROUP BY run_id),
             lists AS (
               SELECT run_id, n // 10000 AS chunk_no, string_agg(module::VARCHAR, ',' ORDER BY n) AS failed
               FROM (SELECT run_id, module, row_number() OVER (PARTITION BY run_id ORDER BY module) - 1 AS n
                     FROM outcomes WHERE NOT ok) GROUP BY ALL)
             SELECT run_id, verdict, failed_count, stamp, coalesce(chunk_no, 0)::BIGINT AS chunk_no,
                    coalesce(failed, '') AS failed
             FROM verdicts LEFT JOIN lists USING (run_id)""",
        "FX_ATTEMPTS",
    )
    q["health_rollup"] = oracle(
        "WITH "
        + _PROBES
        + """, rolled AS (
               SELECT check_id, arg_max(verdict, event_id) FILTER (WHERE kind = 'web') AS web,
                      arg_max(verdict, event_id) FILTER (WHERE kind = 'websocket') AS ws
               FROM verdicts GROUP BY check_id)
             SELECT check_id, web, ws, CASE WHEN web IS NULL AND ws IS NULL THEN 'error'
                    WHEN coalesce(web, 'healthy') = 'healthy' AND coalesce(ws, 'healthy') = 'healthy'
                    THEN 'pass' ELSE 'fail' END AS overall FROM rolled""",
        "FX_HEALTH",
    )

    # order and choice
    q["first_wins_dedup"] = oracle(
        """SELECT name, path_rank, seq, row_number() OVER (ORDER BY path_rank, seq) AS ord
           FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path_rank, seq) AS rn
                 FROM fx_catalog) WHERE rn = 1""",
        "FX_CATALOG",
    )
    q["search_roots"] = oracle(
        """WITH roots AS (
               SELECT false AS fourth, name, path_rank, seq FROM fx_catalog
               UNION ALL SELECT true, name, path_rank, seq FROM fx_catalog
               UNION ALL SELECT true, concat('own_', s_suppkey % 97), 3, s_suppkey FROM supplier),
           firsts AS (SELECT *, row_number() OVER (PARTITION BY fourth, name ORDER BY path_rank, seq) AS rn FROM roots)
           SELECT fourth, name, path_rank, seq, row_number() OVER (PARTITION BY fourth ORDER BY path_rank, seq) AS ord
           FROM firsts WHERE rn = 1""",
        "FX_CATALOG",
    )
    q["latest_archive"] = oracle(
        "WITH "
        + _ARCHIVES
        + """ SELECT db, version, arg_max(filename, (mtime_s, filename)) AS filename, max(mtime_s) AS mtime_s
              FROM named WHERE valid GROUP BY db, version""",
        "FX_ARCHIVES",
    )
    q["latest_archive_by_version"] = oracle(
        "WITH "
        + _ARCHIVES
        + """ SELECT version, arg_max(filename, (mtime_s, filename)) AS filename, max(mtime_s) AS mtime_s
              FROM named WHERE valid GROUP BY version""",
        "FX_ARCHIVES",
    )
    q["lifecycle_audit"] = oracle(
        """SELECT request_id, ts, event_id, from_state, to_state,
                  CASE WHEN from_state IS NULL
                       THEN to_state IN ('init', 'new', 'pending', 'progress', 'done', 'failed', 'cancelled')
                       ELSE (from_state, to_state) IN (('init', 'new'), ('new', 'pending'), ('pending', 'progress'),
                            ('progress', 'done'), ('progress', 'failed'), ('progress', 'cancelled')) END AS valid
           FROM (SELECT request_id, ts, event_id, state AS to_state,
                        lag(state) OVER (PARTITION BY request_id ORDER BY ts, event_id) AS from_state
                 FROM fx_lifecycle)""",
        "FX_LIFECYCLE",
    )

    # chains
    q["install_list"] = oracle(
        """WITH RECURSIVE chosen AS (
               SELECT name, row_number() OVER (ORDER BY path_rank, seq) AS ord
               FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path_rank, seq) AS rn FROM fx_catalog
                     WHERE NOT regexp_matches(name, '^red_.*|_1[0-5]$|us_4')
                       AND (NOT contains(name, 'l10n')
                            OR list_has_any(list_filter(string_split(name, '_'),
                                   lambda p: regexp_full_match(p, '[a-z]{2}')), ['au', 'us'])))
               WHERE rn = 1),
           edges AS (
               SELECT module, dep FROM (""" + NAMED_DEPS + """)
               WHERE module IN (SELECT name FROM chosen) AND dep IN (SELECT name FROM chosen)),
           paths AS (
               SELECT name, 0 AS level FROM chosen
               UNION SELECT e.module, p.level + 1 FROM paths p JOIN edges e ON e.dep = p.name),
           levels AS (SELECT name, max(level) AS level FROM paths GROUP BY name),
           ordered AS (
               SELECT name, row_number() OVER (ORDER BY level, ord) AS ord FROM levels JOIN chosen USING (name))
           SELECT name, ord FROM ordered
           UNION ALL SELECT 'web', count(*) + 1 FROM ordered UNION ALL SELECT 'base', count(*) + 2 FROM ordered""",
        "FX_CATALOG",
        "FX_DEPS",
    )
    q["restore_choice"] = oracle(
        "WITH "
        + _ARCHIVES
        + """ SELECT db, version, filename AS file, CASE WHEN file_id % 3 = 0 THEN 'no_sidecar'
                     WHEN file_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS status
              FROM named WHERE valid AND version = '17' ORDER BY mtime_s DESC, filename DESC LIMIT 1""",
        "FX_ARCHIVES",
    )
    q["write_upsert"] = oracle(
        """WITH s AS (SELECT grp % 100 AS grp, file_key, content_hash FROM fx_snap_source),
                t AS (SELECT grp % 100 AS grp, file_key, content_hash FROM fx_snap_target)
           SELECT * FROM s UNION ALL SELECT * FROM t WHERE grp NOT IN (SELECT grp FROM s)""",
        *snaps,
    )

    # config
    lines = "FX_CONFIG_LINES"
    q["config_parse"] = oracle(
        "WITH "
        + _PARSED
        + " SELECT file_id, line_no, line, trim(header, '[]') AS section, kind, key, value FROM parsed",
        lines,
    )
    q["config_get"] = oracle(
        "WITH "
        + _PARSED
        + """ SELECT file_id, arg_min(value, line_no) AS value FROM parsed
              WHERE kind = 'option' AND trim(header, '[]') = 'options' AND key = 'key3' GROUP BY file_id""",
        lines,
    )
    q["config_drop_commented"] = oracle(
        r"""SELECT file_id, line_no, line FROM fx_config_lines
            WHERE NOT regexp_matches(line, '^\s*[;#]\s*key5\s*=')""",
        lines,
    )
    q["config_set"] = oracle(
        "WITH "
        + _PARSED
        + r""", marked AS (
            SELECT *, coalesce(trim(header, '[]') = 'building', false) AS hit,
                   kind = 'option' AND key = 'key2' AND coalesce(trim(header, '[]') = 'building', false) AS setting
            FROM parsed),
        files AS (
            SELECT file_id, max(line_no) AS bottom, bool_or(setting) AS present,
                   min(header_no) FILTER (WHERE hit) AS first_no FROM marked GROUP BY file_id),
        ends AS (
            SELECT f.*, (SELECT max(line_no) FROM marked m
                         WHERE m.file_id = f.file_id AND m.header_no = f.first_no) AS section_end
            FROM files f),
        merged AS (
            SELECT file_id, line_no, 0 AS sub, CASE WHEN setting THEN 'key2 = fresh' ELSE line END AS line
            FROM marked WHERE NOT regexp_matches(line, '^\s*[;#]\s*key2\s*=')
            UNION ALL SELECT file_id, bottom, 1, '[Building]' FROM ends WHERE first_no IS NULL
            UNION ALL SELECT file_id, coalesce(section_end, bottom), 2, 'key2 = fresh' FROM ends WHERE NOT present)
        SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no, sub) AS line_no, line
        FROM merged""",
        lines,
    )
    defaults = (
        "WITH "
        + _PARSED
        + r""", wanted(ord, k, v) AS (VALUES (1, 'key1', 'd1'), (2, 'key3', 'v3=x'), (3, 'fresh_key', 'd9')),
        marked AS (
            SELECT p.*, w.v, w.k IS NOT NULL AND coalesce(header = '[options]', false) AS setting,
                   w.k IS NOT NULL AND coalesce(header = '[options]', false) AND p.value <> w.v AS differs
            FROM parsed p LEFT JOIN wanted w ON p.kind = 'option' AND p.key = w.k),
        files AS (
            SELECT file_id, max(line_no) AS bottom, min(line_no) AS top, bool_or(differs) AS differs,
                   min(header_no) FILTER (WHERE header = '[options]') AS first_no,
                   arg_max(header, line_no) AS last_header,
                   list(DISTINCT key) FILTER (WHERE setting) AS present FROM marked GROUP BY file_id),
        absent AS (
            SELECT f.file_id, w.ord, concat(w.k, ' = ', w.v) AS line,
                   coalesce((SELECT max(line_no) FROM marked m
                             WHERE m.file_id = f.file_id AND m.header_no = f.first_no), 0) AS place
            FROM files f, wanted w
            WHERE (f.first_no IS NULL OR f.last_header = '[options]')
              AND NOT list_contains(coalesce(f.present, []), w.k)),
        outcome AS (
            SELECT file_id, differs OR EXISTS (SELECT 1 FROM absent a WHERE a.file_id = f.file_id) AS changed, first_no
            FROM files f)
        """
    )
    q["config_apply_defaults"] = oracle(
        defaults
        + r""", merged AS (
            SELECT m.file_id, m.line_no, 0 AS sub, CASE WHEN m.differs THEN concat(m.key, ' = ', m.v) ELSE m.line END AS line
            FROM marked m JOIN outcome o USING (file_id)
            WHERE NOT o.changed OR NOT regexp_matches(m.line, '^\s*[;#]\s*(key1|key3|fresh_key)\s*=')
            UNION ALL SELECT file_id, 0, -1, '[options]' FROM outcome WHERE first_no IS NULL
            UNION ALL SELECT file_id, place, ord, line FROM absent)
        SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY line_no, sub) AS line_no, line
        FROM merged""",
        lines,
    )
    q["config_apply_defaults_report"] = oracle(
        defaults + " SELECT file_id, changed FROM outcome", lines
    )
    q["config_render"] = oracle(
        """SELECT file_id, chunk_no,
                  concat(CASE WHEN chunk_no > 0 OR bool_or(bool_or(contains(line, '[options]'))) OVER (PARTITION BY file_id)
                              THEN '' ELSE concat('[options]', chr(10)) END,
                         string_agg(line, chr(10) ORDER BY line_no), chr(10)) AS text
           FROM (SELECT *, ((line_no - 1) // 100000)::BIGINT AS chunk_no FROM fx_config_lines)
           GROUP BY file_id, chunk_no""",
        lines,
    )

    # graph
    q["dependency_order"] = oracle(
        """WITH RECURSIVE edges AS (
               SELECT module, dep FROM fx_deps WHERE dep IN (SELECT p_partkey FROM part)),
           paths AS (
               SELECT p_partkey AS module, 0 AS level FROM part
               UNION SELECT e.module, p.level + 1 FROM paths p JOIN edges e ON e.dep = p.module),
           levels AS (SELECT module, max(level)::BIGINT AS level FROM paths GROUP BY module)
           SELECT module, level, row_number() OVER (ORDER BY level, module) AS ord FROM levels""",
        "FX_DEPS",
    )
    q["cycle_members"] = oracle(
        """WITH RECURSIVE edges AS (
               SELECT module, dep FROM fx_deps UNION SELECT module, dep FROM fx_back_edges),
           reach AS (
               SELECT module, dep FROM edges
               UNION SELECT r.module, e.dep FROM reach r JOIN edges e ON e.module = r.dep)
           SELECT DISTINCT module FROM reach WHERE module = dep""",
        "FX_DEPS",
        "FX_BACK_EDGES",
    )

    # state
    q["lease_state"] = oracle(_LEASES, "FX_LEASES")
    q["lease_state_stream"] = q["lease_state_micro_batches"] = q["lease_state"]
    q["request_state"] = q["request_state_stream"] = oracle(_LATEST_REQUEST, "FX_LIFECYCLE")
    return q


# Dump files with every ending: some folders, some damaged, some without the main member.
DUMP_FILES = """
    SELECT file_id, concat(replace(filename, '.tar.gz', ''), CASE file_id % 7 WHEN 0 THEN '.sql'
               WHEN 1 THEN '.dump' WHEN 2 THEN '.zip' WHEN 3 THEN '.sql.gz' WHEN 4 THEN '.tar.gz'
               WHEN 5 THEN '' ELSE '.zip' END) AS path,
           file_id % 7 = 5 OR (file_id % 7 = 1 AND file_id % 2 = 0) AS is_dir,
           file_id % 3 = 0 AS has_toc,
           CASE WHEN file_id % 7 IN (2, 6) AND file_id % 4 <> 0 THEN unhex('504B0304')
                WHEN file_id % 7 = 3 AND file_id % 4 <> 0 THEN unhex('1F8B0800')
                WHEN file_id % 7 = 3 AND file_id % 8 = 0 THEN unhex('')
                ELSE unhex('2D2D2050') END AS head,
           CASE WHEN file_id % 7 IN (2, 6) AND file_id % 4 <> 0 THEN file_id % 5 <> 0 END AS has_sql_member
    FROM fx_archives"""

# Pooler and database settings of a host, from the layers of its settings.
CONNECTIONS = """
    SELECT host_id, max(CASE WHEN layer_rank = 0 THEN value END) AS pooler_host,
           CASE WHEN host_id % 3 = 0 THEN '6432' END AS pooler_port,
           CASE WHEN host_id % 5 = 0 THEN 'require' END AS pooler_mode,
           max(CASE WHEN layer_rank = 1 THEN value END) AS db_host,
           CASE WHEN host_id % 2 = 0 THEN '5433' END AS db_port,
           CASE WHEN host_id % 7 = 0 THEN 'prefer' END AS db_mode
    FROM fx_layers GROUP BY host_id"""

# Dependencies by name: between the first hits of both names, so that no name stands for two modules.
NAMED_DEPS = """
    WITH first_hits AS (
        SELECT c.seq, c.name FROM fx_catalog c
        JOIN (SELECT name, min(path_rank * 1000000000 + seq) AS place FROM fx_catalog GROUP BY name) m
          ON m.name = c.name AND m.place = c.path_rank * 1000000000 + c.seq)
    SELECT a.name AS module, b.name AS dep FROM fx_deps d
    JOIN first_hits a ON a.seq = d.module JOIN first_hits b ON b.seq = d.dep"""
