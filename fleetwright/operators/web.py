"""Proxied requests, health probes, RPC responses and site settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.lookup import look_up
from fleetwright.functions.text import non_blank, or_default

# Request rules in the order in which they are tried.
REQUEST_RULES = [
    ("attack_extension", r"(?i)\.(php|asp|aspx|jsp|cgi)$"),
    ("attack_path", r"(?i)/(wp-admin|wp-login\.php|wp-content|wp-includes|xmlrpc\.php)"),
    ("well_known", r"^/\.well-known/"),
    ("static", r"^/[^/]+/static/.+$"),
]
INTERNAL_PREFIX = "/web/filestore"
REFUSED = ["attack_extension", "attack_path", "well_known", "internal"]

# Content types whose links are rewritten.
REWRITTEN_TYPES = [
    "text/html",
    "text/css",
    "text/xml",
    "application/xml",
    "application/json",
    "application/javascript",
    "text/javascript",
]
IMAGE_POLICY = "default-src 'none'"

# Fixed value: the message for a response that explains nothing.
BAD_RESPONSE = "Upgrade server bad JSONRPC response"


def classify_request(df: DataFrame, path: str = "path") -> DataFrame:
    """Add class and status (404 where refused, else null).

    Patterns see the path without its query and are tried in order, before any prefix.
    """
    plain = F.substring_index(F.col(path), "?", 1)
    kind = F.when(F.startswith(plain, F.lit(INTERNAL_PREFIX)), "internal").otherwise("app")
    for name, pattern in reversed(REQUEST_RULES):
        kind = F.when(plain.rlike(pattern), name).otherwise(kind)
    return df.withColumn("class", kind).withColumn(
        "status", F.when(F.col("class").isin(*REFUSED), 404)
    )


def forwarded_headers(
    df: DataFrame,
    scheme: Column | None = None,
    server_port: Column | None = None,
    forwarded_port: Column | None = None,
    upgrade: Column | None = None,
    forwarded_proto: str = "x_forwarded_proto",
    forwarded_for: str = "x_forwarded_for",
    remote_addr: str = "remote_addr",
    content_type: str = "content_type",
) -> DataFrame:
    """Add proto, port, ssl, connection, client_ip and csp.

    Forwarded values win where they are not blank. `ssl` follows the scheme of this server
    alone. All peers are trusted, so the client is the leftmost forwarded address.
    """
    scheme = F.lit("http") if scheme is None else scheme
    server_port = F.lit("80") if server_port is None else server_port
    forwarded_port = F.lit("") if forwarded_port is None else forwarded_port
    upgrade = F.lit("") if upgrade is None else upgrade
    leftmost = F.trim(F.substring_index(F.col(forwarded_for), ",", 1))
    return df.withColumns(
        {
            "proto": or_default(forwarded_proto, scheme),
            "port": or_default(forwarded_port, server_port),
            "ssl": F.when(scheme == "https", "on").otherwise("off"),
            "connection": F.when(non_blank(upgrade).isNotNull(), "upgrade").otherwise("close"),
            "client_ip": F.coalesce(non_blank(leftmost), F.col(remote_addr)),
            "csp": F.when(F.contains(F.col(content_type), F.lit("image/")), IMAGE_POLICY).otherwise(""),
        }
    )


def rewrite_insecure_links(
    df: DataFrame, body: str = "body", host: str = "host", content_type: str = "content_type"
) -> DataFrame:
    """Turn every `http://<host>` of the text types into `https://<host>`, in any case."""
    kind = F.lower(F.trim(F.substring_index(F.col(content_type), ";", 1)))
    name = F.lower(F.col(host))
    pattern = F.concat(F.lit(r"(?i)\Qhttp://"), name, F.lit(r"\E"))
    secure = F.concat(F.lit("https://"), F.regexp_replace(name, r"([\\$])", r"\\$1"))
    rewritten = F.regexp_replace(F.col(body), pattern, secure)
    hit = kind.isin(*REWRITTEN_TYPES) & (non_blank(host).isNotNull())
    return df.withColumn(body, F.when(hit, rewritten).otherwise(F.col(body)))


def probe_kind(url: Column | str) -> Column:
    col = F.col(url) if isinstance(url, str) else url
    return F.when(col.rlike("^https?://"), "web").when(col.rlike("^wss?://"), "websocket")


def classify_health_probe(
    df: DataFrame,
    url: str = "url",
    status: str = "http_status",
    content_type: str = "content_type",
    body: str = "body",
) -> DataFrame:
    """Add kind and verdict: healthy, error, not_json or not_pass.

    Only the final status counts. A websocket is healthy once it connects.
    """
    parsed = F.try_parse_json(F.col(body))
    is_object = F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    failed = F.coalesce(F.col(status) >= 400, F.lit(True))
    answer = F.try_variant_get(parsed, "$.status", "string")
    web = (
        F.when(failed, "error")
        .when(~F.contains(F.coalesce(F.col(content_type), F.lit("")), F.lit("application/json")), "not_json")
        .when(~F.coalesce(is_object, F.lit(False)), "error")
        .when(answer == "pass", "healthy")
        .otherwise("not_pass")
    )
    socket = F.when(failed, "error").otherwise("healthy")
    kind = probe_kind(url)
    return df.withColumns(
        {
            "kind": kind,
            "verdict": F.when(kind == "web", web).when(kind == "websocket", socket),
        }
    )


def health_rollup(
    probes: DataFrame, check: str = "check_id", seq: str = "event_id"
) -> DataFrame:
    """Per check the verdict of the last web and websocket probe and the overall result.

    A missing kind passes; a check without any usable address is an error.
    """

    def last(kind: str) -> Column:
        return F.max_by("verdict", F.when(F.col("kind") == kind, F.col(seq)))

    rolled = probes.groupBy(check).agg(last("web").alias("web"), last("websocket").alias("ws"))

    def passes(c: str) -> Column:
        return F.coalesce(F.col(c) == "healthy", F.lit(True))

    return rolled.withColumn(
        "overall",
        F.when(F.col("web").isNull() & F.col("ws").isNull(), "error")
        .when(passes("web") & passes("ws"), "pass")
        .otherwise("fail"),
    )


def rpc_response_extract(
    df: DataFrame, content_type: str = "content_type", body: str = "body"
) -> DataFrame:
    """Add outcome, message and result of an RPC response.

    error    the result holds `error` (whatever its value), or there is no result
    result   the result as JSON text
    html     the body as text
    empty    no body, or a type that is not read
    invalid  JSON was announced but cannot be parsed
    """
    text, kind = F.col(body), F.coalesce(F.col(content_type), F.lit(""))
    keys = F.json_object_keys(text)
    has_result = F.coalesce(F.array_contains(keys, "result"), F.lit(False))
    inner = F.get_json_object(text, "$.result")
    has_error = F.coalesce(F.array_contains(F.json_object_keys(inner), "error"), F.lit(False))
    is_json = F.contains(kind, F.lit("application/json"))
    outcome = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(is_json & F.try_parse_json(text).isNull(), "invalid")
        .when(is_json & has_result & ~has_error, "result")
        .when(is_json, "error")
        .when(F.contains(kind, F.lit("text/html")), "html")
        .otherwise("empty")
    )
    explained = or_default(F.get_json_object(text, "$.error.data.message"), BAD_RESPONSE)
    message = F.when(
        F.col("outcome") == "error",
        F.when(has_result, F.get_json_object(inner, "$.error")).otherwise(
            F.concat(F.lit("Error: "), explained)
        ),
    )
    result = F.when(F.col("outcome") == "result", inner).when(F.col("outcome") == "html", text)
    return df.withColumn("outcome", outcome).withColumns({"message": message, "result": result})


def related_setting_join(
    configs: DataFrame, sites: DataFrame, site: str = "website_id", key: str = "container_key"
) -> DataFrame:
    """Per settings row the key of its site, the flag it shows, and what saving it would do.

    has_key  the site has a non-blank key
    new_key  the key after saving: kept while enabled, null once switched off
    valid    an enabled row needs a key
    """
    one = sites.groupBy(site).agg(F.max(key).alias("_key"))
    joined = look_up(configs, one, [site], configs.columns, "left").withColumn("key", or_default("_key", ""))
    has = F.col("key") != ""
    enabled = F.coalesce(F.col("enabled"), F.lit(False))
    return joined.withColumns(
        {
            "has_key": has,
            "new_key": F.when(enabled, F.col("_key")),
            "valid": ~enabled | has,
        }
    ).drop("_key")


