"""URL filter: rules first, else the reputation of the host.

Labelled pages give good and bad outcomes. The share of bad pages of a host is shrunk towards
that of its registered domain, that towards its suffix, and that towards all pages: each level
has a beta prior whose mean is the level above and whose strength is estimated from how much the
shares at that level differ (method of moments). A host is blocked if the lower bound of its
posterior share of bad pages is above a limit, hence only on evidence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.common import store

# (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LIMIT = 0.5
DEVIATIONS = 1.645
# Labels under which names are registered one level further down (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def split_url(url: Column | str) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without `://`."""
    pattern = "://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as a struct (rule, verdict), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host without port."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\.")
    n = F.size(labels)
    deep = (n >= 3) & F.element_at(labels, -2).isin(*SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2)
    take = F.when(deep, 2).otherwise(1)
    tail = lambda k: F.array_join(F.slice(labels, n - F.least(k, n) + 1, F.least(k, n)), ".")
    return tail(take + 1), tail(take)


def _shrunk(level: DataFrame, bad: str, seen: str, prior: str) -> DataFrame:
    """Adds `strength`, `mean`: the posterior mean under a prior whose strength is estimated."""
    n, k, m = F.col(seen), F.col(bad), F.col(prior)
    spread = m * (1 - m)
    rho = F.sum((k - n * m) * (k - n * m) - n * spread) / F.nullif(F.sum(n * (n - 1) * spread), F.lit(0.0))
    bounded = F.least(F.greatest(F.coalesce(rho, F.lit(0.01)), F.lit(0.001)), F.lit(0.5))
    fitted = level.agg((1 / bounded - 1).alias("strength"))  # one row
    return level.join(F.broadcast(fitted)).withColumn("mean", (k + F.col("strength") * m) / (n + F.col("strength")))


def reputation(outcomes: DataFrame, hosts: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """host, pages, mean, bound for every row of `hosts` (host).

    `outcomes` has host and bad (boolean); null outcomes do not count. Hosts without labelled
    pages take the shrunk share of their domain or suffix.
    """
    known = outcomes.where("bad is not null").groupBy("host").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("k")
    )
    domain, suffix = registered(F.col("host"))
    every = hosts.select("host").distinct().join(known, "host", "left").select(
        "host", domain.alias("domain"), suffix.alias("suffix"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"),
    )
    every = store(every, "hosts")
    total = every.agg(F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("share"))
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = _shrunk(every.groupBy("suffix").agg(*sums).join(F.broadcast(total)), "k", "n", "share")
    domains = every.groupBy("domain", "suffix").agg(*sums).join(
        suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"
    )
    domains = store(_shrunk(domains, "k", "n", "prior").select("domain", "suffix", F.col("mean").alias("prior")), "domains")
    last = _shrunk(every.join(domains, ["domain", "suffix"]), "k", "n", "prior")
    a = F.col("k") + F.col("strength") * F.col("prior")
    b = F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("prior"))
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return last.select("host", F.col("n").alias("pages"), "mean", (F.col("mean") - deviations * sd).alias("bound"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    rules: Sequence[tuple[str, str, str]] = RULES,
    limit: float = LIMIT,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """page_id, host, path, rule, verdict, bound for every row of `pages` (page_id, url).

    A rule's verdict wins over the host's reputation. Null URLs and those without `://` have an
    empty host and are judged like a host of that name. Other columns are ignored.
    """
    host, path = split_url("url")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = store(reputation(outcomes, urls, deviations), "reputation")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    judged = urls.join(known.select("host", "bound"), "host", "left").withColumn("r", rule)
    own = F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), "bound"
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose path ends in the number of a labelled document: bad if
    that is toxic or of low quality. Repeated labels of a document count as one, bad if any is."""
    host, path = split_url("url")
    number = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    numbered = pages.select(host.alias("host"), number.alias("number")).where("number <> ''")
    bad = F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(bad)
    return numbered.join(marks, numbered["number"].cast("bigint") == marks["doc_id"]).select("host", "bad")
