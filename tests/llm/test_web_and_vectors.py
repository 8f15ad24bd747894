"""Operators on pages and vectors, and the pipeline."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_helpers import brute_components, check_packed

import corpus_pipeline
from fleetwright.llm import ann, html_text, url_filter, warc
from fleetwright.llm.packing import CAPACITY, PER_SOURCE
from fleetwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [
        (1, "http://a.org/x", "same", 1), (2, "http://a.org/y\r\nX: 1", "same", 1), (3, None, None, 1), (4, "", "", 1),
        (5, "ftp", "é" * 5000, 1), (5, "ftp", "é" * 5000, 1), (None, "http://b.org", "same", 1), (7, "http://c.org", "WARC/1.1\r\n\r\n", 1),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, path int")


def test_warc(spark, odd_pages):
    manifest = warc.archive(odd_pages, chunk=700, archive_bytes=300)
    chunks = warc.read_archives(manifest, chunk=64)
    got = {}
    for r in chunks.orderBy("page_id", "chunk_no").collect():
        assert r["chunk_bytes"] <= 64
        got.setdefault(r["page_id"], []).append(r)
    assert warc.summary(chunks).count() == odd_pages.count()
    roles = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.summary(chunks).collect()}
    assert roles == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 7: ("response", None)}
    for r in odd_pages.where("page_id in (1, 2, 3, 4, 7)").collect():
        body = (r["html"] or "").encode()
        last = got[r["page_id"]][-1]
        assert last["payload_bytes"] == len(body) and last["target_uri"] == r["url"]
        assert last["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if last["record_type"] == "response":
            assert b"".join(x["data"] for x in got[r["page_id"]]) == body
    with gzip.open(manifest.first()["path"].removeprefix("file://")) as f:
        assert f.readline() == b"WARC/1.1\r\n"
    assert warc.summary(warc.read_archives(warc.archive(odd_pages.limit(0)))).count() == 0


def test_nearest_over_groups_of_shards(spark):
    """More shards than groups: queries are copied once per group, by a shuffle, and meet every shard."""
    x = np.random.default_rng(3).normal(size=(800, 4)).astype(np.float32)
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id bigint, embedding array<{kind}>")
        found = ann.nearest(df, k=5, every=100, shard_rows=10)
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
        assert len(got) == 40
        for q in range(0, 800, 100):
            gap = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
            near = [i for i in np.argsort(gap, kind="stable") if i != q][:5]
            assert [got[q, r + 1] for r in range(5)] == [(i, gap[i]) for i in near]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) + rng.integers(0, 4, (1500, 1)) * 3
    x[500:800] = x[500]
    rows = [(i, v.tolist(), 9) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2100, [0.0] * 16, 1), (2200, [float("nan")] * 16, 1), (2300, [None] * 16, 1), (None, x[0].tolist(), 1), (2400, [1.0, 2.0], 1), (2500, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = ann.nearest(df, k=10, every=100, shard_rows=400).toPandas()
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and np.allclose(mine.score, d[mine.vec_id])
        hit += len(set(want) & set(mine.vec_id))
    assert hit >= 0.95 * 150 and set(got.query_id) == set(range(0, 1500, 100))
    assert got[got.query_id == 600].sort_values("rank").vec_id.tolist() == list(range(500, 510))
    assert ann.nearest(df.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><script>var a = "</p><p>no</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="page"><div class="post-7"><h1>Title &amp; more</h1><p>First <b>paragraph</b> of
text, long enough.<p>Second&nbsp;one &lt;here&gt;.<br>Still it<ul><li>item one<li>item two</ul><div class="ad">Buy</div></div>
<div id="comments"><p>Nice article, I like it very much, thanks a lot for it.</p></div><aside>More</aside></div>
<form><input name=q>Search</form><!-- <p>gone</p> --><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    text, path = html_text.main_text(PAGE, [])
    assert text == "Title & more\n\nFirst paragraph of text, long enough.\n\nSecond one <here>. Still it\n\nitem one\n\nitem two"
    assert path == ">body.no-sidebar>div.page>div.post-"
    assert html_text.main_text("", []) == ("", None) and html_text.main_text("a < b <i", [])[0] == "a < b <i"
    rows = [(1, "http://h.org/1", PAGE, 5), (1, "http://h.org/1", PAGE, 5), (2, "http://h.org/2", PAGE.replace("post-7", "post-8").replace("First", "Other"), 5), (None, None, None, 5), (4, "x", "", 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = html_text.extract(df).collect()
    assert len(got) == 5 and sorted(r["n_chars"] for r in got) == [0, 0, len(text), len(text), len(text)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_of_two_templates(spark):
    box = "<body><div class=box><p>" + "The text of this page is in its box. " * 20 + "</p></div></body>"
    article = "A long article of its own template. " * 20
    other = f"<body><article><p>{article}</p></article><div class=box><p>A teaser.</p></div></body>"
    mixed = "<body><div class=box><p>" + "Short text. " * 20 + "</p></div><div class=list><p>" + "Long list. " * 40 + "</p></div></body>"
    rows = [(i, f"http://h.org/{i}", box) for i in range(20)] + [(20, "http://h.org/20", other), (21, "http://h.org/21", mixed)]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0]["path"] == got[21]["path"] == ">body>div.box"
    assert (got[20]["text"], got[20]["path"]) == (article.strip(), ">body>article")
    assert got[21]["text"] == ("Short text. " * 20).strip()


def test_html_in_wrappers_with_unwanted_words():
    body = "A long paragraph of the article. " * 10
    rest = "<div class=sidebar><p>Side text.</p></div><div class=comments><p>Nice.</p></div><form><p>Search it</p></form>"
    for name in ("class='content no-sidebar'", "class=content-sidebar", "class=has-banner", "id=with-menu", "class=widget"):
        for inner in (f"<article><p>{body}</p></article>", f"<div class=text><p>{body}</p></div>"):
            assert html_text.main_text(f"<body><div {name}>{inner}</div>{rest}</body>", [])[0] == body.strip()
    page = f"<body><form action=x><div><p>{body}</p></div><div class=sidebar>Side text.</div></form></body>"
    assert html_text.main_text(page, [])[0] == body.strip()
    # Comments and notices may be longer than the article, and still go; alone on a page they stay.
    for name in ("comments", "cookie-notice", "related"):
        noise = f"<div class={name}><article class={name}><p>{body * 3}</p></article></div>"
        assert html_text.main_text(f"<body><div class=post><p>{body}</p></div>{noise}</body>", [])[0] == body.strip()
        assert html_text.main_text(f"<body>{noise}</body>", [])[0] == (body * 3).strip()
    # An article outside keeps those inside of a sidebar out.
    page = f"<body><article><p>{body}</p></article><div class=sidebar><article><p>Teaser.</p></article></div></body>"
    assert html_text.main_text(page, [])[0] == body.strip()


def test_html_tables(spark):
    got = QUERIES["op6_html_extraction"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").drop("url"), "page_id")
    for r in got.collect():
        assert r["n_chars"] == len(r["text"]) > 0 and "©" not in r["text"]


def test_urls(spark):
    rows = [
        (1, "http://A.Org/x?y", "allow", "org/"), (2, "http://org/", "allow", "org/"), (3, "http://w.example.org/es/1", "block", "example.org/es/"),
        (4, "http://example.org/en/12", "block", "example.org/en/1"), (5, "http://notexample.org/es/", "allow", "org/"), (6, "http://a.com/fr/?x", "allow", "com/fr/"),
        (7, "http://a.com/de/#x", "block", "com/de/"), (8, "http://good.net/a", "allow", None), (9, "http://bad.net/a", "block", None), (10, None, "allow", None),
        (11, "no url", "allow", None), (12, "http://a.org", "allow", None), (9, "http://bad.net/a", "block", None), (13, "http://new.bad.net:80/", "block", None),
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u, _, _ in rows], "page_id bigint, url string, verdict string")
    marks = [("good.net", i % 40 == 0) for i in range(200)] + [("bad.net", i % 40 != 0) for i in range(200)] + [("bad.net", None)]
    marks += [(f"h{j}.net", i % 50 == 0) for j in range(30) for i in range(20)]
    outcomes = spark.createDataFrame(marks, "host string, bad boolean")
    got = sorted((r["page_id"], r["verdict"], r["rule"]) for r in url_filter.judge(pages, outcomes).collect() if r["page_id"] != 13)
    assert got == sorted((i, v, r) for i, _, v, r in rows if i != 13)
    bounds = {r["host"]: r for r in url_filter.reputation(outcomes, pages.select(F.lit("bad.net").alias("host"))).collect()}
    assert 0.9 < bounds["bad.net"]["bound"] < bounds["bad.net"]["mean"]
    assert url_filter.judge(pages.limit(0), outcomes.limit(0)).count() == 0
    assert url_filter.judge(pages, outcomes.limit(0)).count() == len(rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    live = {i: r for i, r in rows.items() if any(c.isalpha() for c in r["text"] or "")}
    first = {}
    for i in sorted(live):
        first.setdefault(" ".join(("|" + live[i]["text"] + "|").split()), i)
    comps = brute_components([(i, live[i]["text"]) for i in first.values()], 5, 80)
    want = {i for i, (_, c) in comps.items() if i == c}
    now, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        seen.append(now.count())
    assert {r["doc_id"] for r in now.collect()} == want
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} <= want
    check_packed(out, list(rows.values()), CAPACITY, PER_SOURCE)
