import pytest
from pyspark.sql import functions as F

from annolake.llm import url_filter as U

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"), ("net", "/fr/", "allow"), ("", "/x", "block")]
URLS = [None, "", "nothing", "http://", "http://Example.COM/en/1?x", "https://www.example.com/en/#top", "http://a.net/es/",
        "http://net/fr/a", "http://anet/fr/a", "http://example.com", "http://example.com/EN/", "http://b.org/p", "http://b.org/p?q",
        "x://a://b.net/es/", "http://é.net/es/ü", "http://b.org/q", "http://" + "a." * 3000 + "net/es/" + "z" * 50000]


def brute(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, "allow"
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if (host, path) in listed else "allow"


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS * 2)], "page_id int, url string, host string")
    rules = spark.createDataFrame(RULES, U.ENTRY)
    listed = spark.createDataFrame([("b.org", "/p"), ("b.org", "/p"), (None, "/q")], "host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules, listed).collect()}
    assert got == {i: brute(u, RULES, {("b.org", "/p")}) for i, u in enumerate(URLS * 2)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id int, url string")
    no_rules, nobody = spark.createDataFrame([], U.ENTRY), spark.createDataFrame([], "host string, path string")
    assert [r.verdict for r in U.judge(pages, no_rules, nobody).collect()] == ["allow"]
    assert U.judge(pages.limit(0), spark.createDataFrame(RULES, U.ENTRY), nobody).count() == 0


def test_filter_keeps_every_listed_key(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(5000).select(F.concat(F.lit("o"), "id").alias("key"))
    blocks = U.bloom(keys, 512)
    assert U.possible(keys, blocks, 512).count() == 5000
    assert U.possible(others, blocks, 512).count() < 100


@pytest.mark.parametrize("urls, want", [(["http://a/b", "http://a/b#x", "http://a/c", None, "x"], [("a", "/b")])])
def test_repeated(spark, urls, want):
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [tuple(r) for r in U.repeated(pages).collect()] == want
