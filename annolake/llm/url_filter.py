"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact join.

Entries are either rules (a host with all its subdomains, and a path prefix) or
listed URLs (one host and path).  Every URL is turned into the few keys under
which an entry could be listed: one for each *shape* (number of host labels,
length of path) that some rule has, and one for the whole URL.  Each key is
looked up in the filter first; only possible hits go on to an exact hash join on
the key's text, which removes the false positives, so the result is exact.

The filter is a table of 256-bit blocks (four longs); a key sets or tests
``BITS`` bits of one block.  It is joined like any table: Spark broadcasts it
while its written size is under the session's threshold and shuffles otherwise.

Nulls, and URLs without ``://``, have an empty host and path and match nothing.
Pages with equal URLs share one look-up, so a URL or host with a third of all
rows is judged once; all page rows come back, repeated ones too, with their
columns.  Two rules with the same text: ``block`` wins.  Empty pages, rules or
lists give no rows or no matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from annolake.llm.common import ascii_lower, written

BITS = 6
#: Bits of filter for each entry; a power of two of 256-bit blocks is taken.
BITS_PER_ENTRY = 16
ENTRY = "host string, path string, verdict string"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _bits(key: Column) -> list[Column]:
    """The four words of a key's block that have its bits set."""
    spread = F.xxhash64(key, F.lit("bits"))
    places = [F.shiftrightunsigned(spread, 8 * i).bitwiseAND(F.lit(255)) for i in range(BITS)]
    return [reduce(lambda a, b: a.bitwiseOR(b),
                   (F.when(F.shiftright(p, 6) == w,
                           _one(p)).otherwise(F.lit(0).cast("long"))
                    for p in places)) for w in range(4)]


def _one(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key, F.lit("block")).bitwiseAND(F.lit(blocks - 1))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter's blocks that have any bit: (block, w0, w1, w2, w3)."""
    key = F.col("key")
    marked = keys.select(_block(key, blocks).alias("block"),
                         *(c.alias(f"w{i}") for i, c in enumerate(_bits(key))))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def possible(rows: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` the filter may hold; no listed key is lost."""
    key = F.col("key")
    probe = rows.withColumn("block", _block(key, blocks)).join(filter_, "block")
    held = reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(c) == c for i, c in enumerate(_bits(key))))
    return probe.filter(held).drop("block", "w0", "w1", "w2", "w3")


def _key(kind: str, host: Column, path: Column) -> Column:
    # a host has no slash and a path is empty or starts with one: no two pairs share a key
    return F.concat(F.lit(kind), host, path)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules``: host, path prefix, verdict; the longest that fits decides.
    ``listed``: host and path of blocked URLs, for those that no rule fits.
    Columns of ``pages`` with one of the four new names are replaced.
    """
    host, path = F.col("host"), F.col("path")
    entries = written(
        rules.select(_key("p", host, path).alias("key"), host, path, "verdict")
        .unionByName(listed.select(_key("u", host, path).alias("key"), host, path,
                                   F.lit("block").alias("verdict")))
        .filter(F.col("key").isNotNull() & F.col("verdict").isNotNull())
        .groupBy("key").agg(F.first("host").alias("host"), F.first("path").alias("path"),
                            F.max("verdict").alias("verdict")), "url-entries")
    found = entries.agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.when(F.col("key").startswith("p"),
                             F.struct(_labels(host).alias("labels"), F.length(path).alias("length")))
                      ).alias("shapes")).first()
    blocks = 1 << max(0, (found.n * BITS_PER_ENTRY // 256).bit_length())
    filter_ = written(bloom(entries, blocks), "url-bloom")

    h, p = parts(F.col("__url"))
    urls = (pages.select(F.col(url).alias("__url")).filter(F.col("__url").isNotNull()).distinct()
            .withColumns({"host": h, "path": p}))
    keys = [F.when((_labels(host) >= s.labels) & (F.length(path) >= s.length),
                   _key("p", F.substring_index(host, ".", -s.labels), F.substring(path, 1, s.length)))
            for s in sorted(found.shapes)] + [_key("u", host, path)]
    candidates = (urls.filter(F.instr("__url", "://") > 0)
                  .select("__url", F.explode(F.array_compact(F.array(*keys))).alias("key")))
    hits = possible(candidates, filter_, blocks).join(
        entries.select("key", "verdict", F.concat("host", "path").alias("rule")), "key")
    prefix = F.col("key").startswith("p")
    best = hits.groupBy("__url").agg(
        F.max(F.when(prefix, F.struct(F.length("rule"), "rule", "verdict"))).alias("__by_rule"),
        F.max(F.when(~prefix, F.col("verdict"))).alias("__by_list"))
    new = {"host": parts(F.col(url))[0], "path": parts(F.col(url))[1], "rule": F.col("__by_rule.rule"),
           "verdict": F.coalesce("__by_rule.verdict", "__by_list", F.lit("allow"))}
    return (pages.join(best, pages[url] == best["__url"], "left").withColumns(new)
            .drop("__url", "__by_rule", "__by_list"))


def repeated(pages: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URLs that more than one page has, as a list for ``judge``."""
    host, path = parts(F.col(url))
    return (pages.select(host.alias("host"), path.alias("path")).filter("host <> ''")
            .groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select("host", "path"))
