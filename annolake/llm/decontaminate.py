"""Benchmark decontamination by SimHash of item-sized windows.

A document leaks an item when a window of as many words as the item has a weighted
(multiset) Jaccard similarity of ``SIMILARITY`` or more to it, over shingles of five
words (of all words, where an item has fewer).  A document with fewer words than the
item is one window, compared whole.

1. Such a window shares 6/7 of the item's shingles, so only places where a document
   has item shingles matter.  Document shingles meet the benchmark's in one join;
   documents without enough of them (3/4, where the document is shorter) end here.
   This drops nothing.
2. A shingle at place p of the document and q of the item puts the item's window at
   p - q.  Moving a window that starts before the first such place, or after the last,
   towards it loses no shared shingle.  Between two neighbouring such places that are d
   apart, a window of n shingles holds 2 n - d shared ones at most.  So the windows that
   start at those places, and between two of them up to 8/7 n (or less than an item)
   apart, hold the best ones.
3. Each window gets a 64-bit SimHash of its shingles with their counts.  Bits are cut
   into ``RADIUS`` + 1 blocks; two prints at most ``RADIUS`` bits apart agree in one
   block at least, so one equality join on blocks finds all pairs within the radius.
   At similarity 0.75 prints differ in 11 bits on average, with a deviation of 3: the
   radius is over four deviations away.
4. Counts of shared shingles give the exact similarity of every candidate.

Null texts and items are empty and match nothing; empty items likewise.  Rows are
told apart by doc_id (null too) and text; repeated rows share their result, and
equal similarities go to the earlier window.  Extra columns are kept by
``decontaminate``.  Empty tables give no leaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from annolake.llm.common import words, written

WIDTH = 5
SIMILARITY = 0.75
RADIUS = 24
BITS = 64


def _grams(tokens: Column, width: int) -> Column:
    """Hashes of the shingles of ``width`` words, in order; none, if words are too few."""
    last = F.size(tokens) - width + 1
    return F.when(last >= 1, F.transform(F.slice(tokens, 1, last), lambda w, i: F.xxhash64(
        F.lit(width), w, *(F.get(tokens, i + k) for k in range(1, width)))))


def print_text(text: Column) -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _simhash(grams: DataFrame, key: list[str]) -> DataFrame:
    """(key, print) from rows (key, h): bit b is set where most of the shingles have it.

    Two counters share a long, bits b and b + 32, so that 32 sums make 64 counts."""
    lanes = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(lanes)).alias(f"s{b}") for b in range(BITS // 2)]
    counted = grams.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *sums)

    def bit(count: Column, place: int) -> Column:
        return F.when(count * 2 > F.col("n"), F.lit((1 << place) - (1 << 64 if place == 63 else 0))).otherwise(F.lit(0))
    bits = [bit(F.col(f"s{b}").bitwiseAND(F.lit((1 << 32) - 1)), b) for b in range(BITS // 2)]
    bits += [bit(F.shiftrightunsigned(f"s{b}", 32), b + 32) for b in range(BITS // 2)]
    return counted.select(*key, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("print"))


def _blocks(prints: DataFrame) -> DataFrame:
    """One row for each block of a print: its number and its bits."""
    edges = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    block = F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("print", a).bitwiseAND(
        F.lit((1 << b - a) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))))
    return prints.select("*", F.inline(block))


def _places(hits: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, start) of the windows that may leak."""
    whole = Window.partitionBy("doc_id", "fp", "item_id")
    enough = (hits.withColumn("hits", F.count(F.lit(1)).over(whole))
              .filter(F.when(F.col("doc_words") < F.col("n_words"), 4 * F.col("hits") >= 3 * F.col("n_grams"))
                      .otherwise(7 * F.col("hits") >= 6 * F.col("n_grams")))
              .select("doc_id", "fp", "item_id", "n_words", "n_grams", F.col("doc_words"), (F.col("p") - F.col("q")).alias("at")).distinct())
    before = F.lag("at").over(Window.partitionBy("doc_id", "fp", "item_id").orderBy("at"))
    gap = F.col("at") - before
    from_ = F.when((gap < F.col("n_words")) | (7 * gap <= 8 * F.col("n_grams")), before + 1).otherwise(F.col("at"))
    filled = enough.withColumn("from", from_).select(
        "doc_id", "fp", "n_words", "doc_words", F.explode(F.sequence("from", "at")).alias("start"))
    # a window hangs over neither end of its document; a shorter document is one window
    last = F.col("doc_words") - F.col("n_words")
    inside = F.greatest(F.lit(0), F.least(F.col("start"), last))
    return filled.select("doc_id", "fp", "n_words", inside.alias("start")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, fp, item_id, start, n_words, similarity) of the best window for each
    leaked item of each document (doc_id and ``print_text``)."""
    width = F.least(F.col("n_words"), F.lit(WIDTH))
    items = (benchmark.select("item_id", words(F.col("text")).alias("words"))
             .select("item_id", "words", F.size("words").alias("n_words")).filter("n_words > 0").distinct())
    per_width = F.coalesce(*(F.when(width == w, _grams(F.col("words"), w)) for w in range(1, WIDTH + 1)))
    item_grams = written(items.select("item_id", "n_words", width.alias("width"), F.size(per_width).alias("n_grams"),
                                      F.posexplode(per_width).alias("q", "h")), "benchmark-shingles")
    widths = [r.width for r in item_grams.select("width").distinct().collect()]

    texts = docs.select("doc_id", print_text(F.col("text")).alias("fp"), words(F.col("text")).alias("words"))
    hits = [texts.select("doc_id", "fp", F.size("words").alias("doc_words"),
                         F.posexplode(_grams(F.col("words"), w)).alias("p", "h"))
            .join(item_grams.filter(F.col("width") == w), "h") for w in sorted(widths)]
    schema = "doc_id long, fp long, n_words int, start int"
    if not hits:
        return docs.sparkSession.createDataFrame([], "doc_id long, fp long, item_id long, start int, n_words int, similarity double")
    windows = written(_places(reduce(DataFrame.unionByName, hits)).select(
        *(F.col(n).cast(t) for n, t in (f.split() for f in schema.split(", ")))), "windows")

    found = texts.alias("t").join(windows.alias("w"), (F.col("t.fp") == F.col("w.fp"))
                                  & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")))
    cut = (found.select("w.doc_id", "w.fp", "n_words", "start", F.expr("slice(words, start + 1, n_words)").alias("words"))
           .dropDuplicates(["doc_id", "fp", "n_words", "start"]))
    grams = written(cut.select("doc_id", "fp", "n_words", "start", F.explode(F.coalesce(*(
        F.when(width == w, _grams(F.col("words"), w)) for w in sorted(widths)))).alias("h"))
        .groupBy("doc_id", "fp", "n_words", "start", "h").agg(F.count(F.lit(1)).alias("n")), "window-shingles")
    counts = item_grams.groupBy("item_id", "n_words", "n_grams", "h").agg(F.count(F.lit(1)).alias("m"))

    key = ["doc_id", "fp", "n_words", "start"]
    repeat = lambda rows, n: rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col(n))))
    ours = _blocks(_simhash(repeat(grams, "n"), key))
    theirs = _blocks(_simhash(item_grams.select("item_id", "n_words", "h"), ["item_id", "n_words"]))
    near = (ours.alias("a").join(theirs.alias("b"), ["n_words", "block", "value"])
            .filter(F.bit_count(F.col("a.print").bitwiseXOR(F.col("b.print"))) <= RADIUS)
            .select("doc_id", "fp", "n_words", "start", "item_id").distinct())

    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"g.{k}")) for k in key]
    # of a window its own number of shingles: a shorter document has fewer than the item
    own = F.sum("n").over(Window.partitionBy(*key)).alias("own")
    union = F.col("own") + F.col("n_grams") - F.col("shared")
    shared = (near.alias("c").join(grams.select("*", own).alias("g"), reduce(lambda a, b: a & b, same))
              .select("c.*", "g.h", "g.n", "g.own").join(counts, ["item_id", "n_words", "h"])
              .groupBy("item_id", "n_grams", "own", *key).agg(F.sum(F.least("n", "m")).alias("shared"))
              .withColumn("similarity", F.col("shared") / union).filter(F.col("shared") >= similarity * union))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n_words"))
    return (shared.groupBy("doc_id", "fp", "item_id").agg(best.alias("best"))
            .select("doc_id", "fp", "item_id", (-F.col("best.start")).alias("start"), "best.n_words", "best.similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that leak an item; all columns are kept."""
    found = leaks(docs, benchmark, similarity).select(
        F.col("doc_id").alias("__doc"), F.col("fp").alias("__fp")).distinct()
    return docs.join(found, (print_text(docs["text"]) == F.col("__fp"))
                     & docs["doc_id"].eqNullSafe(F.col("__doc")), "left_anti")
