"""Mixing by iterative proportional fitting.

Documents are counted into cells (source, language, topic) by tokens.  Each
dimension has a table of factors; one round sets every factor so that its
dimension's token totals meet the target shares, given the other factors.  Only
cells, pre-aggregated before any shuffle, take part, each with its three factors, and
Spark sums them by category, so a source with a third of all rows is a few cells.  After the fit a document's rate is the product of its three factors, and
it is expected in as many copies as its rate times one scale: expected token totals
then meet all targets at once.  The scale is one over the greatest rate, so that
every document comes once at most, unless fewer than ``BUDGET`` of all tokens would be
expected then.  In that case, where a small category is lifted far above the rest, the
scale gives just this budget and documents of that category come several times:
the whole part of their expected copies, and one more by the draw.

Topics are told by the look of a text (``topic``), unless the documents bring a
column of their own.  Null sources, languages and topics are the category ``""``;
null texts have no tokens and the rate of their cell, 0 where the whole cell has
no tokens; categories without a target get the rate 0, and targets without
documents are left out.  The draw hashes the doc_id (the text, where it is null),
so repeated rows share it.  All columns are kept, new ones replace others of
their name.  Empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from annolake.llm.common import written

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, TOLERANCE, SEED = 30, 1e-6, 11
#: The least share of all tokens that a mix is expected to have.
BUDGET = 0.5
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """What a text looks like: blank, short, symbols, capitals, lines or prose."""
    size = F.length(text)

    def share(letters: str) -> Column:
        return (size - F.length(F.translate(text, letters, ""))) / size
    return (F.when(F.coalesce(size, F.lit(0)) == 0, "blank").when(size < 300, "short")
            .when(share("!#$%&*+/<=>@^_|{}[]~") > 0.03, "symbols")
            .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.3, "capitals")
            .when(share("\n") > 0.01, "lines").otherwise("prose"))


def cells(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) from documents with n_tokens."""
    return docs.groupBy(*(F.coalesce(d, F.lit("")).alias(d) for d in DIMENSIONS)).agg(
        F.sum("n_tokens").cast("double").alias("tokens"))


def tempered(counted: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares (value, share): the dimension's own shares to a power below 1,
    which lifts small categories."""
    sums = counted.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n")).filter("n > 0")
    raised = sums.select("value", F.pow("n", F.lit(power)).alias("share"))
    total = raised.agg(F.sum("share")).first()[0] or 1.0
    return raised.withColumn("share", F.col("share") / total)


def rake(counted: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS,
         tolerance: float = TOLERANCE) -> dict[str, DataFrame]:
    """Factors (value, factor) for each dimension, such that the cells' tokens times
    their three factors have the target shares, to ``tolerance``."""
    held = counted.filter("tokens > 0")
    for d in DIMENSIONS:
        present = held.select(F.col(d).alias("value")).distinct()
        goal = targets[d].filter("share > 0").join(present, "value")
        total = goal.agg(F.sum("share")).first()[0] or 1.0
        held = (held.join(goal.select(F.col("value").alias(d), (F.col("share") / total).alias(f"share_{d}")), d)
                .withColumn(f"f_{d}", F.lit(1.0)))
    # a row for each cell with its three factors: a round is one plan and one small table
    held = written(held, "cells-fit")
    for _ in range(rounds):
        fitted, moved = held, []
        for d in DIMENSIONS:
            others = reduce(lambda a, b: a * b, (F.col(f"f_{o}") for o in DIMENSIONS if o != d), F.col("tokens"))
            fitted = fitted.withColumn("new", F.col(f"share_{d}") / F.sum(others).over(Window.partitionBy(d)))
            fitted = fitted.withColumn(f"moved_{d}", F.abs(F.col("new") / F.col(f"f_{d}") - 1)).withColumn(f"f_{d}", F.col("new")).drop("new")
            moved.append(f"moved_{d}")
        held = written(fitted.withColumn("moved", F.greatest(*moved)).drop(*moved), "cells-fit")
        change = held.agg(F.max("moved")).first()[0] or 0.0
        held = held.drop("moved")
        if change < tolerance:
            break
    return {d: held.groupBy(F.col(d).alias("value")).agg(F.max(f"f_{d}").alias("factor")) for d in DIMENSIONS}


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number from 0 up to 1 that depends on the document alone."""
    key = F.coalesce(F.xxhash64(doc_id.cast("string"), F.lit(seed)), F.lit(0))
    key = F.when(doc_id.isNull(), F.xxhash64(text, F.lit(seed))).otherwise(key)
    return F.shiftrightunsigned(key, 11) / float(1 << 53)


def describe(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with topic, n_tokens and draw: all that the mix reads from a text."""
    if "topic" not in docs.columns:
        docs = docs.withColumn("topic", topic(F.col("text")))
    return docs.withColumn("n_tokens", tokens(F.col("text"))).withColumn(
        "draw", draw(F.col("doc_id"), F.col("text"), seed))


def rated(docs: DataFrame, powers: dict[str, float], budget: float = BUDGET, repeats: bool = True) -> DataFrame:
    """Described ``docs`` with rate, probability, copies and sampled.

    ``budget``: the least share of all tokens to expect; without ``repeats`` it is given
    up where documents would have to come twice."""
    counted = written(cells(docs), "cells")
    targets = {d: written(tempered(counted, d, powers[d]), f"wanted-{d}") for d in DIMENSIONS}
    factors = rake(counted, targets)
    out = docs
    for d in DIMENSIONS:
        side = factors[d].select(F.col("value").alias(f"__{d}"), F.col("factor").alias(f"__f_{d}"))
        out = out.join(side, F.coalesce(out[d], F.lit("")) == side[f"__{d}"], "left").drop(f"__{d}")
    rate = reduce(lambda a, b: a * b, (F.col(f"__f_{d}") for d in DIMENSIONS))
    cell = counted.filter("tokens > 0")
    for d in DIMENSIONS:
        cell = cell.join(factors[d].select(F.col("value").alias(d), F.col("factor").alias(f"__f_{d}")), d)
    seen = cell.agg(F.max(rate).alias("greatest"), F.sum(F.col("tokens") * rate).alias("mixed")).first()
    least = budget * (counted.agg(F.sum("tokens")).first()[0] or 0.0)
    # tokens of the mix as the greatest rate allows them, and as the budget asks for
    greatest = seen.greatest or 1.0
    if repeats and seen.mixed and seen.mixed / greatest < least:
        greatest = seen.mixed / least
    return (out.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
            .withColumn("__copies", F.col("rate") / greatest)
            .withColumn("probability", F.least(F.lit(1.0), F.col("__copies")))
            .withColumn("copies", (F.floor("__copies") + (F.col("draw") < F.col("__copies") - F.floor("__copies")).cast("int")).cast("long"))
            .withColumn("sampled", F.col("copies") > 0)
            .drop("draw", "__copies", *(f"__f_{d}" for d in DIMENSIONS)))


def mix(docs: DataFrame, powers: dict[str, float], seed: int = SEED, budget: float = BUDGET, repeats: bool = True) -> DataFrame:
    """``docs`` with topic, n_tokens, rate, probability, copies and sampled.

    ``powers``: for each dimension the power of its tempered target."""
    return rated(describe(docs, seed), powers, budget, repeats)


def sample(docs: DataFrame, powers: dict[str, float], seed: int = SEED) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns, in as many copies as the mix has."""
    needed = [c for c in ("doc_id", "text", *DIMENSIONS) if c in docs.columns]
    held = docs.select(F.struct("*").alias("__row"), *needed)
    taken = mix(held, powers, seed).filter("sampled")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
