"""Closest column name for a misspelt variable.

The measure is Ratcliff-Obershelp with the annotation first and the column second (it is
not symmetric), both in lower case; of equal scores the earlier column wins.  It is 2 M
over the sum of both lengths, M being the letters in the longest common block, the longest
blocks left and right of it, and so on.

Columns that cannot reach the threshold leave first: M is at most the number of letters
both have, counted with repeats.  That is an intersection of lettered sets (``e1``,
``e2`` for two e), prepared once for each column of the catalogue.  Only the few columns
left are measured, by a fold over a small stack of open ranges.  All of it is array
expressions, so nothing leaves the JVM and rows that need no search cost a comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_THRESHOLD = 0.85
_RANGES = "array<struct<a:int,b:int,c:int,d:int>>"


def _with(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def letters(name: Column) -> Column:
    """The characters of a name in lower case."""
    return F.split(F.lower(name), "")


def lettered(chars: Column) -> Column:
    """Each character with how often it has come so far."""
    return F.transform(chars, lambda c, i: F.concat(
        c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda before: before == c)).cast("string")))


def _range(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"), d.cast("int").alias("d"))


def matched(one: Column, two: Column) -> Column:
    """Letters of two character arrays in common blocks."""

    def block(i: Column, j: Column, most: Column) -> Column:
        """Length of the common block from places i and j on."""
        ends = F.array_position(F.transform(F.sequence(F.lit(0), most - 1), lambda t: F.get(one, i + t) == F.get(two, j + t)), F.lit(False))
        return F.when(ends > 0, ends.cast("int") - 1).otherwise(most)

    def longest(r: Column) -> Column:
        """(length, -place, -place) of the longest block in ranges; of equal ones the first."""
        starts = F.transform(F.sequence(r["a"], r["b"] - 1), lambda i: F.transform(F.sequence(r["c"], r["d"] - 1), lambda j: F.struct(
            block(i, j, F.least(r["b"] - i, r["d"] - j)).alias("n"), (-i).alias("i"), (-j).alias("j"))))
        return F.array_max(F.flatten(starts))

    def next_state(state: Column, r: Column, best: Column) -> Column:
        i, j, n = -best["i"], -best["j"], best["n"]
        sides = F.filter(F.array(_range(r["a"], i, r["c"], j), _range(i + n, r["b"], j + n, r["d"])),
                         lambda side: (side["a"] < side["b"]) & (side["c"] < side["d"]))
        rest = F.slice(state["open"], 1, F.size(state["open"]) - 1)
        return F.struct(F.when(n > 0, F.concat(rest, sides)).otherwise(rest).alias("open"), (state["m"] + n).alias("m"))

    def step(state: Column, _: Column) -> Column:
        moved = _with(F.element_at(state["open"], -1), lambda r: _with(longest(r), lambda best: next_state(state, r, best)))
        return F.when(F.size(state["open"]) > 0, moved).otherwise(state)

    whole = F.array(_range(F.lit(0), F.size(one), F.lit(0), F.size(two)))
    start = F.struct(F.filter(whole, lambda r: (r["b"] > 0) & (r["d"] > 0)).cast(_RANGES).alias("open"), F.lit(0).alias("m"))
    # a block opens two ranges at most, and every block takes a letter
    return F.aggregate(F.sequence(F.lit(0), 2 * F.size(one)), start, step, lambda state: state["m"])


def closest(variable: Column, columns: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """``{name, ratio, ratio_text}`` of the closest of ``column_lists`` columns, null if
    none is close enough."""

    def searched(chars: Column) -> Column:
        return _with(lettered(chars), lambda marks: F.array_max(F.transform(
            F.filter(columns, lambda c: 2.0 * F.size(F.array_intersect(marks, c["marks"])) / (F.size(chars) + F.size(c["chars"])) >= threshold),
            lambda c: F.struct((2.0 * matched(chars, c["chars"]) / (F.size(chars) + F.size(c["chars"]))).alias("ratio"),
                               (-c["place"]).alias("place"), c["name"].alias("name")))))

    best = F.when(variable.isNotNull() & columns.isNotNull(), _with(letters(variable), searched))
    told = _with(best, lambda b: F.when(b["ratio"] >= threshold, F.struct(
        b["name"].alias("name"), b["ratio"].alias("ratio"), F.format_number(b["ratio"], 2).alias("ratio_text"))))
    return told


def column_lists(variables: DataFrame, study_keys: tuple[str, ...] = ()) -> DataFrame:
    """Column names of each dataset in catalogue order, with their letters.

    One list holds one dataset's columns, so its length is bounded by the width
    of a dataset, not by the number of annotations.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "name", "chars", "marks")))
    named = variables.withColumn("chars", letters(F.col("name"))).withColumn("marks", lettered(F.col("chars")))
    return named.groupBy(*study_keys, "domain").agg(F.transform(ordered, lambda c, i: F.struct(
        i.alias("place"), c["name"].alias("name"), c["chars"].alias("chars"), c["marks"].alias("marks"))).alias("columns"))
