"""Imported elements against the annotations already on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annolake.schemas import document_key

SIDES = ("x0", "y0", "x1", "y1")


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


#: Boxes of one text on one page from which they are compared by cells.
MANY = 256


def match_positions(imported: DataFrame, existing: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Attach ``match_idx``: the first annotation whose four edges lie closer than the
    tolerance and whose text is equal ignoring case; null where there is none.

    A box meets the list of those that share its page and text, so each side is dealt out
    once.  Where more than ``MANY`` do, boxes are compared by cells instead (``_by_cells``);
    the list of such places has a row for each ``MANY`` annotations at most.
    """
    key = document_key(imported, existing)
    place = [*key, "page", "_text"]

    def boxes(df: DataFrame) -> DataFrame:
        return df.select("*", F.upper("content").alias("_text"), *(F.col(f"rect.{s}").alias(f"_{s}") for s in SIDES))

    new, old = boxes(imported), boxes(existing).select(*place, "annot_idx", *(f"_{s}" for s in SIDES))
    # what has no place or no edges matches nothing
    old = old.dropna(subset=[*place, *(f"_{s}" for s in SIDES)])
    spot = F.xxhash64(*place)
    many = F.broadcast(old.groupBy(spot.alias("_many")).agg(F.count("*").alias("_c")).filter(F.col("_c") > MANY).select("_many"))

    def part(df: DataFrame, kind: str) -> DataFrame:
        return df.join(many, spot == F.col("_many"), kind)

    held = part(old, "left_anti").groupBy(*place).agg(F.collect_list(F.struct(
        F.col("annot_idx").alias("i"), *(F.col(f"_{s}").alias(s) for s in SIDES))).alias("_held"))

    def near(other: Column) -> Column:
        found = F.lit(True)
        for s in SIDES:
            found = found & (F.abs(F.col(f"_{s}") - other[s]) < tolerance)
        return found

    few = part(new, "left_anti").join(held, place, "left")
    few = few.select(*imported.columns, F.array_min(F.transform(F.filter("_held", near), lambda h: h["i"])).alias("match_idx"))
    return few.unionByName(_by_cells(part(new, "left_semi"), part(old, "left_semi"), place, tolerance)
                           .select(*imported.columns, "match_idx"))


def _by_cells(new: DataFrame, old: DataFrame, place: list[str], tolerance: float) -> DataFrame:
    """The same for boxes of many copies.

    Both sides are first reduced to distinct (page, text, box), so copies of one
    box cost one candidate, and are compared within a grid of cells four tolerances
    wide: a box meets those in the cells that its reach touches, two and a quarter on average.
    """
    spots = [*place, *(f"_{s}" for s in SIDES)]
    wanted = new.select(*spots).distinct()
    size = 4 * tolerance

    def touched(c: Column) -> Column:
        return F.sequence(_cell(c - tolerance, size), _cell(c + tolerance, size))

    cells = wanted.withColumn("_cx", F.explode(touched(F.col("_x0")))).withColumn("_cy", F.explode(touched(F.col("_y0"))))
    held = old.groupBy(*spots).agg(F.min("annot_idx").alias("_idx")).select(
        *place, _cell(F.col("_x0"), size).alias("_cx"), _cell(F.col("_y0"), size).alias("_cy"), "_idx",
        *(F.col(f"_{s}").alias(f"_held_{s}") for s in SIDES))
    pairs = cells.join(held, [*place, "_cx", "_cy"])
    for s in SIDES:
        pairs = pairs.filter(F.abs(F.col(f"_{s}") - F.col(f"_held_{s}")) < tolerance)
    best = pairs.groupBy(*spots).agg(F.min("_idx").alias("match_idx"))
    return new.join(best, spots, "left")
