"""Rectangles: ``struct<x0,y0,x1,y1>`` with the origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.named_struct(F.lit("x0"), x0.cast("double"), F.lit("y0"), y0.cast("double"),
                          F.lit("x1"), x1.cast("double"), F.lit("y1"), y1.cast("double"))


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def parse_rect(text: Column) -> Column:
    """``"a,b,c,d"`` as a rectangle in the order given; null unless four numbers."""
    parts = F.transform(F.split(text, ",", -1), lambda p: F.btrim(p).try_cast("double"))
    whole = (F.size(parts) == 4) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(whole, rect(*(F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3, 4))))


def flip(r: Column, page_height: Column) -> Column:
    """Change between top and bottom origin; applying it twice gives the start."""
    return rect(r["x0"], page_height - r["y1"], r["x1"], page_height - r["y0"])


def plain_number(c: Column) -> Column:
    """A double as text without an exponent, as coordinates are written in files."""
    text = c.cast("string")
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(F.contains(text, F.lit("E")), F.coalesce(plain, text)).otherwise(text)


def rect_text(r: Column) -> Column:
    return F.concat_ws(",", *(plain_number(r[c]) for c in ("x0", "y0", "x1", "y1")))
