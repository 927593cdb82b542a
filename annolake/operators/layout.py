"""Box layout: proximity groups, alignment, resizing.

Equal coordinates of a page always fall into one group, so each distinct coordinate is
looked at once, with a count, after map-side combining.  A page is one unit of work,
unless it has more than ``LARGE_PAGE`` distinct coordinates.  Such a page is cut: where
two neighbours lie further apart than the tolerance, no group of either rule reaches
across, and these gaps part it into sessions, dealt out to many tasks.  Gaps are found
between cells as wide as the tolerance, of which a page has as many as fit on it, however
many boxes it holds.  What one task holds is one unit's distinct coordinates.  Alignment
deals out pages of up to ``LARGE_PAGE`` boxes once, for both directions.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from annolake.functions.geometry import height, rect, width
from annolake.functions.metrics import STANDARD_FONT, TextMeasurer, font_from_da
from annolake.schemas import document_key
from annolake.functions.text import clean_text, header_font_size, preview, with_clean_text

PAGE = ("study_id", "doc_id", "page")


# --- skip lists ------------------------------------------------------------

def parse_skip_pages(lists: DataFrame, pages: str = "skip_pages",
                     page_count: str = "page_count") -> DataFrame:
    """One row per entry of a comma list: ``entry``, ``skip_page`` (1-based), ``valid``."""
    entries = F.filter(F.transform(F.split(pages, ","), lambda p: F.btrim(p)), lambda p: p != "")
    rows = lists.select("*", F.posexplode(entries).alias("entry_no", "entry"))
    number = F.when(F.col("entry").rlike(r"^[+-]?\d+$"), F.col("entry").try_cast("int"))
    valid = F.coalesce(number.between(1, F.col(page_count)), F.lit(False))
    return rows.select("*", F.when(valid, number).alias("skip_page"), valid.alias("valid"))


def mark_skipped(df: DataFrame, skip: DataFrame | list[int] | None, out: str,
                 keys: tuple[str, ...] | None = None) -> DataFrame:
    """Flag rows on skipped pages: a list of pages for all documents, or rows of ``keys``."""
    if skip is None:
        return df.withColumn(out, F.lit(False))
    if isinstance(skip, DataFrame):
        keys = keys or (*document_key(df, skip), "page")
        marks = skip.select(*keys).distinct().withColumn(out, F.lit(True))
        return df.join(marks, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(False)))
    return df.withColumn(out, F.col("page").isin(*skip) if skip else F.lit(False))


# --- proximity groups ------------------------------------------------------

#: Distinct coordinates from which a page is cut into sessions.
LARGE_PAGE = 10_000


def _sessions(points: DataFrame, tolerance: float) -> DataFrame:
    """``points`` (``_page``, ``_at``, …) with ``_session``: 0 on small pages, else the
    number of gaps before."""
    cell = F.floor(F.col("_at") / (tolerance if tolerance > 0 else 1.0))
    large = points.groupBy("_page").agg(F.count("*").alias("_c")).filter(F.col("_c") > LARGE_PAGE).select(F.col("_page").alias("__page"))
    cells = (points.join(large, F.col("_page").eqNullSafe(F.col("__page")), "left_semi").groupBy("_page", cell.alias("_cell"))
             .agg(F.min("_at").alias("_low"), F.max("_at").alias("_high")))
    line = Window.partitionBy("_page").orderBy("_cell")
    gap = F.col("_low") - F.lag("_high").over(line)
    # a mean may be rounded past its members: cut only where the gap leaves no doubt
    cells = cells.select("_page", "_cell", F.coalesce(gap > tolerance * (1 + 1e-9) + 1e-9, F.lit(False)).cast("int").alias("_cut"))
    cells = cells.select(F.col("_page").alias("__page"), F.col("_cell").alias("__cell"), F.sum("_cut").over(line).alias("_gaps"))
    both = F.col("_page").eqNullSafe(F.col("__page")) & cell.eqNullSafe(F.col("__cell"))
    return points.join(cells, both, "left").withColumn("_session", F.coalesce("_gaps", F.lit(0))).drop("__page", "__cell", "_gaps")


def _running_mean(sessions: DataFrame, tolerance: float) -> DataFrame:
    """Points ascending; one joins while it is within the tolerance of the open group's mean:
    a fold over each session's sorted points."""
    runs = sessions.groupBy("_page", "_session").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_n"))).alias("_points"))

    def step(state: Column, point: Column) -> Column:
        near = (state["n"] > 0) & (F.abs(point["_at"] - state["total"] / state["n"]) <= tolerance)
        opened = F.array(F.struct((state["i"] + 1).alias("i"), point["_at"].alias("start")))
        return F.struct(
            (F.when(near, state["total"]).otherwise(0.0) + point["_at"] * point["_n"]).alias("total"),
            (F.when(near, state["n"]).otherwise(0) + point["_n"]).cast("long").alias("n"), (state["i"] + 1).alias("i"),
            F.when(near, state["groups"]).otherwise(F.concat(state["groups"], opened)).alias("groups"))

    empty = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("i"),
                     F.array().cast("array<struct<i: int, start: double>>").alias("groups"))
    runs = runs.withColumn("_groups", F.aggregate("_points", empty, step, lambda state: state["groups"]))

    def sized(group: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_groups", k + 1)["i"], F.size("_points") + 1)
        points = F.slice("_points", group["i"], end - group["i"])
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"))
        sums = F.aggregate(points, none, lambda state, p: F.struct(
            (state["n"] + p["_n"]).alias("n"), (state["total"] + p["_at"] * p["_n"]).alias("total")))
        return F.struct(group["start"].alias("start"), sums.alias("sums"), points.alias("points"))

    def members(group: Column) -> Column:
        return F.transform(group["points"], lambda point: F.struct(
            point["_at"].alias("_at"), F.struct(F.lit(0).cast("long").alias("no"), group["start"].alias("at")).alias("_order"),
            group["sums"]["n"].alias("group_size"), (group["sums"]["total"] / group["sums"]["n"]).alias("group_mean")))

    kept = F.filter(F.transform("_groups", sized), lambda group: group["sums"]["n"] >= 2)
    return runs.select("_page", F.explode(F.flatten(F.transform(kept, members))).alias("_p")).select("_page", "_p.*")


def _first_fit_scan(keys: list[str], tolerance: float):
    """Points in order of first appearance; one joins the oldest group whose founder is
    within the tolerance.  Founders lie further apart than that, so only the nearest one
    on each side can be in reach: they are kept sorted, and found by bisection."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, points, founders, groups, out = None, [], [], [], []

        def close():
            for value, group in points:
                if group[2] >= 2:
                    out.append((*unit, value, group[0], group[1], group[2], group[3] / group[2]))

        def told() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=[*keys, "_at", "_no", "_founder", "group_size", "group_mean"])
            out.clear()
            return frame

        for batch in batches:
            for *key, value, n, first in zip(*(batch[k] for k in keys), batch["_at"], batch["_n"], batch["_first"]):
                if key != unit:
                    if unit is not None:
                        close()
                    unit, points, founders, groups = key, [], [], []
                place, found = bisect_left(founders, value), None
                for i in (place - 1, place):
                    if 0 <= i < len(founders) and abs(value - founders[i]) <= tolerance and (found is None or groups[i][0] < found[0]):
                        found = groups[i]
                if found is None:
                    found = [first, value, 0, 0.0]  # first appearance, founder, boxes, sum
                    founders.insert(place, value)
                    groups.insert(place, found)
                found[2] += n
                found[3] += value * n
                points.append((value, found))
            if out:
                yield told()
        if unit is not None:
            close()
        if out:
            yield told()

    return scan


def _first_fit(sessions: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    rows = sessions.select(*(F.col(f"_page.{k}").alias(k) for k in keys), "_session", "_at", "_n", "_first")
    unit = [*keys, "_session"]
    schema = rows.select(*unit, "_at", F.col("_first").alias("_no"), F.col("_at").alias("_founder"),
                         F.col("_n").alias("group_size"), F.col("_at").alias("group_mean")).schema
    scanned = (rows.repartition(*unit).sortWithinPartitions(*unit, "_first", "_at")
               .mapInPandas(_first_fit_scan(unit, tolerance), schema))
    return scanned.select(F.struct(*keys).alias("_page"), "_at", F.struct(F.col("_no").alias("no"), F.col("_founder").alias("at")).alias("_order"),
                          "group_size", "group_mean")


def proximity_groups(boxes: DataFrame, at: str, tolerance: float, method: str = "running_mean",
                     keys: tuple[str, ...] = PAGE, order: str = "annot_idx", numbered: bool = True) -> DataFrame:
    """Groups of two or more boxes per page: ``keys, at, group_start, group_size, group_mean``.

    One row per distinct coordinate that belongs to such a group; ``group_start``, its first
    or founding coordinate, tells the groups of a page apart.  ``numbered`` adds
    ``group_id``, from 0 on their page: by coordinate (``running_mean``), by their founders'
    order of appearance (``first_fit``).  Groups start further apart than the tolerance,
    so a page has no more than fit on it.
    """
    if method not in ("running_mean", "first_fit"):
        raise ValueError(f"unknown grouping {method!r}")
    keys = list(keys)
    # the page as one value, since parts of it may be null; the filter names all columns, so
    # that both readers of the points share one shuffle
    points = boxes.groupBy(F.struct(*keys).alias("_page"), F.col(at).cast("double").alias("_at")).agg(
        F.count("*").alias("_n"), F.min(order).alias("_first")).filter(
        "_at is not null and (_n > 0 or _first is not null)")
    sessions = _sessions(points, tolerance)
    members = (_running_mean(sessions, tolerance) if method == "running_mean"
               else _first_fit(sessions, keys, tolerance))
    out = [F.col("_at").alias(at), F.col("_order.at").alias("group_start"), "group_size", "group_mean"]
    if numbered:
        line = Window.partitionBy("_page").orderBy("_order")
        groups = members.select("_page", "_order").distinct().select("_page", "_order", (F.row_number().over(line) - 1).alias("group_id"))
        members = members.join(groups, ["_page", "_order"])
        out.append("group_id")
    return members.select(*(F.col(f"_page.{k}").alias(k) for k in keys), *out)


# --- alignment -------------------------------------------------------------

def _page_scan(keys: list[str], horizontal: float | None, vertical: float | None, method: str):
    """Moves of whole pages, whose boxes come one after the other: one row for each distinct
    corner that belongs to a group.  What is held is one batch and one page."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def running_mean(points, tolerance):
            total, n, found = 0.0, 0, []
            for at in sorted(points):
                c = points[at][0]
                if not n or not abs(at - total / n) <= tolerance:
                    total, n = 0.0, 0
                    found.append([at, 0, 0.0, []])
                total, n = total + at * c, n + c
                found[-1][1:3] = n, total
                found[-1][3].append(at)
            return found

        def first_fit(points, tolerance):
            founders, groups, found = [], [], []
            for at, (n, first) in sorted(points.items(), key=lambda p: (p[1][1] is not None, p[1][1] or 0, p[0])):
                place, own = bisect_left(founders, at), None
                for i in (place - 1, place):
                    # an unknown first appearance is no earlier than any
                    if 0 <= i < len(founders) and abs(at - founders[i]) <= tolerance and (own is None or groups[i][4] < own[4]):
                        own = groups[i]
                if own is None:
                    own = [at, 0, 0.0, [], math.nan if first is None else first]
                    founders.insert(place, at)
                    groups.insert(place, own)
                    found.append(own)
                own[1] += n
                own[2] += at * n
                own[3].append(at)
            return found

        def groups_of(values, ids, tolerance, apart):
            """Coordinate -> number, start and mean of its group of two boxes or more.

            ``apart``: boxes without a page have no order, so first fit groups equal ones only.
            """
            points = {}
            for at, first in zip(values, ids):
                if at is None:
                    continue
                point = points.get(at)
                if point is None:
                    points[at] = [1, first]
                else:
                    point[0] += 1
                    if first is not None and (point[1] is None or first < point[1]):
                        point[1] = first
            found = (running_mean if method == "running_mean" else first_fit)(points, -1.0 if apart else tolerance)
            out, number = {}, 0
            for start, n, total, members, *_ in found:
                if n >= 2:
                    told = (number, start + 0.0, total / n)  # no negative zero, as grouping gives none
                    number += 1
                    for at in members:
                        out[at] = told
            return out

        def moves(batch, starts):
            ids, ys, xs = (batch.column(c).to_pylist() for c in ("annot_idx", "_y", "_x"))
            none, rows, h_out, v_out = (None, None, None), [], [], []
            apart = np.zeros(batch.num_rows, dtype=bool)
            for k in keys if method == "first_fit" else ():
                if pa.types.is_integer(batch.schema.field(k).type):
                    apart |= np.asarray(pc.is_null(batch.column(k)))
            for low, high in zip(starts, [*starts[1:], batch.num_rows]):
                if high - low < 2:
                    continue
                page_ids, page_ys, page_xs = ids[low:high], ys[low:high], xs[low:high]
                h = {} if horizontal is None else groups_of(page_ys, page_ids, horizontal, apart[low])
                v = {} if vertical is None else groups_of(page_xs, page_ids, vertical, apart[low])
                if not h and not v:
                    continue
                seen = set()
                for i, corner in enumerate(zip(page_ys, page_xs), low):
                    by_h, by_v = h.get(corner[0], none), v.get(corner[1], none)
                    if (by_h is not none or by_v is not none) and corner not in seen:
                        seen.add(corner)
                        rows.append(i)
                        h_out.append(by_h)
                        v_out.append(by_v)
            taken = batch.select([*keys, "_y", "_x"]).take(pa.array(rows, pa.int64()))
            added = [pa.array([r[k] for r in side], pa.int32() if k == 0 else pa.float64()) for side in (h_out, v_out) for k in range(3)]
            return pa.RecordBatch.from_arrays([*taken.columns, *added], names=[*taken.schema.names, *(
                f"{p}_{c}" for p in "hv" for c in ("group", "start", "mean"))])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            held, n = table.to_batches()[0], table.num_rows
            differs = np.zeros(n - 1, dtype=bool)
            for k in keys:
                one, other = held.column(k).slice(1), held.column(k).slice(0, n - 1)
                same = pc.or_(pc.fill_null(pc.equal(one, other), False), pc.and_(pc.is_null(one), pc.is_null(other)))
                differs |= ~np.asarray(same)
            starts = [0, *(np.flatnonzero(differs) + 1).tolist()]
            if len(starts) > 1:
                yield moves(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield moves(held, [0])

    return scan


def _moves(pool: DataFrame, keys: tuple[str, ...], horizontal: float | None, vertical: float | None,
           method: str, numbered: bool) -> DataFrame:
    """``keys, _y, _x`` of corners in groups, with ``group, start, mean`` of both directions.

    Pages of up to ``LARGE_PAGE`` boxes are dealt out whole and take one pass; larger ones go
    through ``proximity_groups``, which parts them.  Their list has a row for each
    ``LARGE_PAGE`` boxes at most; a page that only shares its hash goes with them unharmed.
    """
    keys = list(keys)
    page = F.xxhash64(*keys)
    large = pool.groupBy(page.alias("_large")).agg(F.count("*").alias("_c")).filter(F.col("_c") > LARGE_PAGE).select("_large")
    large = F.broadcast(large)
    small = pool.join(large, page == F.col("_large"), "left_anti")
    rest = pool.join(large, page == F.col("_large"), "left_semi")
    spots = rest.select(*keys, "_y", "_x").distinct()
    schema = spots.select("*", *(F.lit(None).cast(kind).alias(f"{p}_{c}") for p in "hv"
                                 for c, kind in (("group", "int"), ("start", "double"), ("mean", "double")))).schema
    whole = (small.select(*keys, "annot_idx", "_y", "_x").repartition(*keys).withColumn("_hash", page)
             .sortWithinPartitions("_hash", *keys).drop("_hash")
             .mapInArrow(_page_scan(keys, horizontal, vertical, method), schema))
    for prefix, at, tolerance in (("h", "_y", horizontal), ("v", "_x", vertical)):
        if tolerance is None:
            spots = spots.select("*", *(F.lit(None).cast(kind).alias(f"{prefix}_{c}")
                                        for c, kind in (("group", "int"), ("start", "double"), ("mean", "double"))))
            continue
        groups = proximity_groups(rest, at, tolerance, method, tuple(keys), numbered=numbered)
        number = F.col("group_id") if numbered else F.lit(None)
        groups = groups.select(*keys, at, number.cast("int").alias(f"{prefix}_group"),
                               F.col("group_start").alias(f"{prefix}_start"), F.col("group_mean").alias(f"{prefix}_mean"))
        on = [spots[k].eqNullSafe(groups[k]) for k in keys] + [spots[at] == groups[at]]
        spots = spots.join(groups, on, "left").select(*(spots[c] for c in spots.columns),
                                                      *(f"{prefix}_{c}" for c in ("group", "start", "mean")))
    return whole.unionByName(spots)


def _far(shift: Column, method: str) -> Column:
    # the two rules differ on a shift of exactly half a point
    return shift >= 0.5 if method == "running_mean" else shift > 0.5


def align(annotations: DataFrame, horizontal_tolerance: float = 10.0,
          vertical_tolerance: float = 10.0, horizontal: bool = True, vertical: bool = True,
          method: str = "running_mean", skip=None, keys: tuple[str, ...] = PAGE,
          numbered: bool = True, pool: DataFrame | None = None) -> DataFrame:
    """Move boxes to their group's mean: top edges along rows, left edges along columns.

    ``running_mean`` takes all annotations, ``first_fit`` FreeText only.  Adds
    ``h_group, h_start, h_mean, h_moved``, the same with ``v_``, and ``aligned`` (the new
    rectangle, size kept); groups have numbers where ``numbered``, for reports.  ``pool`` are the boxes that make the
    groups, the same ones by default; whoever has them before costly steps saves repeating these.  The two directions read different coordinates,
    so neither waits for the other; the vertical move starts from the
    horizontal result.
    """
    def corners(boxes: DataFrame) -> DataFrame:
        return mark_skipped(boxes.withColumn("_y", F.col("rect.y0")).withColumn("_x", F.col("rect.x0")), skip, "_skip")

    df = corners(annotations)
    taking = ~F.col("_skip")
    if method == "first_fit":
        taking = taking & (F.col("type") == "FreeText")
    # both directions read the corners as they came, so one join brings both moves
    if horizontal or vertical:
        pool = (df if pool is None else corners(pool)).filter(taking).select(*keys, "annot_idx", "_y", "_x")
        moves = _moves(pool, keys, horizontal_tolerance if horizontal else None,
                       vertical_tolerance if vertical else None, method, numbered)
        # the corners differ most, so the join sorts by them first
        on = [df[c].eqNullSafe(moves[c]) for c in ("_y", "_x", *reversed(keys))]
        df = df.join(moves, on, "left").select(*(df[c] for c in df.columns), *(
            f"{p}_{c}" for p in "hv" for c in ("group", "start", "mean")))
    else:
        none = F.lit(None)
        df = df.select("*", *(none.cast("int" if c == "group" else "double").alias(f"{p}_{c}") for p in "hv" for c in ("group", "start", "mean")))
    for prefix, at in (("h", "_y"), ("v", "_x")):
        shift = F.abs(F.col(at) - F.col(f"{prefix}_mean"))
        df = df.withColumn(f"{prefix}_moved", F.coalesce(taking & _far(shift, method), F.lit(False)))
        if not numbered:
            df = df.withColumn(f"{prefix}_group", F.lit(None).cast("int"))
    box = F.col("rect")
    y0 = F.when(F.col("h_moved"), F.col("h_mean")).otherwise(box["y0"])
    y1 = F.when(F.col("h_moved"), F.col("h_mean") + height(box)).otherwise(box["y1"])
    x0 = F.when(F.col("v_moved"), F.col("v_mean")).otherwise(box["x0"])
    x1 = F.when(F.col("v_moved"), F.col("v_mean") + width(box)).otherwise(box["x1"])
    return df.withColumn("aligned", rect(x0, y0, x1, y1)).drop("_x", "_y", "_skip")


def alignment_operations(aligned: DataFrame, content: str = "content") -> DataFrame:
    """One row per move, horizontal before vertical, as a dry run reports them."""
    box, new = F.col("rect"), F.col("aligned")
    between = rect(box["x0"], new["y0"], box["x1"], new["y1"])
    moves = F.array_compact(F.array(
        F.when(F.col("h_moved"), F.struct(
            F.lit("horizontal").alias("alignment_type"), F.col("h_group").alias("group_id"),
            box.alias("old_rect"), between.alias("new_rect"))),
        F.when(F.col("v_moved"), F.struct(
            F.lit("vertical").alias("alignment_type"), F.col("v_group").alias("group_id"),
            between.alias("old_rect"), new.alias("new_rect")))))
    keys = [c for c in ("study_id", "doc_id", "page", "annot_idx") if c in aligned.columns]
    return aligned.filter("h_moved or v_moved").select(
        *keys, preview(clean_text(F.col(content)), 30).alias("content_preview"),
        F.explode(moves).alias("_m")).select(*keys, "content_preview", "_m.*")


def alignment_totals(aligned: DataFrame, by: tuple[str, ...] | None = None) -> DataFrame:
    """Boxes, groups and moves in each direction.  A page's groups are counted once.

    ``by``: one row for each of these, each document by default."""
    key = document_key(aligned)
    by = key if by is None else by
    pages = aligned.groupBy(*dict.fromkeys([*by, *key, "page"]), "h_start", "v_start").agg(
        F.count("*").alias("n"), F.count_if("h_moved").alias("h"), F.count_if("v_moved").alias("v"))
    spot = [*(F.col(c) for c in key), F.col("page")]
    return pages.groupBy(*by).agg(
        F.sum("n").alias("total_annotations"),
        F.countDistinct(F.when(F.col("h_start").isNotNull(), F.struct(*spot, "h_start")))
        .alias("horizontal_groups"),
        F.countDistinct(F.when(F.col("v_start").isNotNull(), F.struct(*spot, "v_start")))
        .alias("vertical_groups"),
        F.sum("h").alias("horizontal_aligned"), F.sum("v").alias("vertical_aligned"))


# --- resizing --------------------------------------------------------------

def resize(annotations: DataFrame, variant: str = "export", measurer: TextMeasurer = TextMeasurer(),
           content: str = "content", box: str = "rect", expand_width: bool = True,
           expand_height: bool = True, max_width: float | None = 200.0,
           max_height: float | None = 300.0, skip=None, font_size: Column | None = None,
           cleaned: bool = False) -> DataFrame:
    """Fit boxes to their texts; adds ``resized`` (rectangle), ``checked`` and ``changed``.

    ``box``      the box's own font; a side may shrink, growth is capped
    ``standard`` the standard font, sides never shrink, growth is capped
    ``export``   the standard font, width only: the larger of present and needed
                 plus five points, when that differs by more than one point
    """
    r = F.col(box)
    old_w, old_h = width(r), height(r)
    df = mark_skipped(annotations, skip, "_skip")
    df = df.withColumn("_text", F.col(content)) if cleaned else with_clean_text(df, content, "_text")
    text = F.col("_text")
    free = (F.col("type") == "FreeText") & ~F.col("_skip")
    filled = F.coalesce(F.length(text) > 0, F.lit(False))
    size = font_size if font_size is not None else header_font_size(text).cast("double")
    line = F.col("_line")
    if variant == "export":
        df = df.withColumn("_line", measurer.width(text, STANDARD_FONT, size))
        df = df.withColumn("_need", measurer.optimal(text, STANDARD_FONT, size, line=line))
        new_w = F.greatest(old_w, F.col("_need.width")) + 5
        df = df.withColumn("_checked", free & filled).withColumn(
            "_changed", F.col("_checked") & (F.abs(new_w - old_w) > 1))
        return _resized(df, r, new_w, old_h)
    if variant == "box":
        font = font_from_da(F.col("da"))
        df = df.withColumn("_font", font)
        name, size = F.col("_font.name"), F.col("_font.size")
    elif variant == "standard":
        name = STANDARD_FONT
    else:
        raise ValueError(f"unknown resize variant {variant!r}")
    if not (expand_width or expand_height):
        df = df.withColumn("_checked", free).withColumn("_changed", F.lit(False))
        return _resized(df, r, old_w, old_h)
    keep_width = variant == "box" and not expand_width
    df = df.withColumn("_line", measurer.width(text, name, size))
    df = df.withColumn("_fits", measurer.fits(text, name, size, old_w, old_h, line))
    df = df.withColumn("_need", measurer.optimal(text, name, size, old_w if keep_width else None,
                                                 line))

    def grown(old: Column, need: Column, cap: float | None, wanted: bool) -> Column:
        if not wanted:
            return old
        more = need - old if cap is None else F.least(need - old, F.lit(float(cap)))
        return old + (F.greatest(F.lit(0.0), more) if variant == "standard" else more)

    new_w = grown(old_w, F.col("_need.width"), max_width, expand_width)
    new_h = grown(old_h, F.col("_need.height"), max_height, expand_height)
    moved = (F.abs(new_w - old_w) >= 1.0) | (F.abs(new_h - old_h) >= 1.0)
    # the box variant counts blank boxes as checked, the standard one does not
    df = df.withColumn("_checked", free if variant == "box" else free & filled)
    df = df.withColumn("_changed", free & filled & ~F.col("_fits") & moved)
    return _resized(df, r, new_w, new_h)


def _resized(df: DataFrame, r: Column, new_w: Column, new_h: Column) -> DataFrame:
    changed = F.coalesce("_changed", F.lit(False))
    # built edge by edge, so that a later step that reads one corner skips the rest
    new = rect(r["x0"], r["y0"], F.when(changed, r["x0"] + new_w).otherwise(r["x1"]),
               F.when(changed, r["y0"] + new_h).otherwise(r["y1"]))
    df = df.withColumn("resized", new).withColumn("checked", F.coalesce("_checked", F.lit(False)))
    df = df.withColumn("changed", changed)
    return df.drop("_skip", "_text", "_line", "_need", "_fits", "_font", "_checked", "_changed")


def resize_operations(resized: DataFrame, box: str = "rect", content: str = "content") -> DataFrame:
    old, new = F.col(box), F.col("resized")
    keys = [c for c in ("study_id", "doc_id", "page", "annot_idx") if c in resized.columns]
    font = font_from_da(F.col("da"))
    return resized.filter("changed").select(
        *keys, preview(clean_text(F.col(content)), 50).alias("content_preview"),
        old.alias("old_rect"), new.alias("new_rect"),
        width(old).alias("old_width"), height(old).alias("old_height"),
        width(new).alias("new_width"), height(new).alias("new_height"),
        font["name"].alias("fontname"), font["size"].alias("fontsize"))


def resize_totals(resized: DataFrame, by: tuple[str, ...] | None = None) -> DataFrame:
    free = F.col("type") == "FreeText"
    return resized.groupBy(*(document_key(resized) if by is None else by)).agg(
        F.count("*").alias("total_annotations"), F.count_if(free).alias("freetext_annotations"),
        F.count_if("checked").alias("checked"), F.count_if("changed").alias("resized"),
        F.count_if(F.col("checked") & ~F.col("changed")).alias("skipped"))


# --- text reports ----------------------------------------------------------

def _one_place(c: Column) -> Column:
    return F.replace(F.format_number(c, 1), F.lit(","), F.lit(""))


def alignment_report(operations: DataFrame) -> DataFrame:
    """Report lines, sorted by ``page, alignment_type, annot_idx`` within a document."""
    how = F.when(F.col("alignment_type") == "horizontal", "horizontally").otherwise("vertically")
    old, new = F.col("old_rect"), F.col("new_rect")
    keys = [c for c in ("study_id", "doc_id", "page", "alignment_type", "annot_idx")
            if c in operations.columns]
    return operations.select(*keys, F.concat(
        F.lit("Page "), F.col("page").cast("string"), F.lit(" [Group "),
        F.col("group_id").cast("string"), F.lit("]: '"), F.col("content_preview"),
        F.lit("' aligned "), how, F.lit(" ("), _one_place(old["x0"]), F.lit(", "),
        _one_place(old["y0"]), F.lit(") -> ("), _one_place(new["x0"]), F.lit(", "),
        _one_place(new["y0"]), F.lit(")")).alias("line"))


def resize_report(operations: DataFrame) -> DataFrame:
    keys = [c for c in ("study_id", "doc_id", "page", "annot_idx") if c in operations.columns]
    return operations.select(*keys, F.concat(
        F.lit("Page "), F.col("page").cast("string"), F.lit(": '"), F.col("content_preview"),
        F.lit("' ["), F.col("fontname"), F.lit(" "), F.col("fontsize").cast("string"),
        F.lit("pt] ("), _one_place(F.col("old_width")), F.lit("x"),
        _one_place(F.col("old_height")), F.lit(") -> ("), _one_place(F.col("new_width")),
        F.lit("x"), _one_place(F.col("new_height")), F.lit(")")).alias("line"))


REPORT_ORDER = ("study_id", "doc_id", "section", "page", "part", "annot_idx", "line_no")


def _report(df: DataFrame, section: int, texts: Column, page: Column | None = None,
            part: Column | None = None, idx: Column | None = None) -> DataFrame:
    zero = F.lit(0)
    return df.select(
        *document_key(df), F.lit(section).alias("section"),
        (zero if page is None else page).cast("int").alias("page"),
        (zero if part is None else part).cast("int").alias("part"),
        (F.lit(-1) if idx is None else idx).cast("long").alias("annot_idx"),
        F.posexplode(texts).alias("line_no", "line"))


def _frame(totals: DataFrame, title: str, heading: str, changed: Column, figures) -> DataFrame:
    bar, rule = F.lit("=" * 80), F.lit("-" * 80)
    summary = F.concat(F.lit("Summary: "), F.concat_ws(", ", *(
        F.concat(F.lit(f"{label}: "), value.cast("string")) for label, value in figures)))
    head = F.array(bar, F.lit(title), bar, F.lit(""), summary, F.lit(""))
    with_list = F.concat(head, F.array(F.lit(heading), rule))
    foot = F.when(changed, F.array(F.lit(""), bar)).otherwise(F.array(bar))
    return _report(totals, 0, F.when(changed, with_list).otherwise(head)).unionByName(
        _report(totals, 2, foot))


def alignment_report_lines(aligned: DataFrame) -> DataFrame:
    """Each document's alignment report as lines to be sorted by ``REPORT_ORDER``."""
    totals, operations = alignment_totals(aligned), alignment_operations(aligned)
    part = F.when(F.col("alignment_type") == "horizontal", 1).otherwise(2)
    counts = operations.groupBy(*document_key(operations), "page", part.alias("_part")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("_part") == 1, "Horizontal").otherwise("Vertical")
    figures = [(label, F.col(c)) for label, c in (
        ("Total annotations", "total_annotations"), ("Horizontal groups", "horizontal_groups"),
        ("Vertical groups", "vertical_groups"), ("Horizontal aligned", "horizontal_aligned"),
        ("Vertical aligned", "vertical_aligned"))] + [("Errors", F.lit(0))]
    moved = F.col("horizontal_aligned") + F.col("vertical_aligned") > 0
    pages = operations.select(*document_key(operations), "page").distinct()
    page_head = F.array(F.lit(""), F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(":")))
    return (
        _frame(totals, "ANNOTATION ALIGNMENT REPORT", "Alignment Operations:", moved, figures)
        .unionByName(_report(pages, 1, page_head, F.col("page")))
        .unionByName(_report(counts, 1, F.array(F.concat(
            F.lit("  "), kind, F.lit(" alignments: "), F.col("n").cast("string"))),
            F.col("page"), F.col("_part")))
        .unionByName(_report(alignment_report(operations), 1, F.array(F.concat(
            F.lit("    "), "line")), F.col("page"), part, F.col("annot_idx"))))


def resize_report_lines(resized: DataFrame) -> DataFrame:
    """Each document's resize report as lines to be sorted by ``REPORT_ORDER``."""
    figures = [(label, F.col(c)) for label, c in (
        ("Total annotations", "total_annotations"), ("FreeText", "freetext_annotations"),
        ("Checked", "checked"), ("Resized", "resized"), ("Skipped", "skipped"))]
    frame = _frame(resize_totals(resized), "ANNOTATION RESIZE REPORT", "Resize Operations:",
                   F.col("resized") > 0, [*figures, ("Errors", F.lit(0))])
    lines = resize_report(resize_operations(resized))
    return frame.unionByName(_report(lines, 1, F.array("line"), F.col("page"), F.lit(0),
                                     F.col("annot_idx")))
