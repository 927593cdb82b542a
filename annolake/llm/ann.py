"""Approximate nearest neighbours by inner product: shifted space-filling curves.

1. Equal vectors are folded into one point with their smallest ids, ``k`` + 1 of them,
   which is all that any answer can name.
2. Points are laid on the unit sphere (one more coordinate makes up for their length,
   so that the nearest direction is the largest inner product), rotated at random and
   projected to a few dimensions, once for each of ``CURVES`` curves.  Each projection is
   shifted at random, cut into a grid and ordered along its Hilbert curve.
3. All curves are range-partitioned and sorted in one pass; places along them are exact.
4. ``PROBES`` queries are compared with every point.  Where their true neighbours lie on
   the curves says which recall a window gives; it is widened from ``WINDOW`` until that
   is ``RECALL``, less two standard errors, whatever the table's size.
5. Blocks of places go to a task each, and every query to all blocks that its window
   touches, where it meets the places within the window before and after its own.
6. Each curve gives a query's best points; those of all curves are merged, and scores
   are summed anew without rounding errors from the original vectors.

Rotations and the grid's bounds come from a fixed seed and a sample of ``SAMPLE``
vectors; every vector is indexed.  On nearly independent dimensions the window grows
with the table, since no curve keeps their neighbours together.

Vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do those without an id or of another length than the commonest.  Rows that repeat
an id and a vector count once.  Ties go to the smaller id.  Extra columns are ignored;
an empty table gives no rows; with fewer than ``k`` others, all of them are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from annolake.llm.common import pieces, written
from annolake.session import small_table

CURVES, WINDOW, DIMENSIONS, KEY_BITS = 16, 2048, 16, 64
RECALL, PROBES = 0.9, 128
#: Places in a block: twice the window, between these; scores that a task holds at a time.
BLOCK, LARGEST_BLOCK, SCORES = 8192, 32768, 1 << 21
SAMPLE = 4096
SEED = 8


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of grid cells (n x d, ``bits`` each) along the Hilbert curve, d * bits <= 64.

    The public method of turning axes into the transposed index (gray code), all rows
    at a time; the result is mapped to signed numbers of the same order."""
    x = cells.T.astype(np.uint32).copy()
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = np.uint32(level - 1)
        for i in range(d):
            high = (x[i] & np.uint32(level)) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        level >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where(x[d - 1] & np.uint32(level), flip ^ np.uint32(level - 1), flip)
        level >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << np.uint64(1) | ((x[i] >> np.uint32(bit)) & np.uint32(1)).astype(np.uint64)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


class Curves:
    """Rotations, shifts and grid bounds of all curves."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int):
        rng = np.random.default_rng(SEED)
        self.longest = longest
        width = sample.shape[1] + 1
        self.d = min(DIMENSIONS, width)
        self.bits = min(16, KEY_BITS // self.d)
        self.turns = [np.linalg.qr(rng.normal(size=(width, width)))[0][:, :self.d] for _ in range(curves)]
        self.shifts = rng.uniform(0, 0.5, size=(curves, self.d))
        lifted = self.lift(sample, False)
        self.bounds = [np.quantile(lifted @ t, [0.001, 0.999], axis=0) for t in self.turns]

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / (length if query else self.longest)
        rest = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(0, 1 - (length / self.longest) ** 2))
        return np.concatenate([x, rest], axis=1)

    def keys(self, x: np.ndarray, query: bool) -> Iterator[np.ndarray]:
        lifted, cells = self.lift(x, query), 1 << self.bits
        for turn, shift, (low, high) in zip(self.turns, self.shifts, self.bounds):
            place = (lifted @ turn - low) / np.maximum(high - low, 1e-300) * 0.5 + shift
            yield hilbert(np.clip(place * cells, 0, cells - 1).astype(np.uint32), self.bits)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _keyed(curves: Curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for query in (False, True):
                rows = batch.filter(batch.column(1)) if query else batch
                if not rows.num_rows:
                    continue
                for number, key in enumerate(curves.keys(_matrix(rows.column(2)), query)):
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, number, np.int32)), pa.array(key), rows.column(0),
                         pa.array(np.full(n, query)), rows.column(2)], ["curve", "key", "id", "query", "vector"])
    return run


def _compared(ids: np.ndarray, asked: np.ndarray, k: int):
    """The ``k`` best others of a few points, among all points of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, found = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            rough = asked @ _matrix(batch.column(1)).T
            rough[ids[:, None] == own[None, :]] = -np.inf
            score = np.concatenate([score, rough], axis=1)
            found = np.concatenate([found, np.broadcast_to(own, rough.shape)], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, found = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
        real = np.isfinite(score)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, score.shape[1])[real.ravel()]), pa.array(found[real]),
                                          pa.array(score[real])], ["asked", "id", "rough"])
    return run


def wide_enough(points: DataFrame, placed: DataFrame, k: int, window: int, recall: float, probes: int = PROBES) -> int:
    """The window, ``window`` at least, at which the probes' lists have the recall."""
    some = points.filter("query").select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(probes).toArrow()
    if not some.num_rows:
        return window
    ids, asked = some.column(0).to_numpy(), _matrix(some.column(1).combine_chunks())
    by_score = Window.partitionBy("asked").orderBy(F.desc("rough"), "id")
    true = written(points.select("id", "vector").mapInArrow(_compared(ids, asked, k), "asked long, id long, rough double")
                   .withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k).select("asked", "id"), "true")
    seen = placed.select("curve", "place", "id", "query")
    own = seen.filter("query").join(true.select(F.col("asked").alias("id")).distinct(), "id").select(
        "curve", F.col("id").alias("asked"), F.col("place").alias("own"))
    far = (seen.filter(~F.col("query")).join(true, "id").join(own, ["asked", "curve"])
           .groupBy("asked", "id").agg(F.min(F.abs(F.col("place") - F.col("own"))).alias("far")).toArrow())
    if not far.num_rows:
        return window
    of, far = np.unique(far.column("asked").to_numpy(), return_inverse=True)[1], far.column("far").to_numpy()
    while True:
        shares = np.bincount(of, far <= window) / np.bincount(of)
        if shares.mean() - 2 * shares.std() / len(shares) ** 0.5 >= recall or (far <= window).all():
            return window
        window += max(1, window // 8)


def _search(k: int, window: int, slice_: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("place")
        place, curve, ids, query = (table.column(c).to_numpy() for c in ("place", "curve", "id", "query"))
        vectors = _matrix(table.column("vector").combine_chunks())
        points = np.flatnonzero(~query)
        asked = np.flatnonzero(query)
        out = []
        for at in range(0, len(asked), slice_):
            rows = asked[at:at + slice_]
            low, high = np.searchsorted(place, [place[rows[0]] - window, place[rows[-1]] + window + 1])
            near = points[np.searchsorted(points, low):np.searchsorted(points, high)]
            if not len(near):
                continue
            scores = vectors[rows] @ vectors[near].T
            far = ((np.abs(place[near][None, :] - place[rows][:, None]) > window)
                   | (curve[near][None, :] != curve[rows][:, None]))
            scores[far] = -np.inf
            keep = min(k, len(near))
            best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            value = np.take_along_axis(scores, best, 1)
            out.append((np.repeat(ids[rows], keep), ids[near][best].ravel(), value.ravel()))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        found = np.isfinite(columns[2])
        return pa.table({n: c[found] for n, c in zip(("asked", "id", "rough"), columns)})
    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        products = _matrix(batch.column(2)) * _matrix(batch.column(3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fsum(p) for p in products], pa.float64())],
                                         ["asked", "id", "score"])


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part."""
    x = F.col("vector")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = (vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
            .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine))
    length = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.filter(F.size("vector") == (length.n if length else 0))


def nearest(vectors: DataFrame, queries, k: int = 20, curves: int = CURVES, window: int = WINDOW,
            id_: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest others of each row that
    ``queries`` (a condition on vec_id) names.  ``window`` is the least one;
    with a ``recall`` of 0 it is not widened."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_, vector).distinct(), "vectors")
    order = Window.partitionBy("vector").orderBy("vec_id")
    some = written(rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
                   .withColumn("id", F.first("vec_id").over(order)), "twins")
    asked_by = written(rows.filter(queries).join(some.filter("n = 1").select("id", "vector"), "vector").select("vec_id", "id"), "asked")
    asks = asked_by.select("id").distinct().withColumn("query", F.lit(True))
    points = written(some.filter("n = 1").select("id", "vector").join(asks, "id", "left")
                     .select("id", F.coalesce("query", F.lit(False)).alias("query"), "vector"), "points")
    sample = points.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    result = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], result)
    longest = points.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)))).first()[0]
    laid = Curves(_matrix(sample.column(0).combine_chunks()), longest, curves)

    keyed = points.mapInArrow(_keyed(laid), "curve int, key long, id long, query boolean, vector array<double>")
    sorted_ = written(keyed.repartitionByRange(max(pieces(spark), curves), "curve", "key", "id")
                      .sortWithinPartitions("curve", "key", "id", "query")
                      .withColumn("row", F.monotonically_increasing_id()), "curves")
    part, within = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    starts, total = [], 0
    for r in sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        starts.append((r.part, total))
        total += r.n
    placed = sorted_.withColumn("part", part).join(small_table(spark, starts, "part long, start long"), "part").withColumn(
        "place", F.col("start") + within)
    window = wide_enough(points, placed, k, window, recall)
    size = max(BLOCK, min(2 * window, LARGEST_BLOCK))
    reach = F.when(F.col("query"), F.lit(window)).otherwise(F.lit(0))
    blocks = F.sequence(F.floor(F.greatest(F.lit(0), F.col("place") - reach) / size),
                        F.floor(F.least(F.lit(total - 1), F.col("place") + reach) / size))
    found = (placed.select("curve", "place", "id", "query", "vector", F.explode(blocks).alias("block"))
             .groupBy("block").applyInArrow(_search(k + 1, window, max(1, SCORES // size)), "asked long, id long, rough double"))
    merged = found.groupBy("asked", "id").agg(F.max("rough").alias("rough"))
    best = Window.partitionBy("asked").orderBy(F.desc("rough"), "id")
    kept = (merged.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("asked", "id")
            .unionByName(asks.select(F.col("id").alias("asked"), "id")).distinct())
    vector_of = points.select("id", "vector")
    scored = (kept.join(vector_of, "id").join(vector_of.select(F.col("id").alias("asked"), F.col("vector").alias("own")), "asked")
              .select("asked", "id", "vector", "own").mapInArrow(_exact, "asked long, id long, score double"))
    by_score = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    named = (scored.join(some.select("id", "vec_id"), "id").withColumn("n", F.row_number().over(by_score))
             .filter(F.col("n") <= k + 1).select("asked", "vec_id", "score"))
    answers = asked_by.select(F.col("vec_id").alias("query_id"), F.col("id").alias("asked")).join(named, "asked")
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id"))
    return (answers.filter("vec_id <> query_id").withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
