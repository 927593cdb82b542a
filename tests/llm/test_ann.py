import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from annolake.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k):
    good = {(i, tuple(v)) for i, v, _ in rows if i is not None and v is not None and None not in v
            and all(map(math.isfinite, v)) and any(v) and len(v) == 8}
    out = {}
    for i, v in good:
        if i % 20 == 0:
            near = sorted((-math.fsum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)[:k]
            out[i] = [(r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return out


def rows(n):
    rng = np.random.default_rng(1)
    out = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * rng.uniform(0.1, 3)], 1) for i in range(n)]
    out += [(n + i, out[7][1], 1) for i in range(100)]  # copies, some of them queries
    out += [(5000, None, 1), (5020, [0.0] * 8, 1), (5040, [float("nan")] + [1.0] * 7, 1), (5060, [None] + [1.0] * 7, 1),
            (5080, [float("inf")] * 8, 1), (5100, [1.0] * 3, 1), (None, [1.0] * 8, 1), (5120, [], 1), out[20], out[20]]
    return out


@pytest.mark.parametrize("n", [5, 300])
def test_all_within_a_window_is_exact(spark, n):
    data = rows(n) if n > 10 else rows(300)[:n]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = {}
    for r in A.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == brute(data, 20)


def test_recall_with_blocks_and_margins(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(1500)]
    monkeypatch.setattr(A, "BLOCK", 256)
    got = A.nearest(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0, k=5, window=100).collect()
    want = {(q, j) for q, near in brute(data, 5).items() for _, j, _ in near}
    assert len(got) == len(want)
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)


@pytest.mark.parametrize("block", [64, 8192])
def test_windows_grow_until_the_recall_is_met(spark, monkeypatch, block):
    """Windows of 4 places on 3 curves hold a fraction of the neighbours of 1500 points."""
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(1500)]
    monkeypatch.setattr(A, "BLOCK", block)
    df = spark.createDataFrame(data, SCHEMA)
    want = {(q, j) for q, near in brute(data, 5).items() for _, j, _ in near}
    share = lambda rows: len(want & {(r.query_id, r.vec_id) for r in rows}) / len(want)
    # as many probes as queries: the measured recall is the whole one
    assert share(A.nearest(df, F.col("vec_id") % 20 == 0, k=5, curves=3, window=4).collect()) >= 0.9
    if block == 64:
        assert share(A.nearest(df, F.col("vec_id") % 20 == 0, k=5, curves=3, window=4, recall=0.0).collect()) < 0.5


def test_empty(spark):
    assert A.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert A.nearest(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), F.lit(True)).count() == 0


@pytest.mark.parametrize("d, bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_visits_neighbouring_cells(d, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
    path = cells[np.argsort(A.hilbert(cells, bits))]
    assert len(np.unique(A.hilbert(cells, bits))) == len(cells)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
