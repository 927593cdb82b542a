import math
from collections import Counter

import pytest

from annolake.llm import lm

ROWS = [(1, "the cat sat on the mat"), (2, "The CAT sat"), (3, None), (4, ""), (5, "the cat ran"), (6, "x"), (6, "the end"),
        (None, "the cat sat"), (7, "the " * 3000 + "cat"), (8, "the cat sat on the mat"), (8, "the cat sat on the mat")]


def brute(rows, least=lm.MIN_COUNT, backoff=lm.BACKOFF):
    texts = [(d, (t or "").encode().lower().split()) for d, t in rows]
    one = Counter(w for _, t in texts for w in t)
    start = sum(bool(t) for _, t in texts)
    two = Counter(p for _, t in texts for p in zip([None, *t], t))
    out = {}
    for d, t in texts:
        n, s = out.get(d, (0, 0.0))
        for u, w in zip([None, *t], t):
            seen = two[u, w]
            s += math.log(seen / (one[u] if u else start)) if seen >= least else math.log(backoff * one[w] / sum(one.values()))
        out[d] = (n + len(t), s)
    return {d: v for d, v in out.items() if d is not None}


@pytest.mark.parametrize("hot", [lm.HOT, 1, 4])
@pytest.mark.parametrize("least", [1, 2, 4])
def test_against_brute_force(spark, monkeypatch, hot, least):
    monkeypatch.setattr(lm, "HOT", hot)
    df = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, word int").repartition(3)
    got = {r.doc_id: (r.n_words, r.log_score) for r in lm.score(df, least).collect()}
    want = brute(ROWS, least)
    assert got.keys() == want.keys()
    for d in want:
        assert got[d] == pytest.approx(want[d])


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert tuple(lm.score(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()) == (1, 0, 0.0)
