import random

import numpy as np
import pytest

from annolake.llm import mixing as M

POWERS = {"source": 0.6, "lang": 0.5, "topic": 0.8}


def rows(n=1500):
    rng = random.Random(8)
    out = []
    for i in range(n):
        source, lang, topic = rng.choice(["big", "big", "big", "a", "b", None]), rng.choice(["en", "en", "de"]), rng.choice(["x", "y", None])
        out.append((i, "w " * rng.randrange(0, 40), lang, source, topic, 5))
    return out + [(7777, None, "en", "a", "x", 1), (7778, "", "xx", "nowhere", "x", 1), (None, "a b c", "en", "a", "x", 1), out[0], out[0]]


SCHEMA = "doc_id long, text string, lang string, source string, topic string, rate int"


def raked(cells, powers):
    """The same fit, with numpy over a dense cube."""
    sides = [sorted({c[i] for c in cells}) for i in range(3)]
    cube = np.zeros([len(s) for s in sides])
    for c, n in cells.items():
        cube[tuple(s.index(v) for s, v in zip(sides, c))] = n
    weights = cube.copy()
    for _ in range(300):
        for axis, power in enumerate(powers):
            other = tuple(a for a in range(3) if a != axis)
            goal = cube.sum(axis=other) ** power
            goal[cube.sum(axis=other) == 0] = 0
            goal = goal / goal.sum()
            now = weights.sum(axis=other)
            factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            weights *= factor.reshape([-1 if a == axis else 1 for a in range(3)])
    return {c: weights[tuple(s.index(v) for s, v in zip(sides, c))] / n if n else None for c, n in cells.items()}


def test_rates_against_numpy(spark):
    data = rows()
    got = M.mix(spark.createDataFrame(data, SCHEMA), POWERS).collect()
    assert len(got) == len(data)
    cells = {}
    for _, t, lang, source, topic, _ in data:
        key = (source or "", lang or "", topic or "")
        cells[key] = cells.get(key, 0) + len((t or "").split())
    want = raked(cells, [POWERS[d] for d in M.DIMENSIONS])
    most = max(v for v in want.values() if v)
    for r in got:
        rate = want[r.source or "", r.lang or "", r.topic or ""]
        assert r.n_tokens == len((r.text or "").split())
        if rate is not None:
            assert r.rate == pytest.approx(rate, rel=1e-4)
            assert r.probability == pytest.approx(min(1, rate / most), rel=1e-4)
        else:
            assert r.probability >= 0


def test_a_tiny_category_does_not_set_the_scale(spark):
    """One document of 4 tokens among 1000 of 40; divided by its rate, 1 % of the tokens would be left."""
    data = [(i, "w " * 40, "en", "s", "x", 0) for i in range(1000)] + [(5000, "w " * 4, "odd", "s", "x", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    got = M.mix(df, POWERS).collect()
    total = sum(r.n_tokens for r in got)
    mixed = {lang: sum(r.n_tokens * r.copies for r in got if r.lang == lang) for lang in ("en", "odd")}
    assert sum(mixed.values()) == pytest.approx(M.BUDGET * total, rel=0.1)
    share = 4 ** 0.5 / (4 ** 0.5 + 40000 ** 0.5)
    assert mixed["odd"] == pytest.approx(share * M.BUDGET * total, abs=4)  # whole copies
    assert all(r.sampled == (r.copies > 0) for r in got)
    ids = [r.doc_id for r in M.sample(df, POWERS).collect()]
    assert sorted(ids) == sorted(r.doc_id for r in got for _ in range(r.copies))


def test_draws_follow_the_probabilities_and_repeat(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a = {(r.doc_id, r.text): r.sampled for r in M.mix(df, POWERS).collect()}
    got = M.mix(df.repartition(5), POWERS).collect()
    assert a == {(r.doc_id, r.text): r.sampled for r in got}
    assert abs(np.mean([r.sampled for r in got]) - np.mean([r.probability for r in got])) < 0.05


def test_sample_keeps_the_columns(spark):
    df = spark.createDataFrame(rows(200), SCHEMA)
    kept = M.sample(df, POWERS)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert 0 < kept.count() < df.count()


def test_topics_and_empty(spark):
    texts = ["", None, "short", "a" * 400, "A" * 400, "# " * 300, "word\n" * 100]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.topic for r in M.mix(df, POWERS).collect()}
    assert [got[i] for i in range(7)] == ["blank", "blank", "short", "prose", "capitals", "symbols", "lines"]
    assert M.mix(df.limit(0), POWERS).count() == 0
