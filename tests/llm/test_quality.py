import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from annolake.llm import quality as Q


def corpus(n=600):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 200))]
        good = rng.random() < 0.7
        if not good:
            words = rng.choice([lambda w: [w[0]] * len(w), lambda w: [x.upper() + "!!" for x in w], lambda w: [x + "###" for x in w]])(words)
        out.append((i, " ".join(words) + ".", int(good)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "no id", "x"), (9999, None, "x"), (0, "", "x")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(1, None), (None, 1), (2, rows[2][2])], "doc_id long, label int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {i: g for i, _, g in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth and r.text]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = Q.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert [r.score for r in Q.classify(docs, none).collect()] == [0.5, 0.5]
    assert Q.classify(docs.limit(0), none).count() == 0
    one_kind = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int")
    assert all(r.predicted == 1 for r in Q.classify(docs, one_kind).collect())


def test_sample_is_bounded_and_repeatable(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, label int")
    a, b = (Q.train(df, labels, 100) for df in (docs, docs.repartition(7)))
    assert np.array_equal(a.leaf, b.leaf) and np.array_equal(a.feature, b.feature)


@pytest.mark.parametrize("texts", [["", None, "a", "x y x y x y", "é\n\nÉ 1!", "w " * 400000, "\n"], []])
def test_statistics_of_each_text_alone(texts):
    whole = Q.statistics(pa.array(texts, pa.string()))
    assert whole.shape == (len(texts), len(Q.NAMES)) and np.isfinite(whole).all()
    for row, text in zip(whole, texts):
        assert np.allclose(row, Q.statistics(pa.array([text], pa.string()))[0])


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(500, 4)), rng.integers(0, 2, 500)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = Q.fit(x, y)

    def walk(row):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            for _ in range(Q.DEPTH):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - 2 ** Q.DEPTH + 1]
        return 1 / (1 + np.exp(-total))
    assert np.allclose(model.score(x), [walk(r) for r in x])
    assert ((model.score(x) > 0.5) == y).mean() > 0.97


def test_few_texts_go_to_a_worker_at_a_time(spark, monkeypatch):
    """While texts are described and scored, Python workers get 1024 of them at most; the setting is put back."""
    from pyspark.sql import DataFrameWriter
    from pyspark.sql.classic.dataframe import DataFrame

    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def noted(f):
        return lambda self, *a, **b: (seen.append(int(spark.conf.get(setting))), f(self, *a, **b))[1]

    before = spark.conf.get(setting)
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, label int")
    monkeypatch.setattr(DataFrame, "toArrow", noted(DataFrame.toArrow))
    monkeypatch.setattr(DataFrameWriter, "parquet", noted(DataFrameWriter.parquet))
    Q.keep(docs, labels)
    assert len(seen) == 2 and max(seen) <= 1024
    assert spark.conf.get(setting) == before


def test_statistics_take_little_memory():
    """Beside 16 MB of texts, numpy's arrays stay a small part of it."""
    import tracemalloc

    texts = pa.array(["some words of a text, " * 180] * 4096)
    tracemalloc.start()
    Q.statistics(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
