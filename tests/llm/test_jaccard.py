import random

import numpy as np
import pyarrow as pa
import pytest

from annolake.llm import jaccard as J
from annolake.llm.wordhash import arrow_bytes, shingles, word_hashes


def word_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """(doc_id, set size, component) of every row, comparing all pairs."""
    sets = [(d, word_set(t)) for d, t in rows]
    group = {d: d for d, _ in sets if d is not None}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 4 * len(x & y) >= 3 * len(x | y):
                group[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((d if d is not None else -1, len(s), find(d) if d is not None else None) for d, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: [rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(n)]
    passage, rows = words(60), []
    for base in range(12):
        text = words(rng.randrange(1, 150))
        for _ in range(rng.randrange(1, 12)):  # families of edited copies, at many distances
            copy = list(text)
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(copy) + 1)
                copy[at:at + rng.randrange(2)] = words(rng.randrange(2))
            rows.append(" ".join(copy))
            if rng.random() < 0.3:
                text = copy
    rows += [" ".join(passage + words(rng.randrange(5, 80))) for _ in range(25)]
    rows += [None, "", " \n", "One two", "one\ttwo", "the the the the the the", "the the the the the", "x " * 50000]
    ids = rng.sample(range(1000), len(rows))
    out = list(zip(ids, rows))
    return out + [out[0], out[3], (None, "no id at all"), (None, rows[0])]


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], "doc_id long, text string, n string").repartition(4)
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in J.join(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_clusters_answer_for_their_members(spark):
    """Small sketches and blocks make every path run: frequent elements, long lists, open clusters."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    core, rows = words(200), []
    for i in range(120):  # two families that share about 0.7, members 0.75 to 0.95 apart
        text = core[:170] + [f"f{i % 2}"] + core[171 + (i % 2) * 14:]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text))
            text = text[:at] + words(1) + text[at + 1:]
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df).collect())
    assert got == brute(rows)


def test_two_texts_of_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in J.join(df).collect()} == {(5, 5), (7, 5), (9, 5)}


def test_deduplicate(spark):
    df = spark.createDataFrame([(3, "a b c", 1), (2, "A b c", 2), (2, "A b c", 2), (None, "a b c", 3), (4, None, 4), (5, None, 5)],
                               "doc_id long, text string, component_id int")
    kept = J.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 2), (False, 4), (False, 5), (True, None)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(df).count() == 0
    assert J.join(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0].component_id == 1


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)]
    got = {r.node: r.label for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: label[n] for n in touched}


@pytest.mark.parametrize("window", [1 << 20, 7])
def test_word_hashes(monkeypatch, window):
    from annolake.llm import wordhash
    monkeypatch.setattr(wordhash, "WINDOW", window)
    texts = ["A b  c\n", "", None, "a", "BBB\tc\x0b\x0cd", " ", "é É x", "l" * 100, "\x1cab \x85"]
    hashes, at = word_hashes(*arrow_bytes(pa.array(texts)))
    words = [w for t in texts for w in (t or "").encode().lower().split()]
    assert np.diff(at).tolist() == [len((t or "").encode().split()) for t in texts]
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert len(shingles(hashes[:3], 5)) == 1 and len(shingles(hashes[:0], 5)) == 0


def jobs_of(spark, run):
    """How many jobs ``run`` makes the driver start."""
    group = f"jaccard-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_stars_need_one_round(spark):
    """Each job costs the driver memory; no round is spent on finding that nothing changes."""
    edges = spark.createDataFrame([(1, 2), (1, 3), (5, 4), (6, 4)], "a long, b long")
    assert jobs_of(spark, lambda: J.components(edges)) <= 14
    assert {(r.node, r.label) for r in J.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)}


def test_stars(spark):
    for edges, answer in (([], True), ([(3, 1), (2, 1), (9, 4)], True), ([(3, 1), (3, 2)], False), ([(3, 2), (2, 1)], False),
                          ([(-1, -5), (0, -5)], True)):
        assert J._stars(spark.createDataFrame(edges, "a long, b long")) == answer


def test_driver_gathers_little(spark):
    """One packed row of levels, whatever the number of partitions; packed filters for pairs."""
    rows = [(i, " ".join(f"w{i % 7}x{j}" for j in range(60)) + f" t{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    levels = J._levels(docs.mapInArrow(J._signatures, J._SIGNATURE))
    assert len(levels) < J.SKETCH // 8
    pairs = spark.createDataFrame([(i + 7, i) for i in range(193)], "a long, b long").repartition(8)
    bits = pairs.mapInArrow(J._id_bits, "bits binary").collect()
    assert sum(len(r.bits) for r in bits) < J.FILTER_BITS // 8
    assert jobs_of(spark, lambda: J.compare(docs, pairs)) <= 10
    assert {(r.a, r.b) for r in J.compare(docs, pairs).filter(J._linked()).collect()} == {(i + 7, i) for i in range(193)}
