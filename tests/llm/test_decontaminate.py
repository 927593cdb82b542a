import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from annolake.llm import decontaminate as D


def grams(words, k):
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    """Greatest similarity of any item-sized window, for each text and item."""
    best = {}
    for d, t in docs:
        words = (t or "").encode().lower().split()
        for i, x in items:
            own = (x or "").encode().lower().split()
            k = min(5, len(own))
            if not own:
                continue
            have = grams(own, k)
            for s in range(max(1, len(words) - len(own) + 1)):  # a shorter document is one window
                window = grams(words[s:s + len(own)], k)
                shared = sum((window & have).values())
                j = shared / (sum(window.values()) + sum(have.values()) - shared)
                if j >= D.SIMILARITY:
                    best[d, i] = max(best.get((d, i), 0), j)
    return best


def tables():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 30, 45, 59, 3, 1, 20])]
    items += [(7, None), (8, ""), (9, "a b a b a b a b a b a b"), (0, items[0][1])]
    docs, base = [], lambda n: [word() for _ in range(n)]
    for d in range(60):
        words = base(rng.randrange(0, 120))
        source = items[d % 7][1].split()
        for _ in range(rng.randrange(0, 4)):  # edited passages
            at = rng.randrange(len(source) + 1)
            source[at:at + rng.randrange(2)] = base(rng.randrange(2))
        place = rng.randrange(len(words) + 1)
        words[place:place] = source
        docs.append((d, rng.choice([" ", "\n"]).join(words).upper()))
    docs += [(100, None), (101, ""), (102, "a b " * 50), (103, "zz " * 30000), (104, items[1][1]), (104, items[1][1]), (104, "x " + items[2][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = tables()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    got = D.leaks(df, spark.createDataFrame([(i, x, 0) for i, x in items], "item_id long, text string, doc_id int")).collect()
    mine = {}
    for r in got:
        mine[r.doc_id, r.item_id] = max(mine.get((r.doc_id, r.item_id), 0), r.similarity)
    assert mine == pytest.approx(brute(docs, items))
    assert len(mine) > 30


def test_shorter_documents_against_brute_force(spark):
    """Documents that are an item less some words, at the ends or inside."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(n, " ".join(word() for _ in range(n))) for n in (60, 20, 8, 5, 2, 150)]
    docs = []
    for n, text in items:
        own = text.split()
        for i in range(12):
            cut = own[rng.randrange(0, 4):len(own) - rng.randrange(0, 1 + n // 5)]
            if i % 3 == 2 and cut:
                del cut[rng.randrange(len(cut))]
            docs.append((1000 * n + i, " ".join(cut)))
    docs.append((1, " ".join(items[0][1].split()[:56])))
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == pytest.approx(want)
    assert (1, 60) in want and sum(len(dict(docs)[d].split()) < i for d, i in want) > 15


def test_swapped_parts_against_brute_force(spark):
    """The best window lies between two places that are an item or more apart."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(n, " ".join(word() for _ in range(n))) for n in (100, 60, 150)]
    docs = []
    for n, text in items:
        own = text.split()
        for between in (0, 1, 3, 6, 12):  # strange words between the swapped halves
            strange = [[word() for _ in range(k)] for k in (20, between, 20)]
            docs.append((1000 * n + between, " ".join(strange[0] + own[n // 2:] + strange[1] + own[:n // 2] + strange[2])))
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id): r.similarity for r in got.collect()} == pytest.approx(want)
    assert len(want) > 6


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    docs, items = tables()
    df = spark.createDataFrame([(d, t, "x") for d, t in docs + [(None, items[0][1]), (None, "clean")]], "doc_id long, text string, fp string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns
    dirty = {d for d, _ in brute(docs, items)}
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(d for d, _ in docs if d not in dirty)
    assert [r.text for r in kept.filter(F.col("doc_id").isNull()).collect()] == ["clean"]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, none).count() == 1
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.leaks(docs.limit(0), some).count() == 0
    assert D.leaks(docs, some).first().similarity == 1.0


def test_blocks_find_all_prints_within_the_radius(spark):
    rng = random.Random(1)
    flips = [(i, sum(1 << b for b in rng.sample(range(64), D.RADIUS))) for i in range(200)]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in flips]
    a = D._blocks(spark.createDataFrame(rows, "i int, print long"))
    zero = D._blocks(spark.createDataFrame([(0, 0)], "j int, print long")).drop("print")
    assert a.join(zero, ["block", "value"]).select("i").distinct().count() == 200
