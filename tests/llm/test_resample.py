import hashlib
import math
import random
import re
import zlib

import pyarrow as pa

from annolake.llm import resample as R
from annolake.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in grams(text)[1]:
                counts[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10000) / ((a + 1) * (T + 10000)))) for a, b in zip(s, t)]
    rows, may = [], []
    for doc, text in docs:
        words, found = grams(text)
        weight = sum(gain[b] for b in found)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(found), weight, score, None])
        if len(words) >= 20:
            may.append(rows[-1])
    drawn = sorted((r for r in may if r[0] is not None), key=lambda r: (-r[3], r[0]))[:5 * len(may) // 100]
    for i, r in enumerate(drawn, 1):
        r[4] = i
    return rows


def same(got, want):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(map(tuple, want), key=key)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = brute(docs, [r.text for r in table(spark, SF, "benchmark").collect()])
    df = QUERIES["op13_importance_resampling"](spark, SF)
    assert df.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sum(r[4] is not None for r in want) > 3
    same(df.collect(), want)


def test_pieces_and_odd_texts(spark, monkeypatch):
    rng = random.Random(3)
    some = ["a", "Bc", "é", "日本", "x" * 200, "9z"]
    texts = ["", None, " ,;", "one", *(" ".join(rng.choice(some) for _ in range(rng.randrange(1, 400))) + rng.choice(["", ".", " "]) for _ in range(60)),
             "word" * 3000, "A.B" * 2000, ("q" * 70 + "-") * 300]
    for piece in (R.PIECE, 1000, 64):
        monkeypatch.setattr(R, "PIECE", piece)
        got = [[0, []] for _ in texts]
        for rows, words, found in R._read(pa.array(texts)):
            for row, n in zip(rows, words):
                got[row][0] += n
            for bucket, owner in found:
                for b, o in zip(bucket, owner):
                    got[rows[o]][1].append(b)
        for text, (n, found) in zip(texts, got):
            words, want = grams(text)
            assert n == len(words) and sorted(found) == sorted(want)


def test_nulls_ties_repeats_and_clashes(spark):
    long = " ".join(f"w{i % 7}" for i in range(30))
    docs = [(1, long), (1, long), (2, long), (2, None), (None, long), (3, ""), *((10 + i, long + f" t{i}") for i in range(60))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", R.F.lit("x")).withColumn("weight", R.F.lit("y"))
    target = spark.createDataFrame([("w1 w2 t5",), (None,)], "text string")
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    same(R.resample(df, target).select(*cols).collect(), brute(docs, ["w1 w2 t5", None]))
    same(R.resample(df, target.limit(0)).select(*cols).collect(), brute(docs, []))
    assert R.resample(df.limit(0), target).count() == 0
