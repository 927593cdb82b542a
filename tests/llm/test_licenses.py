import random

from annolake.llm import licenses as L
from annolake.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def brute(docs, templates=L.TEMPLATES, phrases=L.PHRASES):
    """Every template at every offset of every document."""
    made, rows = [L.template(*t) for t in templates], []
    for doc, text in docs:
        words = L.split(text or "")
        base = sorted((i, label) for p, label in phrases for i in range(len(words)) if words[i:i + len(L.split(p))] == L.split(p))
        found, score = {label for _, label in base}, 1.0 if base else 0.0
        for t in made:
            for offset in range(1 - len(t.words), len(words)):
                at = {i for i, w in enumerate(t.words) if 0 <= offset + i < len(words) and words[offset + i] == w}
                if len(at) >= t.need and t.keys <= at:
                    found.add(t.label)
                    score = max(score, len(at) / len(t.words))
        rows.append((doc, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                     sorted({label for _, label in base}), sorted(found), score))
    return rows


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_against_all_offsets(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = brute(docs)
    assert {"mit", "apache-2.0", "cc-by-nc-4.0"} <= {label for r in want for label in r[6]}
    same(L.scan(table(spark, SF, "documents")).select(*COLUMNS).collect(), want)
    texts = [(*r[:5], ",".join(r[5]), ",".join(r[6]), r[7]) for r in want]
    df = QUERIES["op11_license_scan"](spark, SF)
    assert df.columns == COLUMNS
    same(df.collect(), texts)


def test_damaged_notices(spark):
    """Words lost, changed and put in, at the ends of texts, and many in one text."""
    rng, docs = random.Random(4), []
    fill = "the under license mit software of permission version public and zebra Straße free".split()
    for n in range(150):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice(fill) for _ in range(rng.randrange(0, 30))]
            part = rng.choice(L.TEMPLATES)[1].split()
            for _ in range(rng.randrange(0, 4)):
                kind, at = rng.randrange(3), rng.randrange(len(part))
                part[at:at + 1] = [] if kind == 0 and len(part) > 1 else [rng.choice(fill)] if kind == 1 else [part[at], rng.choice(fill)]
            words += part[rng.choice([0, 0, 1, 2]):]
        docs.append((n, rng.choice([" ", "  ", "\n", ", "]).join(words)))
    want = brute(docs)
    assert sum(bool(r[6]) for r in want) > 40
    same(L.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).select(*COLUMNS).collect(), want)


def test_nulls_ties_repeats_and_clashes(spark):
    docs = [(1, None), (1, "ALL RIGHTS RESERVED"), (1, "ALL RIGHTS RESERVED"), (None, "cc-by, CC  BY"), (2, ""), (3, "a " * 50000 + "Released under the MIT License."),
            (4, "all rights"), (5, "reserved"), (6, "cc by-nc 4.0 licensed under cc by-nc 4.0")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: L.F.lit("x") for c in ("row", "hits", "n_words", "labels")})
    same(L.scan(df).select(*COLUMNS).collect(), brute(docs))
    assert L.scan(df.limit(0)).count() == 0
    one = (("x", "alpha", ("alpha",)), ("y", "beta gamma beta", ()))
    odd = [(1, "alpha beta gamma beta"), (2, "beta gamma"), (3, "beta beta beta")]
    same(L.scan(spark.createDataFrame(odd, "doc_id long, text string"), one, (("beta beta", "z"),)).select(*COLUMNS).collect(),
         brute(odd, one, (("beta beta", "z"),)))
