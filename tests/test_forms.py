import random

from pyspark.sql import functions as F

from annolake.operators import forms
from annolake.operators.ordered import carry_forward, with_previous


def pages(spark, names):
    return spark.createDataFrame([("D", i, n) for i, n in enumerate(names, 1)], "doc_id string, page int, form string")


def test_look_back_across_chunks(spark):
    rng = random.Random(1)
    values = [rng.choice([None, "a", "b", "c"]) for _ in range(60)]
    df = spark.createDataFrame([("D", i, v, v or "-") for i, v in enumerate(values, 1)], "d string, n int, v string, w string").repartition(4)
    for size in (1, 7, 100):
        chunk = F.floor((F.col("n") - 1) / size)
        filled = [r["f"] for r in carry_forward(df, ["d"], "n", "v", "f", chunk).orderBy("n").collect()]
        last, want = None, []
        for v in values:
            last = v or last
            want.append(last)
        assert filled == want
        before = [r["p"] for r in with_previous(df, ["d"], "n", "w", "p", chunk).orderBy("n").collect()]
        assert before == [None] + [v or "-" for v in values[:-1]]


def test_runs(spark):
    runs = forms.form_runs(pages(spark, "AABA")).orderBy("page").collect()
    assert [(r["page"], r["form"]) for r in runs] == [(1, "A"), (3, "B"), (4, "A")]


def notes(spark, rows):
    return spark.createDataFrame([("D", p, i, t) for i, (p, t) in enumerate(rows)], "doc_id string, page int, annot_idx long, content string")


def toc(df):
    return [(r["level"], r["title"], r["page"]) for r in df.orderBy(*forms.toc_order(df)).collect()]


def test_standard_bookmarks(spark):
    heads = forms.headers(notes(spark, [(4, "DM = Demographics"), (2, "AE = Adverse"), (2, "DM = Later"), (2, "AE.X"), (3, "DM = 'no'")]))
    got = toc(forms.bookmarks(pages(spark, "AABA"), heads))
    assert got == [(1, "Form_bookmarks", 1), (2, "A", 1), (2, "B", 3), (2, "A", 4), (1, "SDTM", 1), (2, "AE", 2), (3, "A", 1),
                   (2, "DM", 2), (3, "A", 1), (3, "B", 3), (3, "A", 4)]
    first = {r["domain"]: (r["first_page"], r["label"]) for r in forms.first_of_domain(heads).collect()}
    assert first == {"DM": (2, "Later"), "AE": (2, "Adverse")}


def test_script_bookmarks(spark):
    texts = spark.createDataFrame([("D", 1, "intro"), ("D", 2, "Form: A\n"), ("D", 3, "more"), ("D", 4, "Form: B")], "doc_id string, page int, text string")
    # a domain before the first form is lost, lower-case labels do not count
    got = toc(forms.script_bookmarks(texts, notes(spark, [(1, "VS=VITALS"), (3, "DM = DEMO"), (4, "DM=DEMO"), (4, "AE = Adverse")])))
    assert got == [(1, "Form_bookmarks", 1), (2, "A", 2), (2, "B", 4), (1, "SDTM", 1), (2, "DM", 2), (3, "A", 2), (3, "B", 4)]


def test_xfdf_bookmarks(spark):
    old = spark.createDataFrame([("D", 0, 1, "Cover", 1), ("D", 1, 1, "SDTM", 1)], "doc_id string, ord long, level int, title string, page int")
    heads = forms.headers(notes(spark, [(2, "DM = Demo"), (2, "DM = Demo"), (3, "DM = Other")]))
    assert toc(forms.xfdf_bookmarks(heads, pages(spark, "ABC"), old)) == [
        (1, "Cover", 1), (1, "SDTM", 1), (2, "DM - Demo", 2), (3, "Page 2 - B", 2), (3, "Page 3 - C", 3)]


def test_item_bookmarks(spark):
    rows = [(3, "AE = Adverse"), (1, "AETERM " + "x" * 50), (2, "aeterm one"), (4, "AETERM ONE"), *[(5, f"AE item {i}") for i in range(12)], (2, "VSX")]
    got = toc(forms.item_bookmarks(notes(spark, rows)))
    assert got[:5] == [(1, "SDTM", 1), (2, "AE - Adverse", 1), (3, "AETERM " + "X" * 30 + "...", 1), (3, "AETERM ONE", 2), (3, "AE ITEM 0", 5)]
    assert len([g for g in got if g[0] == 3]) == 10 and got[-1] == (2, "VS", 2)
