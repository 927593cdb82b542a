import string

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from annolake.functions import metrics as M

V = F.col("v")
MEASURE = M.TextMeasurer()


@pytest.mark.parametrize("widths", [M.HELVETICA, M.HELVETICA_BOLD])
def test_each_printable_character_has_one_width(widths):
    chars = "".join(widths.values())
    assert len(chars) == len(set(chars))
    assert set(chars) == set(string.printable[:95])


def bold(text):
    of = {c: w for w, chars in M.HELVETICA_BOLD.items() for c in chars}
    return sum(of.get(c, 278) for c in text) / 1000


def test_width(texts):
    cases = ["", "AE.AETERM", "W i", chr(0xC9) + "a", chr(0x4E2D)]
    want = [0, bold("AE.AETERM"), bold("W i"), bold("Ea"), 0.278]
    assert texts(MEASURE.width(V, "hebi", 10), cases) == pytest.approx([w * 10 for w in want])
    assert texts(MEASURE.width(V, "cour", 10), ["abc"]) == pytest.approx([18])
    assert texts(MEASURE.width(V, "nofont", 10), ["abc"]) == [None]


def test_boxes(texts):
    box = lambda e, v: [tuple(r) for r in texts(e, v)]
    assert box(MEASURE.dimensions(V, "hebi", 10), ["", "  "]) == [(8, 14), (8, 14)]
    w = bold("hello world") * 10
    assert box(MEASURE.dimensions(V, "hebi", 10), ["hello world"]) == [pytest.approx((w + 8, 16))]
    assert box(MEASURE.dimensions(V, "hebi", 10, F.lit(30.0)), ["hello world"]) == [
        pytest.approx((30, int(w / 22 + 0.5) * 12 + 4))]
    assert box(MEASURE.dimensions(V, "none", 10), ["abc"]) == [pytest.approx((26, 16))]
    assert texts(MEASURE.fits(V, "hebi", 10, F.lit(w + 8), F.lit(16.0)), ["hello world", "hello world!", "hello world hello world"]) == [True, True, False]


def test_own_font(texts):
    wide = M.Font(("wide",), {1000: "a"}, 500)
    assert texts(M.TextMeasurer(fonts=(wide,)).width(V, "wide", 10), ["ab"]) == pytest.approx([15])


def wrap(text, limit):
    lines, line = [], []
    for word in text.split():
        if bold(" ".join([*line, word])) * 10 <= limit + 1e-9:
            line.append(word)
        elif line:
            lines.append(" ".join(line))
            line = [word]
        else:
            lines.append(word)
    return lines + ([" ".join(line)] if line else [])


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="abW .", max_size=40), min_size=1, max_size=20), st.integers(5, 80))
def test_wrapping_against_words(spark, values, limit):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    # a limit between two sums, so that rounding cannot decide
    edge = limit + 0.0001234
    got = df.select(MEASURE.wrapped_lines(V, "hebi", 10, F.lit(edge)).alias("l"),
                    MEASURE.wrapped_size(V, "hebi", 10, F.lit(edge)).alias("s")).collect()
    for row, text in zip(got, values):
        want = wrap(text, edge)
        assert list(row["l"]) == want
        assert row["s"]["lines"] == len(want)
        assert row["s"]["widest"] == pytest.approx(max((bold(x) * 10 for x in want), default=0))


def test_fonts_from_da(texts):
    assert [tuple(r) for r in texts(M.font_from_da(V), ["/Helv 10.5 Tf 0 g", "x", None])] == [("helv", 10.5), ("hebi", 10), ("hebi", 10)]
    assert [tuple(r) for r in texts(M.font_for_table(V), ["/Arial,Bold 9 Tf", None])] == [("Arial", 9), ("Helvetica", 10)]
