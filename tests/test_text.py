import html

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
import pytest

from annolake.functions import text as X

V = F.col("v")
ZWSP = chr(0x200B)


def test_clean_text(texts):
    given_texts = ["a&#xD;&#xA;b" + ZWSP + "c  d", None, "", " \t x \r\n y ", "a&amp;lt;b", "&notit; &copy", "x" + chr(0x2003) + "y"]
    assert texts(X.clean_text(V), given_texts) == [
        "a bc d", None, "", "x y", "a&lt;b", html.unescape("&notit; &copy"), "x y"]
    assert texts(X.clean_text(V, "simple"), [" a\r\nb  c "]) == ["a b  c"]
    with pytest.raises(ValueError):
        X.clean_text(V, "other")


def test_quotes(texts):
    cases = {
        "A='v'": 'A = "v"', "A = 'v": 'A = "v"', "A = v'": "A = v'", "A = null": "A = NULL",
        "VSORRES when VSTESTCD=HEIGHT": 'VSORRES when VSTESTCD = "HEIGHT"',
        "A = 'b c' when D = E": 'A = "b c" when D = "E"', "A = 5 mg and B=2": 'A = "5 mg" and B = "2"',
        "A = red orange": 'A = "red" orange', "A = ' when x": 'A = "" when x',
        "DM = Demographics": "DM = Demographics", "DM= x": "DM =  x", "RELREC when A=B": "RELREC when A = B",
        'A = "x"': 'A = "x"', "A = 'NULL'": "A = NULL", 'A = "null"': "A = NULL", "no assignment": "no assignment",
        "A = ' b '": 'A = "b"', "": "",
    }
    assert texts(X.normalize_quotes(V), list(cases)) == list(cases.values())


def test_quotes_take_very_long_texts(texts):
    long = "A = " + "word " * 50000
    assert texts(X.normalize_quotes(V), [long]) == ['A = "' + ("word " * 50000).strip() + '"']


def test_headers(texts):
    cases = ["DM = Demographics", "DM=x", "dm = x", "DM = 'x'", "DMX = y", "DM = a = b", "DM =", None]
    assert texts(X.is_header(V), cases) == [True, True, False, False, False, True, False, False]
    assert texts(X.header_code(V), cases) == ["DM", "DM", None, "DM", None, None, None, None]
    assert texts(X.header_label(V), ["DM =  x y "]) == ["x y"]
    assert texts(X.upper_non_header(V), ["DM = x", "ae term"]) == ["DM = x", "AE TERM"]
    assert texts(X.header_font_size(V), ["DM = x", "ae"]) == [12, 10]


def test_domains(texts):
    assert texts(X.domain_from_text(V), ["VS = Vitals", "something in SUPPMH", "cm dose", "xFACATx", "nothing"]) == [
        "VS", "MH", "CM", "FA", None]
    assert texts(X.domain_from_words(V), ["the aeterm", "x vs", "nothing"]) == ["AE", "VS", None]
    rows = texts(X.infer_domain(V, V.isin("AGE")), ["AGE", "lbtest", "A", None])
    assert rows == ["DM", "LB", None, None]


def test_conditions(texts):
    pair = X.condition_pair(V)
    assert [tuple(r) if r else None for r in texts(pair, ["A = B", "A", "A=B=C", "A ="])] == [("A", "B"), None, None, ("A", "")]
    assert texts(X.condition_tokens(V), ["FASEQ = AEGRPID x"]) == [["FASEQ", "AEGRPID"]]


def test_forms(texts):
    page = F.lit(7)
    cases = ["x\nForm: Vital Signs \nmore", "a\nTitle line\nb", "a\nb\nc\nd\ne\nToo late", "", "Form:\n  Next"]
    assert texts(X.form_name(V, page), cases) == ["Vital Signs", "Title line", "Page 7", "Page 7", "Next"]
    assert texts(X.marked_form_name(V), cases) == ["Vital Signs", None, None, None, "Next"]


def test_small_ones(texts):
    assert texts(X.preview(V, 3), ["abc", "abcd"]) == ["abc", "abc..."]
    assert texts(X.preview(V, 37, 40), ["x" * 40, "x" * 41]) == ["x" * 40, "x" * 37 + "..."]
    assert texts(X.author_or_default(V, "D"), ["A", " ", None]) == ["A", "D", "D"]
    assert texts(X.escape_markup(V), ["<a&\"'"]) == ["&lt;a&amp;&quot;&#x27;"]
    assert texts(X.position_text(F.length(V).cast("double"), F.lit(2.5)), ["ab", None]) == ["(2.0, 2.5)", ""]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab &;#x1l\t\n" + ZWSP + chr(0xA0), max_size=15), min_size=1, max_size=30))
def test_clean_text_random(spark, values):
    import re
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(X.clean_text(V)).collect()]
    assert got == [re.sub(r"\s+", " ", html.unescape(v).replace(ZWSP, "")).strip() for v in values]
