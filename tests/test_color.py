from pyspark.sql import functions as F

from annolake.functions import color as C

V = F.col("v")


def shades(texts, rows, expression):
    out = texts(expression, rows, "struct<r:double,g:double,b:double>")
    return [tuple(round(c, 6) for c in r) if r is not None and not isinstance(r, str) else r for r in out]


def by_255(*rows):
    return [tuple(c / 255 for c in r) for r in rows]


def test_present_palette(texts):
    rows = by_255((15, 0, 255), (219, 25, 45), (99, 0, 99), (0, 255, 0), (0, 0, 0)) + [(0.1, 0.1, 0.1), (1.0, 0.65, 0.0), None]
    green = round(124 / 255, 6)
    assert shades(texts, rows, C.standardize_color(V)) == [
        (0, 0, 1), (1, 0, 0), (1, 0, 1), (0, green, 0), (0, 0, 0), (0.1, 0.1, 0.1), (1, 0.65, 0), (0, 0, 0)]


def test_earlier_palettes(texts):
    rows = [(0.1, 0.1, 0.1), (1.0, 0.8, 0.0), (0.0, 0.95, 0.0), (0.05, 0.0, 0.95), (0.9, 0.05, 0.05), (0.0, 0.95, 1.0)]
    assert shades(texts, rows, C.standardize_color(V, "v2")) == [
        (0, 0, 0), (1, 0.65, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0), (0, 1, 1)]
    assert shades(texts, rows, C.standardize_color(V, "v1")) == [
        (0, 0, 0), (1, 0.65, 0), (0, 1, 0), (0, 0, 1), (1, 0, 0), (0, 0, 1)]


def test_configured_targets(texts):
    assert shades(texts, [(0.9, 0.0, 0.0)], C.standardize_color(V, red=(200, 0, 0))) == [(round(200 / 255, 6), 0, 0)]


def test_hex_round_trip(spark):
    df = spark.range(256).select(C.rgb(F.col("id") / 255, F.lit(0), F.lit(1)).alias("c"), "id")
    df = df.withColumn("h", C.to_hex(F.col("c")))
    assert df.filter(F.col("h") != F.format_string("#%02X00FF", F.col("id").cast("int"))).count() == 0
    assert df.filter(C.from_hex(F.col("h")) != F.col("c")).count() == 0


def test_colour_texts(texts):
    hexes = lambda e, v: texts(C.to_hex(e), v)
    assert hexes(C.parse_style_color(V), ["#0033FF", "rgb(255, 0,1)", "blue", "#xyzxyz"]) == ["#0033FF", "#FF0001", None, None]
    assert hexes(C.parse_fill(V), ["#102030", "1 0 0", "255 0 0", "junk", "1 2", None]) == [
        "#102030", "#FF0000", "#FF0000", "#00FFFF", "#00FFFF", "#00FFFF"]
    assert hexes(C.color_in_style(V), ["color: #ff0000;", "a;color: rgb(1, 2, 3)", "none"]) == ["#FF0000", "#010203", None]


def test_text_color_policies(spark):
    rows = [("/Helv 10 Tf 0.2 0 1 rg", (0.0, 1.0, 1.0), None), ("0 0 0 rg", (0.5, 0.0, 0.0), "0 1 1 rg 0 0 0 rg 0.3 0.3 0.9 rg"), (None, None, None)]
    df = spark.createDataFrame(rows, "da string, stroke struct<r:double,g:double,b:double>, look string")
    pick = lambda **k: [tuple(r[0]) if r[0] else None for r in df.select(
        C.text_color(F.col("da"), F.col("stroke"), F.col("look"), **k)).collect()]
    assert pick() == [(0.2, 0, 1), (0, 0, 0), (0, 0, 0)]
    assert pick(policy="export") == [(0.2, 0, 1), (0.3, 0.3, 0.9), (0, 0, 0)]
    assert pick(policy="archived") == [(0.2, 0, 1), (0, 0, 0), (0, 0, 0)]
    assert pick(policy="preserve") == [(0, 1, 1), (0.5, 0, 0), None]


def test_names_and_classes(texts):
    rows = [(0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.0, 0.5, 0.0), (0.75, 1.0, 1.0), (0.0, 0.0, 0.0), (0.5, 0.0, 0.5), (1.0, 0.5, 0.0), (0.2, 0.9, 0.125), None]
    kind = "struct<r:double,g:double,b:double>"
    assert texts(C.color_name(V), rows, kind) == ["Blue", "Red", "Green", "Cyan", "Black", "Purple", "Orange", "RGB(0.20, 0.90, 0.12)", "Unknown"]
    assert texts(C.output_class(V), rows, kind)[:3] == ["BLUE", "RED", "RGB(0.00,0.50,0.00)"]
    assert texts(C.rgb_text(V), rows, kind)[0] == "RGB(0, 0, 255)" and texts(C.rgb_text(V), rows, kind)[-1] == "N/A"
