"""Colour expressions on ``struct<r,g,b: double>`` with channels in 0-1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Named colours and the defaults of the standard palette (0-255).
STANDARD_RED, STANDARD_BLUE, STANDARD_GREEN = (255, 0, 0), (0, 0, 255), (0, 124, 0)
BLACK, WHITE, CYAN = (0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.0, 1.0, 1.0)
LIGHT_CYANS = ((0.75, 1.0, 1.0), (0.85, 1.0, 1.0))
ORANGE, MAGENTA = (1.0, 0.65, 0.0), (1.0, 0.0, 1.0)

_FILL_OPERATOR = r"(?U)([\d.]+\s+[\d.]+\s+[\d.]+)\s+rg"


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.named_struct(F.lit("r"), r.cast("double"), F.lit("g"), g.cast("double"),
                          F.lit("b"), b.cast("double"))


def color_lit(channels) -> Column:
    return rgb(*(F.lit(float(c)) for c in channels))


def scaled_lit(channels) -> Column:
    """A 0-255 triple as a colour."""
    return color_lit([c / 255.0 for c in channels])


def _is_one_of(color: Column, choices) -> Column:
    hit = F.lit(False)
    for r, g, b in choices:
        hit = hit | ((color["r"] == r) & (color["g"] == g) & (color["b"] == b))
    return hit


def _triple(text: Column) -> Column:
    """Three blank-separated numbers as a colour; null when they are not numbers."""
    parts = F.split(text, r"(?U)\s+")
    r, g, b = (F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3))
    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), rgb(r, g, b))


# --- where the text colour stands ------------------------------------------

def color_from_da(da: Column) -> Column:
    """First ``r g b rg`` of a default-appearance string, else null."""
    return _triple(F.regexp_extract(da, _FILL_OPERATOR, 1))


def appearance_colors(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_FILL_OPERATOR), F.lit(1)), _triple)


def _first_appearance(text: Column, skip) -> Column:
    kept = F.filter(appearance_colors(text), lambda c: c.isNotNull() & ~_is_one_of(c, skip))
    return F.try_element_at(kept, F.lit(1))


def text_color(da: Column, stroke: Column | None = None, appearance: Column | None = None,
               common: Column | None = None, policy: str = "da") -> Column:
    """Text colour of an annotation.

    ``da``        appearance string, then stroke, then black
    ``export``    appearance string or black; if black, the first colour of the
                  appearance text that is not a background or border colour
    ``archived``  appearance string unless black or white, then the appearance
                  text (black allowed), then a stroke that is not cyan, then black
    ``preserve``  stroke, common, appearance string, else null
    """
    black = color_lit(BLACK)
    none = F.lit(None).cast("struct<r:double,g:double,b:double>")
    stroke = none if stroke is None else stroke
    common = none if common is None else common
    from_da = color_from_da(da)
    if policy == "da":
        return F.coalesce(from_da, stroke, black)
    if policy == "export":
        base = F.coalesce(from_da, black)
        if appearance is None:
            return base
        found = _first_appearance(appearance, (CYAN, WHITE, BLACK) + LIGHT_CYANS)
        return F.when(_is_one_of(base, (BLACK,)), F.coalesce(found, base)).otherwise(base)
    if policy == "archived":
        found = none if appearance is None else _first_appearance(
            appearance, (CYAN, WHITE) + LIGHT_CYANS)
        return F.coalesce(F.when(~_is_one_of(from_da, (BLACK, WHITE)), from_da), found,
                          F.when(~_is_one_of(stroke, (CYAN,) + LIGHT_CYANS), stroke), black)
    if policy == "preserve":
        plain = _triple(F.regexp_extract(
            da, r"(?U)(\d*\.?\d+\s+\d*\.?\d+\s+\d*\.?\d+)\s+rg", 1))
        return F.coalesce(stroke, common, plain)
    raise ValueError(f"unknown colour policy {policy!r}")


# --- standard colours ------------------------------------------------------

def standardize_color(color: Column, palette: str = "v3", red=STANDARD_RED, blue=STANDARD_BLUE,
                      green=STANDARD_GREEN) -> Column:
    """Map shades to the standard colours; others are kept, a missing colour is black.

    ``v3`` is the present rule with configurable targets, ``v2`` adds near-black
    and orange and has pure green, ``v1`` uses fixed thresholds.
    """
    r, g, b = color["r"], color["g"], color["b"]
    start = F.when(color.isNull() | r.isNull() | g.isNull() | b.isNull(), color_lit(BLACK))
    if palette == "v1":
        return (start.when((r < 0.5) & (b > 0.5), color_lit((0, 0, 1)))
                .when((r > 0.5) & (g < 0.5) & (b < 0.5), color_lit((1, 0, 0)))
                .when((r < 0.5) & (g > 0.5) & (b < 0.5), color_lit((0, 1, 0)))
                .when((r > 0.5) & (g > 0.5) & (b < 0.5), color_lit(ORANGE))
                .when((r < 0.3) & (g < 0.3) & (b < 0.3), color_lit(BLACK))
                .otherwise(color))
    if palette not in ("v2", "v3"):
        raise ValueError(f"unknown palette {palette!r}")
    to_red, to_blue, to_green = scaled_lit(red), scaled_lit(blue), scaled_lit(green)
    if palette == "v2":
        to_red, to_blue, to_green = (color_lit(c) for c in ((1, 0, 0), (0, 0, 1), (0, 1, 0)))
    top = F.greatest(r, g, b)
    # shares of the strongest channel; the zero case leaves through the gate below
    share = F.nullif(top, F.lit(0.0))
    rn, gn, bn = r / share, g / share, b / share
    rule = start.when(top < 0.15, color_lit(BLACK)) if palette == "v2" \
        else start.when(top == 0, color)
    rule = (rule.when((bn > 0.9) & (rn < 0.3) & (gn < 0.3), to_blue)
            .when((rn > 0.9) & (gn < 0.3) & (bn < 0.3), to_red)
            .when((gn > 0.9) & (rn < 0.3) & (bn < 0.3), to_green))
    if palette == "v2":
        rule = rule.when((rn > 0.7) & (gn > 0.5) & (bn < 0.3), color_lit(ORANGE))
    return (rule.when((bn > 0.8) & (gn > 0.8) & (rn < 0.2), color_lit(CYAN))
            .when((rn > 0.8) & (bn > 0.8) & (gn < 0.2), color_lit(MAGENTA))
            .when((b > 0.8) & (r < 0.2) & (g < 0.3), to_blue)
            .when((r > 0.8) & (g < 0.2) & (b < 0.2), to_red)
            .when((g > 0.8) & (r < 0.2) & (b < 0.2), to_green)
            .otherwise(color))


# --- text forms ------------------------------------------------------------

def _byte(channel: Column) -> Column:
    return (channel * 255).cast("int")


def to_hex(color: Column) -> Column:
    def pair(channel):
        digits = F.hex(_byte(channel))
        return F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
    return F.concat(F.lit("#"), pair(color["r"]), pair(color["g"]), pair(color["b"]))


def from_hex(text: Column) -> Column:
    """``#RRGGBB`` or ``RRGGBB`` as a colour, null when the digits are not hexadecimal."""
    digits = F.ltrim(text, F.lit("#"))
    channels = [F.conv(F.substring(digits, i, 2), 16, 10).cast("double") / 255.0 for i in (1, 3, 5)]
    return F.when(digits.rlike("^[0-9A-Fa-f]{6}"), rgb(*channels))


def _bytes_match(text: Column, pattern: str) -> Column:
    channels = [F.regexp_extract(text, pattern, i).try_cast("double") / 255.0 for i in (1, 2, 3)]
    return F.when(text.rlike(pattern), rgb(*channels))


def parse_style_color(text: Column) -> Column:
    """Value of a style's ``color:``: hex or three comma-separated bytes, else null."""
    return F.when(F.startswith(text, F.lit("#")), from_hex(text)).otherwise(
        _bytes_match(text, r"(?U)(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"))


def parse_fill(text: Column, default=CYAN) -> Column:
    """Fill attribute: hex, or three numbers in 0-1 or 0-255 (told by the largest)."""
    value = F.btrim(text)
    parts = F.split(value, r"(?U)\s+")
    triple = F.when(F.size(parts) == 3, _triple(value))
    big = F.greatest(triple["r"], triple["g"], triple["b"]) > 1.0
    scaled = rgb(triple["r"] / 255.0, triple["g"] / 255.0, triple["b"] / 255.0)
    return F.coalesce(F.when(F.startswith(value, F.lit("#")), from_hex(value))
                      .when(big, scaled).otherwise(triple), color_lit(default))


def color_in_style(style: Column) -> Column:
    """``color: #rrggbb`` or ``color: rgb(r, g, b)`` inside a style, else null."""
    hexed = F.regexp_extract(style, r"(?U)color:\s*#([0-9A-Fa-f]{6})", 1)
    return F.coalesce(from_hex(F.nullif(hexed, F.lit(""))), _bytes_match(
        style, r"(?U)color:\s*rgb\((\d+),\s*(\d+),\s*(\d+)\)"))


def rgb_text(color: Column) -> Column:
    """``RGB(r, g, b)`` in 0-255, or N/A."""
    text = F.concat(F.lit("RGB("), _byte(color["r"]).cast("string"), F.lit(", "),
                    _byte(color["g"]).cast("string"), F.lit(", "),
                    _byte(color["b"]).cast("string"), F.lit(")"))
    return F.coalesce(text, F.lit("N/A"))


def _two_places(channel: Column) -> Column:
    # format_number rounds the binary value half to even
    return F.replace(F.format_number(channel, 2), F.lit(","), F.lit(""))


def _fraction_text(color: Column, gap: str) -> Column:
    return F.concat(F.lit("RGB("), _two_places(color["r"]), F.lit("," + gap),
                    _two_places(color["g"]), F.lit("," + gap), _two_places(color["b"]), F.lit(")"))


def _near(channel: Column, target: float, margin: float) -> Column:
    return F.abs(channel - target) < margin


# Name, then target and margin of each channel; the first hit wins.
COLOR_BANDS = (
    ("Blue", (0, 0.1), (0, 0.1), (1.0, 0.1)),
    ("Red", (1.0, 0.1), (0, 0.1), (0, 0.1)),
    ("Green", (0, 0.1), (0.5, 0.2), (0, 0.1)),
    ("Cyan", (0.75, 0.1), (1.0, 0.1), (1.0, 0.1)),
    ("Black", (0, 0.1), (0, 0.1), (0, 0.1)),
    ("Purple", (0.5, 0.2), (0, 0.2), (0.5, 0.2)),
    ("Orange", (1.0, 0.1), (0.5, 0.2), (0, 0.1)),
)


def color_name(color: Column) -> Column:
    rule = F.when(color.isNull(), F.lit("Unknown"))
    for name, red, green, blue in COLOR_BANDS:
        rule = rule.when(_near(color["r"], *red) & _near(color["g"], *green)
                         & _near(color["b"], *blue), F.lit(name))
    return rule.otherwise(_fraction_text(color, " "))


def output_class(color: Column) -> Column:
    """RED, BLUE or the numbers; null without a colour."""
    return (F.when(color.isNull(), F.lit(None))
            .when(_near(color["r"], 1, 0.1) & _near(color["g"], 0, 0.1) & _near(color["b"], 0, 0.1),
                  F.lit("RED"))
            .when(_near(color["r"], 0, 0.1) & _near(color["g"], 0, 0.1) & _near(color["b"], 1, 0.1),
                  F.lit("BLUE"))
            .otherwise(_fraction_text(color, "")))


def byte_class(color: Column) -> Column:
    """RED, BLUE, BLACK, GREEN by exact 0-255 value, else OTHER."""
    r, g, b = _byte(color["r"]), _byte(color["g"]), _byte(color["b"])
    rule = F.when((r == 255) & (g == 0) & (b == 0), F.lit("RED"))
    rule = rule.when((r == 0) & (g == 0) & (b == 255), F.lit("BLUE"))
    rule = rule.when((r == 0) & (g == 0) & (b == 0), F.lit("BLACK"))
    return rule.when((r == 0) & (g == 255) & (b == 0), F.lit("GREEN")).otherwise(F.lit("OTHER"))


def domain_color(domain: Column, red_domains) -> Column:
    """Red hex for listed domains, blue for all others and for none."""
    return F.when(domain.isin(*red_domains), F.lit("#FF0000")).otherwise(F.lit("#0000FF"))


def round_color(color: Column, digits: int = 3) -> Column:
    return rgb(*(F.bround(color[c], digits) for c in ("r", "g", "b")))
