"""Text size: glyph widths, box dimensions, word wrapping.

Widths are the public metrics of the standard PDF fonts in thousandths of the
font size; a text's width is the sum over its characters, looked up by code
point in Arrow batches (``glyphs``).
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from annolake.functions import glyphs

# Public glyph widths, width -> characters.
HELVETICA_BOLD = {
    238: "'",
    278: " ,./\\Iijl",
    280: "|",
    333: "!()-:;[]`ft",
    389: "*r{}",
    474: '"',
    500: "z",
    556: "#$0123456789J_aceksvxy",
    584: "+<=>^~",
    611: "?FLTZbdghnopqu",
    667: "EPSVXY",
    722: "&ABCDHKNRU",
    778: "GOQw",
    833: "M",
    889: "%m",
    944: "W",
    975: "@",
}
HELVETICA = {
    191: "'",
    222: "ijl",
    260: "|",
    278: " !,./:;I[\\]ft",
    333: "()-`r",
    334: "{}",
    355: '"',
    389: "*",
    469: "^",
    500: "Jcksvxyz",
    556: "#$0123456789?L_abdeghnopqu",
    584: "+<=>~",
    611: "FTZ",
    667: "&ABEKPSVXY",
    722: "CDHNRUw",
    778: "GOQ",
    833: "Mm",
    889: "%",
    944: "W",
    1015: "@",
}


def _by_code(widths: dict[int, str], default: int) -> list[int]:
    """Width of each code point below 256, then that of all others.

    Accented Latin letters are as wide as their base letter; code 0 stands for
    "no character".
    """
    of = {c: w for w, chars in widths.items() for c in chars}
    table = [of.get(unicodedata.normalize("NFD", chr(code))[0], default) for code in range(256)]
    return [0] + table[1:] + [default]


@dataclass(frozen=True)
class Font:
    """Names a font goes by, its width classes and the width of all other characters."""

    names: tuple[str, ...]
    widths: dict[int, str] = field(hash=False)
    default: int

    @property
    def by_code(self) -> tuple[int, ...]:
        """Width of each code point below 256."""
        return tuple(_by_code(self.widths, self.default)[:256]) if self.widths else (self.default,) * 256

    @property
    def table(self) -> tuple[tuple[str, ...], tuple[int, ...], int]:
        return self.names, self.by_code, self.default

    def units(self, text: Column) -> Column:
        """Width of ``text`` in thousandths of the font size."""
        if not self.widths:
            return F.length(text) * self.default
        return glyphs.units(self.by_code, self.default)(text)


FONTS = (
    Font(("hebi", "hebo", "helvetica-bold", "helvetica-boldoblique"),
         HELVETICA_BOLD, 278),
    Font(("helv", "heit", "helvetica", "helvetica-oblique"), HELVETICA, 278),
    Font(("cour", "coit", "cobo", "cobi", "courier", "courier-bold", "courier-oblique",
          "courier-boldoblique"), {}, 600),
)
STANDARD_FONT = "hebi"


@dataclass(frozen=True)
class TextMeasurer:
    """Box sizes for texts.  Other fonts come in through ``fonts``.

    ``font`` may be a name or a column of names; ``size`` a number or a column.
    A font that is not listed has no metrics: its boxes use 0.6 of the size per
    character.
    """

    horizontal_padding: float = 4.0
    vertical_padding: float = 2.0
    line_spacing: float = 1.2
    fonts: tuple[Font, ...] = FONTS

    def width(self, text: Column, font, size) -> Column:
        """Width of one line in points, null for a font without metrics."""
        size = _col(size)
        if isinstance(font, str):
            for known in self.fonts:
                if font.lower() in known.names:
                    return known.units(text) * size / 1000.0
            return F.lit(None).cast("double")
        return glyphs.units_by_name(tuple(known.table for known in self.fonts))(text, font) * size / 1000.0

    def _unknown(self, font) -> Column:
        names = [name for known in self.fonts for name in known.names]
        if isinstance(font, str):
            return F.lit(font.lower() not in names)
        return ~F.coalesce(F.lower(font).isin(*names), F.lit(False))

    def _blank(self, text: Column) -> Column:
        return text.isNull() | (F.length(F.btrim(text)) == 0)

    def _box(self, width: Column, height: Column) -> Column:
        return F.struct(width.cast("double").alias("width"), height.cast("double").alias("height"))

    def _one_line(self, text: Column, size: Column, width: Column) -> Column:
        guess = F.length(text) * size * 0.6
        return self._box(F.coalesce(width, guess) + 2 * self.horizontal_padding,
                         size * self.line_spacing + 2 * self.vertical_padding)

    def dimensions(self, text: Column, font, size, max_width: Column | None = None,
                   line: Column | None = None) -> Column:
        """Box that holds the text; with a limit the line count is estimated from the width.

        ``line`` is the width of the text as one line, for callers that have it.
        """
        size = _col(size)
        width = self.width(text, font, size) if line is None else line
        blank = self._box(F.lit(2 * self.horizontal_padding), size + 2 * self.vertical_padding)
        single = self._one_line(text, size, width)
        if max_width is None:
            return F.when(self._blank(text), blank).otherwise(single)
        room = max_width - 2 * self.horizontal_padding
        room = F.when(room <= 0, max_width * 0.8).otherwise(room)
        lines = F.greatest(F.lit(1), (width / F.nullif(room, F.lit(0.0)) + 0.5).cast("int"))
        wrapped = self._box(max_width, lines * (size * self.line_spacing)
                            + 2 * self.vertical_padding)
        return (F.when(self._blank(text), blank)
                .when(width.isNull() | (width <= room) | (room == 0), single)
                .otherwise(wrapped))

    def fits(self, text: Column, font, size, width: Column, height: Column,
             line: Column | None = None) -> Column:
        """Does the text fit a box of this size, within half a point?"""
        need = self.dimensions(text, font, size, width, line)
        return F.when(self._blank(text), F.lit(True)).otherwise(
            (need["width"] <= width + 0.5) & (need["height"] <= height + 0.5))

    def _wrapped(self, fold, text: Column, font, size, max_width: Column) -> Column:
        columns = [text.cast("string"), _col(size).cast("double"), max_width.cast("double")]
        if isinstance(font, str):
            return fold(tuple(known.table for known in self.fonts if font.lower() in known.names))(*columns)
        return fold(tuple(known.table for known in self.fonts))(*columns, font)

    def wrapped_lines(self, text: Column, font, size, max_width: Column) -> Column:
        """Greedy fill by word; an over-long word at a line start stands alone."""
        lines = self._wrapped(glyphs.wrapped_lines, text, font, size, max_width)
        return F.when(self._blank(text), F.array().cast("array<string>")).otherwise(lines)

    def wrapped_size(self, text: Column, font, size, max_width: Column) -> Column:
        """``{lines, widest}`` of the wrapped text, without keeping the lines."""
        return self._wrapped(glyphs.wrapped_size, text, font, size, max_width)

    def optimal(self, text: Column, font, size, width: Column | None = None,
                line: Column | None = None) -> Column:
        """Single-line box, or with a width the box of the wrapped text."""
        size = _col(size)
        if width is None:
            return self.dimensions(text, font, size, line=line)
        wrapped = self.wrapped_size(text, font, size, width - 2 * self.horizontal_padding)
        blank = self._box(F.lit(2 * self.horizontal_padding), size + 2 * self.vertical_padding)
        unknown = self._unknown(font)
        return (F.when(self._blank(text), blank)
                .when(unknown, self.dimensions(text, font, size, width, line))
                .otherwise(self._box(
                    F.least(width, wrapped["widest"] + 2 * self.horizontal_padding),
                    wrapped["lines"] * (size * self.line_spacing) + 2 * self.vertical_padding)))


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def font_from_da(da: Column) -> Column:
    """``{name, size}`` of ``/Name size Tf``, the standard font at 10 without it."""
    pattern = r"(?U)/(\w+)\s+([\d.]+)\s+Tf"
    size = F.regexp_extract(da, pattern, 2).try_cast("double")
    return F.struct(
        F.when(size.isNotNull(), F.lower(F.regexp_extract(da, pattern, 1)))
        .otherwise(F.lit(STANDARD_FONT)).alias("name"),
        F.coalesce(size, F.lit(10.0)).alias("size"))


def font_for_table(da: Column) -> Column:
    """As above for the style table: name and size are looked up separately."""
    name = F.nullif(F.regexp_extract(da, "/([A-Za-z0-9-]+)", 1), F.lit(""))
    size = F.regexp_extract(da, r"(?U)(\d+(?:\.\d+)?)\s+Tf", 1).try_cast("double")
    return F.struct(F.coalesce(name, F.lit("Helvetica")).alias("name"),
                    F.coalesce(size, F.lit(10.0)).alias("size"))
