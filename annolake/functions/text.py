"""Text expressions: cleaning, quoting, headers, domains, conditions, previews.

All of it is JVM-side but HTML unescaping, which goes to Python in Arrow
batches and only for texts that hold an ampersand.

Java regex flags used below: ``U`` makes ``\\s`` and ``\\d`` follow Unicode,
``d`` makes ``.`` and ``$`` treat only ``\\n`` as a line end, ``i`` with ``u``
ignores case for all letters.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Every character that counts as white space when text is stripped.
WHITESPACE = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ZERO_WIDTH = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF)))

# Domain codes looked for in free text, in search order.
RED_DOMAINS = ("FA", "AE", "DS", "DD", "MH")
BLUE_DOMAINS = ("CM", "DM", "EX", "SV", "EG", "IE", "LB", "PE", "QS", "SC", "TS", "TV",
                "VS", "CE", "DA", "DV", "HO", "MB", "MO", "RP", "RS", "TU", "UR")
# Formats shared with the documents this library reads and writes.
HEADER_PATTERN = r"^([A-Z]{2})\s*=\s*([^=]+)$"
HEADER_SIZE, TEXT_SIZE = 12, 10
DEFAULT_AUTHOR = "Annotator"


def nonblank(col: Column) -> Column:
    """Null for the empty string: both mean "missing" here."""
    return F.nullif(col, F.lit(""))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescape(col: Column) -> Column:
    """HTML entities to characters; only texts with ``&`` travel to Python."""
    return F.coalesce(_unescape(F.when(F.contains(col, F.lit("&")), col)), col)


def clean_text(col: Column, rule: str = "full") -> Column:
    """Normalise white space.

    ``full`` unescapes entities, drops zero-width characters and squeezes every
    run of white space to one blank.  ``simple`` is the earlier rule: drop CR,
    turn LF into a blank, trim.
    """
    if rule == "simple":
        return strip(F.translate(col, "\n\r", " "))
    if rule != "full":
        raise ValueError(f"unknown cleaning rule {rule!r}")
    return _squeeze(unescape(col))


def _squeeze(col: Column) -> Column:
    plain = F.translate(col, ZERO_WIDTH, "")
    return strip(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " "))


def with_clean_text(df: DataFrame, source: str = "content", out: str = "content",
                    rule: str = "full") -> DataFrame:
    """Add the cleaned text as a column that later filters do not compute again.

    Spark moves a filter below a projection by repeating its expression, here
    with the trip to Python; it does not move one below an explode.
    """
    others = [F.col(c) for c in df.columns if c != out]
    if rule != "full":
        return df.select(*others, F.explode_outer(F.array(clean_text(F.col(source), rule))).alias(out))
    rows = df.select(*others, unescape(F.col(source)).alias("_plain"))
    return rows.select(*others, F.explode_outer(F.array(_squeeze(F.col("_plain")))).alias(out))


# --- headers ---------------------------------------------------------------

def is_header(col: Column) -> Column:
    """``XX = label`` with no quote right of the equals sign (prefix match)."""
    text = strip(col)
    # left of the first "=" only letters and blanks can stand, so a quote
    # anywhere is a quote on the right
    return F.coalesce(text.rlike(r"(?Ud)^[A-Z]{2}\s*=\s*.+")
                      & ~F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')),
                      F.lit(False))


def header_code(col: Column, pattern: str = HEADER_PATTERN) -> Column:
    """Domain code of a strict header, else null."""
    return nonblank(F.regexp_extract(col, "(?Ud)" + pattern, 1))


def header_label(col: Column, pattern: str = HEADER_PATTERN) -> Column:
    return F.when(header_code(col, pattern).isNotNull(),
                  strip(F.regexp_extract(col, "(?Ud)" + pattern, 2)))


def header_font_size(col: Column, header_size: float = HEADER_SIZE,
                     text_size: float = TEXT_SIZE) -> Column:
    return F.when(is_header(col), F.lit(header_size)).otherwise(F.lit(text_size))


def author_or_default(col: Column, default: str = DEFAULT_AUTHOR) -> Column:
    return F.when(nonblank(strip(col)).isNull(), F.lit(default)).otherwise(col)


def upper_non_header(col: Column, pattern: str = HEADER_PATTERN) -> Column:
    return F.when(header_code(col, pattern).isNotNull(), col).otherwise(F.upper(col))


# --- quotes ----------------------------------------------------------------

# Noncharacters stand in for the quotes a step has just set, so that the
# following clean-up touches those values only.
_OPEN, _CLOSE = chr(0xFDD0), chr(0xFDD1)
_STOP = r"(?=\s+(?:when|and|or|[A-Z0-9_]+\s*=)|$)"


def _close_values(col: Column) -> Column:
    col = F.regexp_replace(col, rf"(?U){_OPEN}\s+", _OPEN)
    col = F.regexp_replace(col, rf"(?U)\s+{_CLOSE}", _CLOSE)
    col = F.regexp_replace(col, rf"(?iu){_OPEN}null{_CLOSE}", "NULL")
    return F.translate(col, _OPEN + _CLOSE, '""')


def normalize_quotes(col: Column) -> Column:
    """Blanks round ``=`` and double quotes round assigned values.

    Headers and ``RELREC when`` texts only get the blanks.  NULL stays bare.  A
    value ends before when / and / or, before the next assignment, or at the
    end; as ``or`` needs no word end there, ``A = red orange`` gives
    ``A = "red" orange``.
    """
    text = strip(col)
    spaced_only = F.regexp_replace(text, r"(?U)([A-Z0-9_]+)=([^=])", "$1 = $2")
    spaced = F.regexp_replace(text, r"(?U)([A-Z0-9_]+)=([^=\s])", "$1 = $2")
    quoted = _close_values(F.regexp_replace(
        spaced, r"(?iuUd)([A-Z0-9_]+)\s*=\s*[\"']([^\"']*?)[\"']?" + _STOP,
        f"$1 = {_OPEN}$2{_CLOSE}"))
    # one character class keeps the Java matcher iterative on very long texts
    bare = _close_values(F.regexp_replace(
        quoted, r"(?iuUd)([A-Z0-9_]+)\s*=\s*([^\s\"'=][^\"'=]*?)" + _STOP,
        f"$1 = {_OPEN}$2{_CLOSE}"))
    assigned = F.contains(text, F.lit("="))
    return (F.when(nonblank(col).isNull(), col)
            .when(~assigned, text)
            .when(is_header(text) | text.rlike(r"(?iuU)^RELREC\s+when\s+"), spaced_only)
            .otherwise(bare))


# --- domains in text -------------------------------------------------------

def infer_domain(variable: Column, is_dm: Column) -> Column:
    """Domain a variable name belongs to: DM if listed there, else its first two letters."""
    return (F.when(variable.isNull() | (F.length(variable) < 2), F.lit(None))
            .when(is_dm, F.lit("DM"))
            .otherwise(F.upper(F.substring(variable, 1, 2))))


def domain_from_text(col: Column, pattern: str = HEADER_PATTERN) -> Column:
    """Header code, else the first listed code the text mentions in one of four ways."""
    codes = RED_DOMAINS + BLUE_DOMAINS
    # every place where a listed code stands in one of the ways; places may overlap
    way = r"(?:(?=[A-Z]{2}(?: =|CAT))|(?<=SUPP)|\A)"
    named = F.regexp_extract_all(F.upper(col), F.lit(f"{way}(?=({'|'.join(codes)}))"), F.lit(1))
    first = F.get(F.array_intersect(F.array(*map(F.lit, codes)), named), F.lit(0))
    return F.coalesce(header_code(col, pattern), first)


def domain_from_words(col: Column) -> Column:
    """Code that begins the earliest word starting with a listed code."""
    codes = "|".join(RED_DOMAINS + BLUE_DOMAINS)
    return nonblank(F.regexp_extract(F.upper(col), rf"(?U)(?:^|\s)({codes})", 1))


# --- conditions ------------------------------------------------------------

def condition_pair(col: Column) -> Column:
    """``{left, right}`` when the condition has exactly one equals sign, else null."""
    parts = F.split(col, "=", -1)
    return F.when(F.size(parts) == 2,
                  F.named_struct(F.lit("left"), strip(parts[0]), F.lit("right"), strip(parts[1])))


def condition_tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit("([A-Z0-9_]+)"), F.lit(1))


# --- forms, previews, style ------------------------------------------------

FORM_PATTERN = r"(?Ud)Form:\s*(.+?)(?:\n|$)"


def marked_form_name(text: Column) -> Column:
    """Name after ``Form:``, null without that mark."""
    return F.when(text.rlike(FORM_PATTERN), strip(F.regexp_extract(text, FORM_PATTERN, 1)))


def form_name(text: Column, page: Column) -> Column:
    """Marked name, else the first of the first five lines with 4-99 characters, else the page."""
    head = F.slice(F.split(strip(text), "\n", 6), 1, 5)
    lines = F.filter(F.transform(head, strip),
                     lambda x: (F.length(x) > 3) & (F.length(x) < 100))
    return F.coalesce(marked_form_name(text), F.try_element_at(lines, F.lit(1)),
                      F.concat(F.lit("Page "), page.cast("string")))


def preview(col: Column, keep: int, longer_than: int | None = None) -> Column:
    """First ``keep`` characters and dots, for texts longer than ``longer_than``."""
    limit = keep if longer_than is None else longer_than
    return F.when(F.length(col) > limit,
                  F.concat(F.substring(col, 1, keep), F.lit("..."))).otherwise(col)


def position_text(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(),
                  F.concat(F.lit("("), x.cast("string"), F.lit(", "), y.cast("string"), F.lit(")"))
                  ).otherwise(F.lit(""))


def style_text(size: Column, color: Column, bold: bool = True, italic: bool = True,
               family: str = "Arial") -> Column:
    """Rich-text style attribute."""
    weight, slant = ("bold" if bold else "normal"), ("italic" if italic else "normal")
    return F.concat(F.lit("font-size:"), size.cast("string"), F.lit("pt;text-align:left;color:"),
                    color, F.lit(f";font-weight:{weight};font-style:{slant};"
                                 f"font-family:{family};font-stretch:normal"))


def escape_markup(col: Column) -> Column:
    """Escape for XML text and attributes; the ampersand goes first."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                        ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(raw), F.lit(entity))
    return col
