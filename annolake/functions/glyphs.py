"""Text widths and word wrap in Arrow batches.

A width is a sum over characters looked up in a table, which numpy does for a whole batch
at once; wrapping is a short loop over the words of one text.  Both are small functions on
rows, dealt out by Spark like any other expression.
"""

from __future__ import annotations

import math
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

# tasks get these functions themselves, so workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that follow the first one of a character have no width of their own.
_FOLLOWING = slice(0x80, 0xC0)


def byte_widths(by_code: tuple[int, ...], default: int) -> np.ndarray:
    """Width of each byte of a UTF-8 text, but for the second byte of code points 128 to 255."""
    table = np.full(256, default, dtype=np.int64)
    table[:128] = by_code[:128]
    table[_FOLLOWING] = 0
    table[0xC2:0xC4] = 0
    return table


def units_of(texts: pa.Array, by_code: tuple[int, ...], default: int) -> np.ndarray:
    """Width of each text (0 for null) in thousandths of the font size."""
    texts = texts.cast(pa.large_string())
    if not len(texts):  # an empty batch may come without buffers
        return np.zeros(0, dtype=np.int64)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    codes = np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    widths = byte_widths(by_code, default)[codes]
    # 0xC2 and 0xC3 begin the code points 128 to 255: their width stands at the second byte
    latin = np.flatnonzero((codes == 0xC2) | (codes == 0xC3))
    latin = latin[latin + 1 < len(codes)]
    widths[latin + 1] = np.asarray(by_code, dtype=np.int64)[((codes[latin] & 0x03).astype(np.int64) << 6) | (codes[latin + 1] & 0x3F)]
    total = np.concatenate(([0], np.cumsum(widths)))
    return total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]


@lru_cache
def units(by_code: tuple[int, ...], default: int):
    """Function of a text column: its width in thousandths of the font size, null for null."""
    @F.arrow_udf("long")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array(units_of(texts, by_code, default), mask=np.asarray(texts.is_null()))

    return measured


@lru_cache
def units_by_name(fonts: tuple[tuple[tuple[str, ...], tuple[int, ...], int], ...]):
    """The same of text and font name; null for unknown fonts too."""
    @F.arrow_udf("long")
    def measured(texts: pa.Array, names: pa.Array) -> pa.Array:
        values, unknown = np.zeros(len(texts), dtype=np.int64), np.ones(len(texts), dtype=bool)
        lower = pc.utf8_lower(names)
        for known, by_code, default in fonts:
            named = np.asarray(pc.fill_null(pc.is_in(lower, pa.array(known, lower.type)), False))
            if named.any():
                values[named] = units_of(texts.filter(pa.array(named)), by_code, default)
                unknown &= ~named
        return pa.array(values, mask=unknown | np.asarray(texts.is_null()))

    return measured


def wrap(text: str, size: float, limit: float, width_of) -> tuple[list[str], float]:
    """Greedy fill by word: the lines, and the width of the widest.

    An over-long word at a line's start stands alone.  ``width_of`` gives a word's width in
    thousandths of the size.
    """
    blank = width_of(" ") * size / 1000.0
    lines, line, wide, widest = [], [], 0.0, 0.0
    for word in text.split():
        own = width_of(word) * size / 1000.0
        width = wide + blank + own if line else own
        if width <= limit:
            line.append(word)
            wide = width
        elif line:
            lines.append(" ".join(line))
            widest = max(widest, wide)
            line, wide = [word], own
        else:
            lines.append(word)
            widest = max(widest, own)
    if line:
        lines.append(" ".join(line))
        widest = max(widest, wide)
    return lines, widest


def _of_word(by_code: tuple[int, ...], default: int):
    of = {chr(code): width for code, width in enumerate(by_code)}
    return lambda word: sum([of.get(c, default) for c in word])


def _wrap_all(fonts, texts: pa.Array, sizes: pa.Array, limits: pa.Array, names=None):
    """Lines and greatest width of each text, null for null.  Where the limit is not known, or the
    font has no metrics, nothing fits and each word is a line; nothing is wider than NaN."""
    by_name = {name: _of_word(by_code, default) for known, by_code, default in fonts for name in known}
    only = None if names is not None else next(iter(by_name.values()), None)
    listed = None if names is None else pc.utf8_lower(names).to_pylist()
    for i, (text, size, limit) in enumerate(zip(texts.to_pylist(), sizes.to_pylist(), limits.to_pylist())):
        width_of = only if listed is None else by_name.get(listed[i])
        if text is None:
            yield None
        elif width_of is None or size is None:
            yield text.split(), 0.0
        else:
            limit = -math.inf if limit is None else math.inf if math.isnan(limit) else limit
            yield wrap(text, size, limit, width_of)


@lru_cache
def wrapped_lines(fonts: tuple[tuple[tuple[str, ...], tuple[int, ...], int], ...]):
    """Function of text, size, limit and, with several fonts, the font's name: the wrapped lines."""
    @F.arrow_udf("array<string>")
    def folded(*columns: pa.Array) -> pa.Array:
        return pa.array([f and f[0] for f in _wrap_all(fonts, *columns)], pa.list_(pa.string()))

    return folded


@lru_cache
def wrapped_size(fonts: tuple[tuple[tuple[str, ...], tuple[int, ...], int], ...]):
    """Function of the same: ``{lines, widest}``."""
    @F.arrow_udf("struct<lines:int,widest:double>")
    def folded(*columns: pa.Array) -> pa.Array:
        found = list(_wrap_all(fonts, *columns))
        return pa.StructArray.from_arrays(
            [pa.array([f and len(f[0]) for f in found], pa.int32()), pa.array([f and f[1] for f in found], pa.float64())],
            names=["lines", "widest"])

    return folded
