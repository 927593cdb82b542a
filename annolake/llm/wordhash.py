"""Words of many texts as 64-bit hashes, without a Python loop over words.

A word is a run of bytes without ASCII white space, A-Z lower-cased.  Its hash is
a polynomial over random 64-bit values of its bytes, taken as a difference of one
running sum and then mixed; only the hash stands for the word from here on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a single longer word is taken whole.  A worker keeps
#: powers for each between tasks, 16 bytes, and needs several times that while it hashes.
WINDOW = 1 << 18
_rng = np.random.default_rng(20)
_VALUE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_powers = {"n": 0}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if _powers["n"] < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
        _powers["n"] = n
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one place more).

    ``data``: the texts' bytes one after another; ``ends``: where each text ends.
    """
    hashes, places, at, n = [], [], 0, len(data)
    edge = np.zeros(n + 1, bool)
    edge[ends] = True
    edge[n] = True
    while at < n:
        stop = min(n, at + WINDOW)
        while stop < n and not (edge[stop] or _SPACE[data[stop]] or _SPACE[data[stop - 1]]):
            stop += 1
        piece = data[at:stop]
        inside = ~_SPACE[piece]
        cut = edge[at:stop + 1]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | cut[1:-1]
        over = inside.copy()
        over[:-1] &= ~inside[1:] | cut[1:-1]
        s, e = np.flatnonzero(starts), np.flatnonzero(over) + 1
        up, down = _power(len(piece))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUE[piece] * up[:len(piece)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        places.append(s + at)
        at = stop
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    return hashes, np.concatenate([[0], np.searchsorted(places, ends)])


def arrow_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column's bytes and each text's end; null texts are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]], (ends - ends[0])[1:]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about ``most`` bytes of text, or of one longer text."""
    _, ends = arrow_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + most, "right")))
        yield batch.slice(at, to - at)
        at = to


_C = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; a shorter text is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total += mix(hashes[k:n - width + 1 + k] + _C[k]) * _C[k]
    return mix(total)
