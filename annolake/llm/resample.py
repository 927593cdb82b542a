"""Importance resampling towards a target: hashed n-grams of words, gains, one draw.

Features of a text are its runs of 1 to ``ORDER`` consecutive words, told by ``BUCKETS``
buckets of a checksum.  A bucket's gain compares its share in the target texts with its
share in all documents; a document's weight is the sum of its features' gains, and the
documents of highest weight plus Gumbel noise (from a hash of the id) are drawn, which
samples without replacement in proportion to the importance.

How texts are read (*batch concatenation*): the texts of a batch are joined with a
sentinel between them that no word holds; one regex pass splits all of it into words and
what lies between; the words' places are looked up among the documents' offsets, and
n-grams whose first and last word lie in different documents are masked before the
buckets are counted.  The checksum of an n-gram comes from its words' checksums by a
table (appending k bytes is linear in the bits), so no n-gram is ever built as text.  A
text longer than ``PIECE`` bytes is cut between words and carries its last words along.

How it runs: each task counts buckets (10,000 numbers), Spark adds them up, and the
10,000 gains are all that goes back out; a second pass over the texts makes one narrow
row for each document.  The draw sorts these rows by ranges of (score, doc_id), and a
row's rank is its place in its range plus the sizes of the ranges before.

Null texts and texts without words have no features and the weight 0.  Rows that repeat
a doc_id are rows of their own; rows without one are counted and scored but have no
noise, so no score, and are not drawn.  Extra columns are ignored; an empty table gives
no rows; with an empty target all counts of the target are 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annolake.llm.common import pieces, written
from annolake.llm.wordhash import arrow_bytes
from annolake.session import small_table

ORDER, BUCKETS = 3, 10_000
#: Words that a document needs to be drawn, and how many in a hundred are.
LEAST, PERCENT = 20, 5
#: Bytes of text joined at a time.
PIECE = 1 << 21
_SENTINEL = b"\x00"
#: Splits bytes into gaps and words (every byte of a character beyond ASCII is of a word).
_SPLIT = re.compile(rb"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")
#: Where a text may be cut; capitals are not lowered yet there.
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WIDE = 64


def _appended(steps: int) -> np.ndarray:
    """What ``steps`` zero bytes make of each bit of a checksum, as 4 tables of 256."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    values = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(steps):
        values = (values >> np.uint32(8)) ^ byte[values & 0xFF]
    return values


#: (bytes appended, byte of the checksum, its value).
_APPENDED = np.stack([_appended(k) for k in range(_WIDE + 1)])


def _shift(sums: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The checksums after so many zero bytes each."""
    now, out = np.minimum(by, _WIDE), np.zeros(len(sums), np.uint32)
    for k in range(4):
        out ^= _APPENDED[now, k, (sums >> np.uint32(8 * k)) & np.uint32(0xFF)]
    more = np.flatnonzero(by > _WIDE)
    left = by[more] - _WIDE
    while len(more):  # the few long words
        now = np.minimum(left, _WIDE)
        out[more] = _shift(out[more], now)
        left, more = (left - now)[left > now], more[left > now]
    return out


_BLANK = np.uint32(zlib.crc32(b" "))
_ONE = _APPENDED[1]


def _with_blank(sums: np.ndarray) -> np.ndarray:
    part = _BLANK
    for k in range(4):
        part = part ^ _ONE[k, (sums >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return part


def words_of(joined: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Checksum, length and text number of every word; ``ends``: where each text's
    sentinel stands."""
    parts = _SPLIT.split(joined.lower())
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    places = (np.cumsum(sizes) - sizes)[1::2]
    sums = np.fromiter(map(zlib.crc32, parts[1::2]), np.uint32, len(parts) // 2)
    return sums, sizes[1::2], np.searchsorted(ends, places, "right")


def features(sums: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, place of the last word) of all n-grams that lie within one text, by length."""
    told = sums
    yield (told % np.uint32(BUCKETS)).astype(np.int64), np.arange(len(sums))
    for n in range(2, ORDER + 1):
        if len(sums) < n:
            return
        told = _shift(_with_blank(told[:-1]), sizes[n - 1:]) ^ sums[n - 1:]
        inside = np.flatnonzero(owner[n - 1:] == owner[:len(owner) - n + 1])
        yield (told[inside] % np.uint32(BUCKETS)).astype(np.int64), inside + n - 1


def _joined(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, bool]]:
    """(texts joined, places of the sentinels, rows, whether the first goes on with the
    text before), about ``PIECE`` bytes at a time."""
    data, ends = arrow_bytes(texts)
    buffer = data.tobytes()
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    row, n = 0, len(ends)
    while row < n:
        if ends[row] - starts[row] > PIECE:
            at, first = int(starts[row]), True
            while at < ends[row]:
                cut = min(at + PIECE, int(ends[row]))
                if cut < ends[row]:
                    gap = _GAP.search(buffer, cut, int(ends[row]))
                    cut = gap.start() if gap else int(ends[row])
                yield buffer[at:cut], np.array([cut - at]), np.array([row]), not first
                at, first = cut, False
            row += 1
            continue
        to = max(row + 1, int(np.searchsorted(ends, starts[row] + PIECE, "right")))
        sizes = ends[row:to] - starts[row:to]
        yield (_SENTINEL.join(buffer[s:e] for s, e in zip(starts[row:to], ends[row:to])),
               np.cumsum(sizes + 1) - 1, np.arange(row, to), False)
        row = to


def _read(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(rows, words of each, (bucket, row) of the features) of joined texts.

    A text in several pieces brings its last words along, so every n-gram is met once."""
    carried = None
    for joined, ends, rows, goes_on in _joined(texts):
        sums, sizes, owner = words_of(joined, ends)
        old = 0
        if goes_on and carried is not None:
            old = len(carried[0])
            sums, sizes = np.concatenate([carried[0], sums]), np.concatenate([carried[1], sizes])
            owner = np.concatenate([np.zeros(old, np.int64), owner])
        found = []
        for bucket, last in features(sums, sizes, owner):
            new = last >= old
            found.append((bucket[new], owner[last[new]]))
        yield rows, np.bincount(owner[old:], minlength=len(rows)), found
        carried = (sums[-(ORDER - 1):], sizes[-(ORDER - 1):]) if len(rows) == 1 else None


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, found in _read(batch.column(0)):
            for bucket, _ in found:
                total += np.bincount(bucket, minlength=BUCKETS)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])


def counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) of all features of ``text``."""
    return (texts.select("text").mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """Each bucket's gain, in thousandths, down to whole numbers."""
    every = small_table(documents.sparkSession, [(b,) for b in range(BUCKETS)], "bucket long")
    kinds = counts(documents).withColumn("t", F.lit(0)).unionByName(counts(target).withColumn("t", F.lit(1)))
    side = lambda t: F.sum(F.when(F.col("t") == t, F.col("n")).otherwise(0))
    sides = written(kinds.groupBy("bucket").agg(side(0).alias("s"), side(1).alias("t")), "bucket-counts", 1024)
    total = sides.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("s", "t"))).collect()[0]
    of = lambda c: F.coalesce(c, F.lit(0)).cast("double") + 1
    ratio = of("t") * F.lit(float(total.s + BUCKETS)) / (of("s") * F.lit(float(total.t + BUCKETS)))
    out = np.zeros(BUCKETS, np.int64)
    for r in every.join(sides, "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, grams, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, count, found in _read(batch.column(1)):
                words[rows] += count
                for bucket, owner in found:
                    grams[rows] += np.bincount(owner, minlength=len(rows))
                    # whole numbers far below 2**53, so adding them as doubles is exact
                    weight[rows] += np.bincount(owner, gain[bucket], len(rows)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, grams, weight))],
                                             ["doc_id", "n_words", "n_features", "weight"])
    return run


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("42:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 in a global order: ranges of rows, then their sizes.
    The driver holds one number for each range."""
    n = pieces(rows.sparkSession)
    placed = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
                     .withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    starts = small_table(rows.sparkSession, starts, "__part long, __before long")
    return (placed.join(starts, part == F.col("__part")).withColumn("rank", F.col("__before") + place + 1)
            .drop("__at", "__part", "__before"))


def weigh(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.mapInArrow(_weights(gains(documents, target)), "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def resample(documents: DataFrame, target: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """``weigh`` with ``rank`` of the drawn rows, null for the others."""
    rows = written(weigh(documents, target), "weights", 1024)
    may = F.coalesce((F.col("n_words") >= least) & F.col("score").isNotNull(), F.lit(False))
    n = rows.filter(F.col("n_words") >= least).count() * percent // 100
    # equal rows are many keys to the ranges, and any order of them is one
    placed = ranked(rows.filter(may).withColumn("__row", F.monotonically_increasing_id()), F.desc("score"), F.asc("doc_id"), F.asc("__row"))
    rank = F.when(F.col("rank") <= n, F.col("rank"))
    return placed.drop("__row").withColumn("rank", rank).unionByName(rows.filter(~may).withColumn("rank", F.lit(None).cast("long")))
