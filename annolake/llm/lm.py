"""Language-model scores by stupid backoff, from counts over all documents.

The model has two orders.  With c the counts over all documents, a word w after u
scores c(u w) / c(u) where c(u w) is ``MIN_COUNT`` or more, and ``BACKOFF`` c(w) / N
elsewhere; the first word of a text comes after a mark of its own.  A document's score
is the sum of the logarithms over its words.

1. *Unigram table*: words counted in each task, then by Spark; written.
2. *Bigram table and its join*: every task deals its exploded bigrams out by hash into
   packed rows (a row for each piece of text and bucket).  A bucket has all occurrences
   of its bigrams, so it counts them and looks each one up at once: table and join share
   one shuffle.  What it knows is summed for each document; where the context's count is
   missing, (document, context) goes on to
3. a join with the unigram table, and all parts are summed by document.

Words with at least 1 / ``HOT`` of all occurrences (so ``HOT`` at most) are known to
every task with their counts.  A bigram of two such words is dealt out by both, so no
word, however frequent, fills one bucket; a bigram with one other word by that word,
whose pieces' counts travel along; one of two others by w.  Only bigrams of the last
kind that occur ``MIN_COUNT`` times need the join.  Buckets follow the session's shuffle
partitions.

Words are told by 48 bits of a hash: of a billion different words two thousand would
share one.  Null and blank texts have no words and the score 0.  Rows that repeat a
doc_id count as one document with several texts; rows without one are counted in the
tables and have no score.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annolake.llm.common import pieces, written
from annolake.llm.wordhash import arrow_bytes, mix, slices, word_hashes

MIN_COUNT, BACKOFF, HOT = 2, 0.4, 16384
BITS = np.uint64((1 << 48) - 1)
#: The context of a text's first word; words' hashes are below it.
START = (1 << 48) - 1
RARE = 65535
#: Bytes of text packed together.
PIECE = 1 << 22


def _words(piece: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = word_hashes(*arrow_bytes(piece.column(column)))
    return np.minimum(hashes & BITS, np.uint64(START - 1)), at


def _counted(parts: list) -> tuple[np.ndarray, np.ndarray]:
    words, counts = (np.concatenate(c) for c in zip(*parts))
    unique, place = np.unique(words, return_inverse=True)
    return unique, np.bincount(place, counts, len(unique)).astype(np.int64)


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(parts):
        words, counts = _counted(parts)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

    parts, held = [], 0
    for batch in batches:
        for piece in slices(batch, 0):
            words, at = _words(piece, 0)
            if not len(words):
                continue
            texts = np.array([np.count_nonzero(np.diff(at))])
            parts += [np.unique(words, return_counts=True), (np.array([START], np.uint64), texts)]
            held += len(parts[-2][0])
            if held > 1 << 21:
                parts = [_counted(parts)]
                if len(parts[0][0]) > 1 << 20:
                    yield row(parts)
                    parts = []
                held = len(parts[0][0]) if parts else 0
    if parts:
        yield row(parts)


def _six(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _zip(*parts: bytes) -> bytes:
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    body = b"".join(parts)
    return np.array([len(head) + len(body)], "<u4").tobytes() + pa.compress(head + body, "zstd", asbytes=True)


def _unzip(data: bytes) -> list[bytes]:
    body = pa.decompress(data[4:], int(np.frombuffer(data[:4], "<u4")[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(body[:4], "<u4")[0])
    ends = 4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(body[4:4 + 4 * n], "<u4").astype(np.int64))])
    return [body[a:b] for a, b in zip(ends, ends[1:])]


def _find(hot: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place among the sorted hot words, or ``RARE``."""
    if not len(hot):
        return np.full(len(words), RARE, np.uint16)
    at = np.searchsorted(hot, words)
    at[at == len(hot)] = 0
    return np.where(hot[at] == words, at, RARE).astype(np.uint16)


def _deal(hot: np.ndarray, buckets: int):
    """(bucket, bigrams): the packed bigrams of a piece of text that fall into a bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1, PIECE):
                for at in range(0, piece.num_rows, RARE):  # documents are numbered in 16 bits
                    yield from pack(piece.slice(at, RARE))

    def place(words: np.ndarray) -> np.ndarray:
        return (mix(words) % np.uint64(buckets)).astype(np.int64)

    def cut(bucket: np.ndarray) -> np.ndarray:
        return np.searchsorted(bucket, np.arange(buckets + 1))

    def pack(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        word, at = _words(piece, 1)
        if not len(word):
            return
        before = np.concatenate([[np.uint64(START)], word[:-1]])
        before[at[:-1][np.diff(at) > 0]] = START
        doc = np.repeat(np.arange(piece.num_rows, dtype=np.uint16), np.diff(at))
        context, own = _find(hot, before), _find(hot, word)
        # all rare words of the piece, the mark among them, with their occurrences
        rare, count = np.unique(np.append(word[own == RARE], before[before == START][:np.count_nonzero(np.diff(at))]), return_counts=True)
        rare, count = rare[_find(hot, rare) == RARE], count[_find(hot, rare) == RARE]
        home = place(rare)
        order = np.lexsort((rare, home))
        rare, count, home = rare[order], count[order], home[order]
        parts = [(cut(home), (rare, count))]
        for rows, key in ((own == RARE, word), ((own != RARE) & (context == RARE), before),
                          ((own != RARE) & (context != RARE), word + mix(before))):
            key, rows = key[rows], np.flatnonzero(rows)
            home = place(key)
            order = np.lexsort((key, home))
            rows = rows[order]
            parts.append((cut(home[order]), (rows,)))
        ids = piece.column(0)
        ids = ids.fill_null(0).to_numpy().astype("<i8").tobytes() + np.asarray(ids.is_null(), np.uint8).tobytes()
        out, numbers = [], []
        for b in range(buckets):
            words_of, by_word, by_context, both = (slice(c[b], c[b + 1]) for c, _ in parts)
            w, c, m = parts[1][1][0][by_word], parts[2][1][0][by_context], parts[3][1][0][both]
            names = rare[words_of]
            if len(w) + len(c) + len(m) + len(names) == 0:
                continue
            out.append(_zip(
                ids, _six(names), count[words_of].astype("<u4").tobytes(),
                _runs(names, word[w]), context[w].tobytes(), _six(before[w][context[w] == RARE]), doc[w].tobytes(),
                _runs(names, before[c]), own[c].tobytes(), doc[c].tobytes(),
                context[m].tobytes(), own[m].tobytes(), doc[m].tobytes()))
            numbers.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(out, pa.binary())], ["bucket", "bigrams"])
    return run


def _runs(names: np.ndarray, words: np.ndarray) -> bytes:
    """How many of the sorted words are each of the sorted names."""
    return (np.searchsorted(words, names, "right") - np.searchsorted(words, names, "left")).astype("<u4").tobytes()


def _score(hot: np.ndarray, hot_counts: np.ndarray, total: int, least: int, backoff: float):
    """(doc_id, word, n, value): sums for each document of a bucket, without a word, and
    how often it needs the logarithm of a context's count subtracted."""
    counts = np.append(hot_counts, 1)

    def run(table: pa.Table) -> pa.Table:
        words, contexts, places, docs, names, times, shift = [], [], [], [], [], [], 0
        code = lambda data: np.frombuffer(data, np.uint16)
        for data in table.column("bigrams"):
            (ids, named, seen, runs, context, rare, doc, runs_of, own, doc_of, contexts_hot, own_hot, doc_hot) = _unzip(data.as_py())
            n = len(ids) // 9
            docs.append((np.frombuffer(ids[:8 * n], "<i8"), np.frombuffer(ids[8 * n:], np.uint8).astype(bool)))
            owners = _eight(named)
            names.append(owners)
            times.append(np.frombuffer(seen, "<u4").astype(np.int64))
            context = code(context)
            before = np.zeros(len(context), np.uint64)
            if len(hot):
                before[context != RARE] = hot[context[context != RARE]]
            before[context == RARE] = _eight(rare)
            words += [np.repeat(owners, np.frombuffer(runs, "<u4")), hot[code(own)], hot[code(own_hot)]]
            contexts += [before, np.repeat(owners, np.frombuffer(runs_of, "<u4")), hot[code(contexts_hot)]]
            places += [code(d).astype(np.int64) + shift for d in (doc, doc_of, doc_hot)]
            shift += n
        word, before, place = map(np.concatenate, (words, contexts, places))
        del words, contexts, places
        ids, missing = map(np.concatenate, zip(*docs))
        owned, seen = _counted([(np.concatenate(names), np.concatenate(times))])

        def count(values: np.ndarray) -> np.ndarray:
            """Occurrences of words that are hot or belong to this bucket, 0 of others."""
            at = _find(hot, values)
            found = counts[np.minimum(at, len(hot_counts))]
            rare = at == RARE
            here = np.minimum(np.searchsorted(owned, values[rare]), max(0, len(owned) - 1))
            found[rare] = np.where(owned[here] == values[rare], seen[here], 0) if len(owned) else 0
            return found

        _, pair, both = np.unique(mix(word) + before * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
        together = both[pair]
        del pair, both
        kept, above = together >= least, count(before)
        value = np.where(kept, np.log(together) - np.log(np.maximum(above, 1)),
                         np.log(backoff) + np.log(np.maximum(count(word), 1)) - np.log(total))
        sums, n = np.bincount(place, value, shift), np.bincount(place, minlength=shift)
        some = np.flatnonzero((n > 0) & ~missing)
        later = np.flatnonzero(kept & (above == 0) & ~missing[place])
        # a document that meets a context several times here is one row
        order = later[np.lexsort((before[later], place[later]))]
        new = np.concatenate([[True], (place[order][1:] != place[order][:-1]) | (before[order][1:] != before[order][:-1])])
        first = np.flatnonzero(new[:len(order)])
        often = np.diff(np.concatenate([first, [len(order)]]))
        order = order[first]
        return pa.table({
            "doc_id": np.concatenate([ids[some], ids[place[order]]]),
            "word": pa.array(np.concatenate([np.zeros(len(some), np.int64), before[order].view(np.int64)]),
                             mask=np.arange(len(some) + len(order)) < len(some)),
            "n": np.concatenate([n[some], np.zeros(len(order), np.int64)]),
            "value": np.concatenate([sums[some], -often.astype(float)])})
    return run


def unigrams(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; the text mark counts texts with words."""
    return (docs.select("text").mapInArrow(_unigrams, "word long, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def score(docs: DataFrame, least: int = MIN_COUNT, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, log_score) of every document under the model of all of them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = written(unigrams(docs), "unigrams")
    total = table.filter(F.col("word") != START).agg(F.sum("n")).first()[0] or 1
    rows = table.filter(F.col("n") * HOT >= total).orderBy("word").collect()
    hot, counts = np.array([r.word for r in rows], np.uint64), np.array([r.n for r in rows], np.int64)
    packed = docs.mapInArrow(_deal(hot, 2 * pieces(docs.sparkSession)), "bucket int, bigrams binary")
    parts = packed.groupBy("bucket").applyInArrow(_score(hot, counts, total, least, backoff),
                                                  "doc_id long, word long, n long, value double")
    parts = written(parts, "parts")
    later = parts.filter("word is not null").join(table.withColumnRenamed("n", "seen"), "word").select(
        "doc_id", "n", (F.col("value") * F.log("seen")).alias("value"))
    sums = (parts.filter("word is null").select("doc_id", "n", "value").unionByName(later)
            .groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("value").alias("value")))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    return ids.join(sums, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_words"), F.coalesce("value", F.lit(0.0)).alias("log_score"))
