"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text come from numpy over the Arrow batch's bytes.  Trees are
fitted on the driver to a bounded sample of labelled rows: the ``SAMPLE`` rows of
smallest hashed doc_id, the same whatever the partitions.  Fitted trees are perfect
binary trees laid out in three arrays, and a batch is scored by walking all rows
through one tree at a time.

Null texts are empty and get the score of an empty text; a document labelled
several times counts with its lowest label; null labels are dropped; with no label
or only one kind every score is the rate of label 1 (0.5 without any).  Repeated
rows are scored each; all columns of the documents are kept, but one named like the
new column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annolake.llm.common import small_batches, written
from annolake.llm.wordhash import arrow_bytes, mix, slices, word_hashes

#: Whole texts that go to a Python worker at a time, at most.
TEXTS = 1024
#: Labelled rows that the trees are fitted to, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAF, RIDGE = 80, 4, 64, 0.15, 20, 1.0
THRESHOLD = 0.3

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "line": (10,),
            "space": (9, 11, 12, 13, 32), "stop": b".,;:?", "mark": b"!#$%&*+/<=>@\\^_`{|}~-\"'()[]",
            "high": range(128, 256)}
_TABLES = {name: np.isin(np.arange(256), list(members)) for name, members in _CLASSES.items()}
NAMES = ["chars", "words", "length", *(f"share_{n}" for n in _CLASSES), "distinct", "repeat", "again2", "top",
         "pairs", "capitals", "lines", "distinct_lines", "line_words", "long_words"]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each text, how many flags are set."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each owner, the number of different values and how often the commonest occurs."""
    if not len(values):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    key = np.sort(mix(values ^ (owner.astype(np.uint64) << np.uint64(40))) >> np.uint64(20) | owner.astype(np.uint64) << np.uint64(44))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.concatenate([first, [len(key)]]))
    who = (key[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, who, count)
    return np.bincount(who, minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of statistics (``NAMES``) for each text."""
    batch = pa.record_batch([texts], names=["text"])
    parts = [_statistics(*arrow_bytes(s.column(0))) for s in slices(batch, 0, 1 << 18)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.float32)


def _statistics(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n, starts = len(ends), np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size = ends - starts
    shares = {name: _sums(table[data], starts, ends) for name, table in _TABLES.items()}
    hashes, at = word_hashes(data, ends)
    count = np.diff(at)
    owner = np.repeat(np.arange(n), count)
    distinct, top = _distinct(hashes, owner, n)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    second = np.zeros(len(hashes), bool)
    second[2:] = (hashes[2:] == hashes[:-2]) & (owner[2:] == owner[:-2])
    follows = owner[1:] == owner[:-1]
    pairs, _ = _distinct((mix(hashes[:-1]) + hashes[1:])[follows], owner[1:][follows], n)
    # words from byte positions: first letters and lengths
    inside = ~(_TABLES["space"] | _TABLES["line"])[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[starts[size > 0]] = inside[starts[size > 0]]
    place = np.flatnonzero(begins)
    capitals = _sums(begins & _TABLES["upper"][data], starts, ends)
    gap = np.diff(np.concatenate([place, [len(data)]]))
    long_words = np.bincount(owner, weights=gap > 12, minlength=n) if len(gap) == len(owner) else np.zeros(n)
    # lines, as hashed runs of words
    breaks = np.concatenate([[0], np.cumsum(_TABLES["line"][data], dtype=np.int64)])
    line = breaks[place] if len(place) == len(owner) else np.zeros(len(owner), np.int64)
    if len(hashes):
        new = np.concatenate([[True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(new)
        inner = np.arange(len(hashes)) - np.repeat(first, np.diff(np.concatenate([first, [len(hashes)]])))
        value = np.add.reduceat(mix(hashes + inner.astype(np.uint64)), first)
        lines, (different, _) = np.bincount(owner[first], minlength=n), _distinct(value, owner[first], n)
    else:
        lines = different = np.zeros(n, np.int64)
    columns = [np.log1p(size), np.log1p(count), _share(size, count), *(_share(v, size) for v in shares.values()),
               _share(distinct, count), _share(np.bincount(owner, weights=same, minlength=n), count),
               _share(np.bincount(owner, weights=second, minlength=n), count), _share(top, count),
               _share(pairs, np.maximum(count - 1, 0)), _share(capitals, count), np.log1p(lines),
               _share(different, lines), _share(count, lines), _share(long_words, count)]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Trees as arrays: inner nodes of tree t are (t, 0 .. 2**DEPTH - 2), leaves apart."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Histogram gradient boosting of the logistic loss."""
    inner = 2 ** DEPTH - 1
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Trees(float(np.log(rate / (1 - rate))), np.zeros((0, inner), np.int64), np.zeros((0, inner)),
                  np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        model.base = float(np.log(rate / (1 - rate))) if not len(y) else (30.0 if y[0] else -30.0)
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], axis=1)
    n, width = x.shape
    offsets = np.arange(width) * BINS
    margin = np.full(n, model.base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        for depth in range(DEPTH):
            low, nodes = 2 ** depth - 1, 2 ** depth
            flat = ((node - low)[:, None] * (width * BINS) + offsets + binned).ravel()
            g, h, c = (np.bincount(flat, None if w is None else np.repeat(w, width), nodes * width * BINS)
                       .reshape(nodes, width, BINS) for w in (grad, hess, None))
            gl, hl, cl = (np.cumsum(v, axis=2) for v in (g, h, c))
            gr, hr, cr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl, cl[:, :, -1:] - cl
            gain = gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE) - (gl + gr) ** 2 / (hl + hr + RIDGE)
            gain = np.where((cl >= LEAF) & (cr >= LEAF), gain, 0.0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            for i in range(nodes):
                f, b = divmod(int(best[i]), BINS)
                if gain[i, best[i]] > 1e-9 and b < len(cuts[f]):
                    feature[low + i], threshold[low + i], cut[low + i] = f, cuts[f][b], b
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        place = node - inner
        leaf = RATE * np.bincount(place, grad, inner + 1) / (np.bincount(place, hess, inner + 1) + RIDGE)
        margin += leaf[place]
        trees.append((feature, threshold, leaf))
    return Trees(model.base, *(np.stack(v) for v in zip(*trees)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted to ``labels`` (doc_id, label) of ``docs``; learns from nothing else."""
    describe = F.arrow_udf(lambda texts: pa.array(list(statistics(texts)), pa.list_(pa.float32())), "array<float>")
    known = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    first = (docs.select("doc_id", describe("text").alias("x")).join(known, "doc_id")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    with small_batches(docs.sparkSession, TEXTS):
        rows = first.toArrow()
    if not rows.num_rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    x = np.asarray(rows["x"].combine_chunks().flatten()).reshape(rows.num_rows, -1)
    return fit(x, rows["label"].to_numpy().astype(float))


def score(model: Trees, text: Column) -> Column:
    """The chance that a text has label 1."""
    return F.arrow_udf(lambda texts: pa.array(model.score(statistics(texts))), "double")(text)


def held_out(doc_id: Column) -> Column:
    """One document in five, by a checksum of its id, from which nothing is learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted; learns from rows not held out."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return (docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", score(model, F.col("text")))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that score ``THRESHOLD`` or more, with their own columns, written."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return written(docs.filter(score(model, F.col("text")) >= THRESHOLD), "kept", TEXTS)
