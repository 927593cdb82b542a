"""Exact n-gram Jaccard join: block-skipping index lists and derived answers.

A document's set are the 64-bit hashes of its distinct shingles of ``WIDTH`` words.
Two documents link when NUM / DEN of the union is shared.

1. *Copies.*  Documents with equal sets are one node, its smallest doc_id.
2. *Set relations.*  Each node is compared with one leader, the smaller node with
   which it shares most of its three smallest hashes.  Verified pairs make a forest;
   a tree is a cluster of highly similar sets, and every member knows how far it is
   at most from the root (sizes of symmetric differences add up along the tree).
3. *Index lists.*  Sets that link share an element among their first
   n - ceil(n NUM / DEN) + 1, in any fixed order.  The order puts elements last that
   a small sketch of the corpus calls frequent (counts of elements that several
   documents near each other share), then goes by hash, so common passages rarely make
   long lists.  Only these elements are shuffled.  A list is
   sorted by set size and cut into blocks; a block pair is skipped when sizes are too
   far apart, or when the elements from the current position on are too few.  Before
   any pair is formed, each set counts, for bands of partner sizes, in how many of its
   lists it has a partner at all: where these are fewer than two sets that link must
   share, the whole band is skipped.  Pairs that meet in too few lists are dropped too.
4. *Answers by cluster.*  Lists yield pairs of clusters, not of their members, and
   only roots are compared.  Distances to the roots then bound what any two members
   can share: most cluster pairs are settled by that, the rest are compared member
   to root, and only pairs still open after that one by one.
5. Components of the links between roots give each document its component.

A cluster may hold a third of all rows: lists keep one entry for each cluster and
size, copies are folded by map-side aggregation, and no step gathers a group.  Sets
travel as texts of the documents that are still in question; a Bloom filter of fixed
size on their ids keeps the others out of the shuffle.

The driver gathers one row of levels and a few filters, packed.  Each stage and each scan
costs it a block of 4 MB for a moment, so tables that are made in rounds take few of them.

Texts without words (null too) have no set and link with nothing.  Rows without a
doc_id have no component and take no part.  Rows that repeat a doc_id with another
text are one document that links when any of its texts does.  Extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from annolake.llm.common import pieces, written
from annolake.llm.wordhash import arrow_bytes, mix, shingles, slices, word_hashes

WIDTH = 5
NUM, DEN = 75, 100
#: Counters of the frequency sketch; its size does not grow with the corpus.
SKETCH = 1 << 20
#: Elements among which repeated ones are counted.
NEAR = 3 << 19
#: An element is frequent if its counter is above this share of the mean; the order has
#: two levels for each doubling from there.
FREQUENT = 0.5
#: Members of a cluster with which an open pair is tried first.
PROBES = 6
#: Bands of partner sizes for which a set's lists are counted, and how often: what one
#: count drops, the next one misses.
BANDS, ROUNDS = 16, 2
#: Entries in a block of an index list.
BLOCK = 512
#: Bits of the id filter, of fixed size; a full one passes more rows and loses none.
FILTER_BITS = 1 << 23


def text_sets(batch: pa.RecordBatch, column: int, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """Row number in the batch and sorted set of each text."""
    row = 0
    for piece in slices(batch, column, 1 << 20):
        hashes, at = word_hashes(*arrow_bytes(piece.column(column)))
        for i in range(piece.num_rows):
            yield row, np.unique(shingles(hashes[at[i]:at[i + 1]], width))
            row += 1


def _fingerprint(values: np.ndarray) -> int:
    crossed = np.bitwise_xor.reduce(mix(values ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True)
    return int(mix(crossed + mix(np.add.reduce(values, keepdims=True))).view(np.int64)[0])


_SIGNATURE = "doc_id long, n long, print long, low array<long>, counts binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, fingerprint and three smallest elements of each set; last, one row with
    the sketch of this partition: how often elements occur again among ``NEAR`` others."""
    counts = np.zeros(SKETCH, np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.int64()),
                        ("low", pa.list_(pa.int64())), ("counts", pa.binary())])
    sets, held = {}, 0

    def count():
        elements, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        again = times > 1
        np.add.at(counts, (elements[again] & np.uint64(SKETCH - 1)).astype(np.int64), (times[again] - 1).astype(np.uint32))

    for batch in batches:
        sizes, prints, low = [], [], []
        for _, values in text_sets(batch, 1):
            sizes.append(len(values))
            prints.append(_fingerprint(values) if len(values) else 0)
            low.append(values[:3].view(np.int64).tolist())
            if prints[-1] not in sets:  # copies say nothing about frequency
                sets[prints[-1]] = values
                held += len(values)
            if held > NEAR:
                count()
                sets, held = {}, 0
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()),
                                          pa.array(low, pa.list_(pa.int64())), pa.nulls(len(sizes), pa.binary())],
                                         schema=schema)
    if sets:
        count()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([0], pa.int64()),
                                      pa.nulls(1, pa.list_(pa.int64())), pa.array([counts.tobytes()])], schema=schema)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SKETCH, np.uint32)
    for batch in batches:
        for counts in batch.column(0):
            part = np.frombuffer(counts.as_py(), np.uint32)
            total += np.minimum(part, np.uint32(0xFFFFFFFF) - total)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])


def _leveled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each counter of the summed sketches 0, or in steps how far its count is above
    the bound; packed."""
    total = np.zeros(SKETCH)
    for batch in batches:
        for counts in batch.column(0):
            total += np.frombuffer(counts.as_py(), np.uint32)
    above = total / (FREQUENT * (total.mean() + 0.25))
    levels = np.where(above > 1, 1 + 2 * np.log2(np.maximum(above, 1)), 0).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(levels.tobytes())])], ["levels"])


def _levels(signatures: DataFrame) -> bytes:
    """The levels of all sketch counters, packed; sketches are summed in tasks."""
    found = (signatures.filter("n < 0").select("counts").coalesce(4).mapInArrow(_added, "counts binary")
             .repartition(1).mapInArrow(_leveled, "levels binary").collect())
    return bytes(found[0].levels) if found else zlib.compress(bytes(SKETCH))


def _entries(packed: bytes):
    """Rows (element, doc_id, n, pos) of the elements a link has to share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(zlib.decompress(packed), np.uint8)
        seen: set[int] = set()
        for batch in batches:
            docs, parts, held = batch.column(0).to_pylist(), [], 0
            for row, values in text_sets(batch, 1):
                n = len(values)
                if not n or docs[row] is None:
                    continue
                label = _fingerprint(values)
                if label in seen:  # a copy met in this task adds nothing to the lists
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(label)
                level = levels[(values & np.uint64(SKETCH - 1)).astype(np.int64)]
                if level.any():
                    values = values[np.argsort(level, kind="stable")]
                first = _prefix(n)
                parts.append((values[:first], docs[row], n))
                held += first
                if held > 1 << 18:
                    yield _rows(parts)
                    parts, held = [], 0
            if parts:
                yield _rows(parts)
    return run


def _rows(parts: list) -> pa.RecordBatch:
    counts = [len(p[0]) for p in parts]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([p[0] for p in parts]).view(np.int64)), pa.array(np.repeat([p[1] for p in parts], counts)),
         pa.array(np.repeat([p[2] for p in parts], counts)), pa.array(np.concatenate([np.arange(c) for c in counts]))],
        ["element", "doc_id", "n", "pos"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows sorted by element, in tables of whole lists, with the lists' bounds."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        element = np.asarray(batch.column(0))
        change = np.flatnonzero(element[1:] != element[:-1]) + 1
        if rest and np.asarray(rest[-1].column(0))[-1] != element[0]:
            yield _bounded(rest)
            rest = []
        if len(change):
            yield _bounded([*rest, batch.slice(0, change[-1])])
            rest = [batch.slice(change[-1])]
        else:
            rest.append(batch)
    if rest:
        yield _bounded(rest)


def _bounded(batches: list[pa.RecordBatch]):
    table = pa.Table.from_batches(batches).combine_chunks()
    element = table.column(0).to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    return table, starts, np.concatenate([starts[1:], [len(element)]])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only lists with more than one row."""
    for table, starts, ends in _lists(batches):
        kept = table.filter(pa.array(np.repeat(ends - starts > 1, ends - starts)))
        yield from kept.to_batches()


def _prefix(n: np.ndarray) -> np.ndarray:
    """How many elements of a set of n go into the lists."""
    return n + (-n * NUM // DEN) + 1


def _need(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How many listed elements two sets that link share at least: those they share
    beyond the prefix that ends first are at most that set's remaining elements."""
    least = -(-NUM * (n + m) // (NUM + DEN))
    return np.maximum(1, least - np.maximum(n - _prefix(n), m - _prefix(m)))


def _fits(n, m, rest, left, late, behind) -> np.ndarray:
    """Sizes near enough, and enough elements before, at and after the positions."""
    return ((n * NUM <= m * DEN) & (m * NUM <= n * DEN)
            & ((np.minimum(late, behind) + np.minimum(rest, left)) * (NUM + DEN) >= NUM * (n + m)))


def _once(pairs: np.ndarray) -> np.ndarray:
    """Rows (list, a, b, need, first) with one row, that of least need, for each list and
    pair, and the greatest ``first``."""
    pairs = pairs[np.lexsort(pairs.T[::-1])]
    if len(pairs):
        begin = np.flatnonzero(np.concatenate([[True], (pairs[1:, :3] != pairs[:-1, :3]).any(axis=1)]))
        pairs[begin, 4] = np.maximum.reduceat(pairs[:, 4], begin)
    return pairs[np.concatenate([[True], (pairs[1:, :3] != pairs[:-1, :3]).any(axis=1)])] if len(pairs) else pairs


def _band(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which of ``BANDS`` bands a partner of size m is in, seen from a set of size n."""
    place = (np.log(m / n) / np.log(DEN / NUM) + 1) / 2 * BANDS
    return np.clip(place.astype(np.int64), 0, BANDS - 1)


def _meet(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(list, row, row) of two clusters that meet in a list and may link, as their sizes,
    positions and, where known, bands say.

    Lists are sorted by size.  Short ones are taken together, each row with the row d
    places on; long ones block by block."""
    n, rest, late, root = (table.column(c).to_numpy() for c in ("n", "rest", "late", "root"))
    bands = table.column("bands").to_numpy() if "bands" in table.column_names else None

    def may(x, y):
        fits = (root[x] != root[y]) & _fits(n[x], n[y], rest[x], rest[y], late[x], late[y])
        if bands is not None:
            fits &= (bands[x] >> _band(n[x], n[y]) & bands[y] >> _band(n[y], n[x]) & 1) > 0
        return fits

    lengths = ends - starts
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    short = np.repeat(mixed & (lengths <= 32), lengths)
    number = np.repeat(np.arange(len(starts)), lengths)
    rows = np.flatnonzero(short)
    for d in range(1, min(32, int(lengths[mixed].max(initial=0)))):
        rows = rows[rows + d < len(number)]
        rows = rows[number[rows] == number[rows + d]]
        x = rows[may(rows, rows + d)]
        if len(x):
            yield number[x], x, x + d
    for k in np.flatnonzero(mixed & (lengths > 32)):
        s, e = starts[k], ends[k]
        for i in range(s, e, BLOCK):
            a = np.arange(i, min(i + BLOCK, e))
            for j in range(i, e, BLOCK):
                b = np.arange(j, min(j + BLOCK, e))
                if n[j] * NUM > n[a[-1]] * DEN:
                    break  # sizes only grow from here
                if ((min(rest[a].max(), rest[b].max()) + min(late[a].max(), late[b].max())) * (NUM + DEN)
                        < NUM * (n[i] + n[j])):
                    continue  # too few elements, wherever in the blocks the positions are
                x, y = np.nonzero(may(a[:, None], b[None, :]))
                if len(x):
                    yield np.full(len(x), k), a[x], b[y]


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, n, band, lists, need): in how many lists the sets of n of a cluster meet any
    partner of a band, and the least that they would have to share with one of these."""
    keys, lists, needs, held = [], [], [], 0

    def folded():
        unique, place = np.unique(np.concatenate(keys), axis=0, return_inverse=True)
        need = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(need, place.ravel(), np.concatenate(needs))
        count = np.bincount(place.ravel(), np.concatenate(lists), len(unique)).astype(np.int64)
        return unique, count, need

    def rows(unique, count, need):
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in unique.T), pa.array(count), pa.array(need)], ["root", "n", "band", "lists", "need"])

    for table, starts, ends in _lists(batches):
        n, root = table.column("n").to_numpy(), table.column("root").to_numpy()
        least = np.full(len(n) * BANDS, np.iinfo(np.int64).max)
        for _, x, y in _meet(table, starts, ends):
            need = _need(n[x], n[y])
            np.minimum.at(least, x * BANDS + _band(n[x], n[y]), need)
            np.minimum.at(least, y * BANDS + _band(n[y], n[x]), need)
        met = np.flatnonzero(least < np.iinfo(np.int64).max)
        if len(met):
            row, band = np.divmod(met, BANDS)
            keys.append(np.stack([root[row], n[row], band], axis=1))
            lists.append(np.ones(len(met)))
            needs.append(least[met])
            held += len(met)
        if held > 1 << 18:  # one row a set and band, as long as they are few
            unique, count, need = folded()
            keys, lists, needs, held = [unique], [count], [need], len(unique)
            if held > 1 << 17:
                yield rows(unique, count, need)
                keys, lists, needs, held = [], [], [], 0
    if held:
        yield rows(*folded())


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, lists, need, first): pairs of clusters, in how many lists members of both
    meet, the least that any two of these would have to share, and whether some list
    may hold the first element that they share."""
    for table, starts, ends in _lists(batches):
        n, rest, root = (table.column(c).to_numpy() for c in ("n", "rest", "root"))
        found = []
        for number, x, y in _meet(table, starts, ends):
            a, b = root[x], root[y]
            first = np.minimum(rest[x], rest[y]) * (NUM + DEN) >= NUM * (n[x] + n[y])
            found.append(_once(np.stack([number, np.minimum(a, b), np.maximum(a, b), _need(n[x], n[y]), first], axis=1)))
        if found:
            pairs = _once(np.concatenate(found))[:, 1:]
            pairs = pairs[np.lexsort(pairs.T[::-1])]
            first = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)]))
            lists = np.diff(np.concatenate([first, [len(pairs)]]))
            most = np.maximum.reduceat(pairs[:, 3], first)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*pairs[first, :2].T, lists, pairs[first, 2], most)],
                                             ["a", "b", "lists", "need", "first"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and shared elements of pairs of texts; sorted input reuses the second."""
    last: tuple = (None, None)
    for batch in batches:
        rows = []
        for (_, x), at in zip(text_sets(batch, 2), range(batch.num_rows)):
            text = batch.column(3)[at].as_py()
            if last[0] != text:
                one = pa.record_batch([pa.array([text], batch.schema.field(3).type)], names=["text"])
                last = (text, next(text_sets(one, 0))[1])
            y = last[1]
            rows.append((len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
        n = np.array(rows, np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in n.T)],
                                         ["a", "b", "na", "nb", "shared"])


def _id_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter of all ids in any column, packed."""
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        for ids in batch.columns:
            bits[_places(np.asarray(ids))] = True
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)])], ["bits"])


def _places(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _in_filter(packed: bytes):
    """Whether ids may be in the filter; it is unpacked once a task."""
    unpacked: list[np.ndarray] = []

    def run(ids: pa.Array) -> pa.Array:
        if not unpacked:
            unpacked.append(np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)))
        return pa.array(unpacked[0][_places(np.asarray(ids.fill_null(0)))] > 0)
    return F.arrow_udf(run, "boolean")


def compare(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared) of document pairs (a, b), written."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for part in pairs.select("a", "b").coalesce(4).mapInArrow(_id_bits, "bits binary").collect():
        bits |= np.frombuffer(zlib.decompress(part.bits), np.uint8)
    in_filter = _in_filter(zlib.compress(bits.tobytes(), 1))
    texts = (docs.select(F.col("doc_id").alias("id"), "text").filter(F.col("id").isNotNull()).filter(in_filter("id")))
    one = pairs.join(texts, F.col("a") == F.col("id")).select("a", "b", F.col("text").alias("x"))
    two = one.join(texts, F.col("b") == F.col("id")).select("a", "b", "x", F.col("text").alias("y"))
    return written(two.mapInArrow(_compare, "a long, b long, na long, nb long, shared long")
                   .groupBy("a", "b").agg(F.max_by(F.struct("na", "nb", "shared"), F.col("shared") / (F.col("na") + F.col("nb"))).alias("r"))
                   .select("a", "b", "r.*"), "compared", 256)


def _linked():
    return F.col("shared") * DEN >= NUM * (F.col("na") + F.col("nb") - F.col("shared"))


def _apart():
    return F.col("na") + F.col("nb") - 2 * F.col("shared")


def _roots(links: DataFrame) -> DataFrame:
    """(node, root, far) of a forest given as (node, root = parent, far = distance)."""
    while True:
        up = links.select(F.col("node").alias("root"), F.col("root").alias("above"), F.col("far").alias("more"))
        jumped = written(links.join(up, "root", "left").select(
            "node", F.coalesce("above", "root").alias("root"),
            (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("above").isNotNull().alias("moved")), "forest")
        links = jumped.drop("moved")
        if not jumped.filter("moved").limit(1).count():
            return links


def _stars(edges: DataFrame) -> bool:
    """Whether edges (a, b) lead every a to one b from which no other leads on."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not (ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
                .filter("up > 1 or up = 1 and down = 1").limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of ``edges`` (a, b) with the smallest node it reaches.

    Every round links each node's neighbours and the node to the smallest of them
    (first for larger neighbours, then for smaller ones), until only stars are left:
    edges lead to smaller nodes, so a star's middle is its smallest node."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .filter("a <> b").distinct())
        large = written(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                             F.col("low").alias("b")).filter("a <> b").distinct())
        edges = written(small, "small-star")
        if _stars(edges):
            stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = pieces(docs.sparkSession)
    signatures = written(docs.mapInArrow(_signatures, _SIGNATURE), "signatures", 1024)
    rows = signatures.filter("n >= 0").select("doc_id", "n", "print", "low")
    nodes = written(rows.filter("n > 0 and doc_id is not null").groupBy("print", "n")
                    .agg(F.min("doc_id").alias("node"), F.first("low").alias("low")), "nodes")

    # one leader for each node, then clusters
    low = nodes.select("node", "n", F.explode("low").alias("element"))
    heads = low.groupBy("element").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    near = (low.join(heads, "element").filter("node > head.node")
            .filter((F.least("n", "head.n") * DEN >= F.greatest("n", "head.n") * NUM))
            .groupBy("node", F.col("head.node").alias("lead")).agg(F.count(F.lit(1)).alias("c"))
            .groupBy("node").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("lead")))
    first = compare(docs, written(near.select(F.col("node").alias("a"), F.col("lead").alias("b")), "leaders"))
    forest = _roots(first.filter(_linked()).select(F.col("a").alias("node"), F.col("b").alias("root"), _apart().alias("far")))
    members = written(nodes.groupBy("node").agg(F.max("n").alias("n"), F.min("n").alias("least")).join(forest, "node", "left").select(
        "node", "n", F.coalesce("root", "node").alias("root"), F.coalesce("far", F.lit(0)).alias("far")), "members")

    # index lists
    entries = docs.mapInArrow(_entries(_levels(signatures)), "element long, doc_id long, n long, pos long")
    shared = written(entries.repartition(n, "element").sortWithinPartitions("element")
                     .mapInArrow(_shared, "element long, doc_id long, n long, pos long"), "lists", 2048)
    of = (rows.filter("n > 0 and doc_id is not null").select("doc_id", "print", "n")
          .join(nodes.select("print", "n", "node"), ["print", "n"]).select("doc_id", "node", "n").distinct()
          .join(members.select("node", "root"), "node").select("doc_id", "n", "root"))
    lists = written(shared.join(of, ["doc_id", "n"]).groupBy("element", "root", "n")
                    .agg(F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("pos").alias("late")), "cluster-lists")
    sorted_ = lambda df, *more: (df.select("element", "n", "rest", "late", "root", *more)
                                 .repartition(n, "element").sortWithinPartitions("element", "n"))
    kept = sorted_(lists)
    for _ in range(ROUNDS):
        bands = (kept.mapInArrow(_partners, "root long, n long, band long, lists long, need long")
                 .groupBy("root", "n", "band").agg(F.sum("lists").alias("lists"), F.min("need").alias("need")).filter("lists >= need")
                 .groupBy("root", "n").agg(F.bit_or(F.expr("shiftleft(1L, cast(band as int))")).alias("bands")))
        lists = written(lists.drop("bands").join(written(bands, "bands"), ["root", "n"]), "cluster-lists")
        kept = sorted_(lists, "bands")
    pairs = written(kept.mapInArrow(_cross, "a long, b long, lists long, need long, first long")
                    .groupBy("a", "b").agg(F.sum("lists").alias("lists"), F.min("need").alias("need"), F.max("first").alias("first"))
                    .filter("lists >= need and first = 1").select("a", "b"), "cluster-pairs")

    # answers by cluster
    size = members.groupBy("root").agg(F.max("n").alias("most"), F.max("far").alias("far"), F.count(F.lit(1)).alias("members"))
    side = lambda k: size.select(F.col("root").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("most", "far", "members")))
    roots = compare(docs, pairs)
    linked = roots.filter(_linked()).select("a", "b")
    reach = lambda nx, ny: (nx + ny) * ((DEN - NUM) / (DEN + NUM)) + 1e-6
    open_ = written(roots.filter(~_linked()).select("a", "b", _apart().alias("apart")).join(side("a"), "a").join(side("b"), "b")
                    .filter((F.col("members_a") + F.col("members_b") > 2)
                            & (F.col("apart") - F.col("far_a") - F.col("far_b") <= reach(F.col("most_a"), F.col("most_b")))),
                    "open-clusters")
    labels = _members_answers(docs, members, open_, linked, reach) if open_.limit(1).count() else components(linked)
    labelled = written(members.join(labels.withColumnRenamed("node", "root"), "root", "left").select(
        "node", F.coalesce("label", "root").alias("component_id")), "labels")
    final = written(nodes.select("print", "n", "node").join(labelled, "node").select("print", "n", "component_id"), "classes")
    return rows.join(final, ["print", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _members_answers(docs: DataFrame, members: DataFrame, open_: DataFrame, known: DataFrame, reach) -> DataFrame:
    """Components of the roots by the links so far (``known``) and those between clusters
    whose roots leave the matter open."""
    some = members.filter("node <> root").withColumn(
        "k", F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("node"), "node"))).filter(F.col("k") <= PROBES)
    probes = written(_asked(open_, some, reach), "probes")
    linked = compare(docs, probes.select(F.col("node").alias("a"), F.col("to").alias("b")).distinct()).filter(_linked())
    found = written(probes.join(linked.select(F.col("a").alias("node"), F.col("b").alias("to")), ["node", "to"])
                    .select(F.col("own").alias("a"), F.col("to").alias("b")), "probe-links")
    label = components(known.unionByName(found))
    joined = open_.join(label.select(F.col("node").alias("a"), F.col("label").alias("at_a")), "a", "left").join(
        label.select(F.col("node").alias("b"), F.col("label").alias("at_b")), "b", "left")
    left = written(joined.filter("at_a is null or at_b is null or at_a <> at_b").drop("at_a", "at_b"), "still-open")
    if not left.limit(1).count():
        return label
    edges = label.select(F.col("node").alias("a"), F.col("label").alias("b"))
    for more in _all_answers(docs, members, left, reach):
        edges = edges.unionByName(more)
    return components(edges)


def _asked(open_: DataFrame, members: DataFrame, reach) -> DataFrame:
    """(node, node_n, node_far, to, own): members and the other cluster's root, where
    distances allow a link of the member with that cluster."""
    def side(own: str, other: str) -> DataFrame:
        return (open_.join(members, F.col(own) == F.col("root"))
                .filter(F.col("apart") - F.col("far") - F.col(f"far_{other}") <= reach(F.col("n"), F.col(f"most_{other}")))
                .select("node", F.col("n").alias("node_n"), F.col("far").alias("node_far"), F.col(other).alias("to"),
                        F.col(own).alias("own"), "apart"))
    return side("a", "b").unionByName(side("b", "a")).drop("apart")


def _all_answers(docs: DataFrame, members: DataFrame, open_: DataFrame, reach) -> list[DataFrame]:
    """The same for all members of the clusters that are open still."""
    asked = written(_asked(open_, members.filter("node <> root"), reach), "member-pairs")
    answers = written(asked.join(compare(docs, asked.select(F.col("node").alias("a"), F.col("to").alias("b")).distinct())
                                 .withColumnRenamed("a", "node").withColumnRenamed("b", "to"), ["node", "to"]), "member-answers")
    links = answers.filter(_linked()).select(F.col("own").alias("a"), F.col("to").alias("b"))
    settled = links.select(F.least("a", "b").alias("own"), F.greatest("a", "b").alias("to")).distinct()
    still = answers.filter(~_linked()).withColumn("apart", _apart())
    left = still.filter("own < to").join(settled, ["own", "to"], "left_anti").select(
        F.col("own").alias("ra"), F.col("to").alias("rb"), F.col("node").alias("a"), F.col("node_n").alias("n_a"),
        F.col("node_far").alias("far_a"), F.col("apart").alias("apart_a"))
    right = still.filter("own > to").select(
        F.col("to").alias("ra"), F.col("own").alias("rb"), F.col("node").alias("b"), F.col("node_n").alias("n_b"),
        F.col("node_far").alias("far_b"), F.col("apart").alias("apart_b"))
    within = reach(F.col("n_a"), F.col("n_b"))
    last = written(left.join(right, ["ra", "rb"]).filter(
        (F.col("apart_a") - F.col("far_b") <= within) & (F.col("apart_b") - F.col("far_a") <= within)
        & (F.least("n_a", "n_b") * DEN >= F.greatest("n_a", "n_b") * NUM)).select("ra", "rb", "a", "b"), "last-pairs")
    if not last.limit(1).count():
        return [links]
    done = compare(docs, last.select("a", "b").distinct()).filter(_linked())
    return [links, last.join(done.select("a", "b"), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))]


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the smallest doc_id of each component only; rows without a doc_id stay."""
    found = join(docs)
    dropped = written(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__doc")).distinct(), "copies")
    return docs.join(dropped, docs["doc_id"] == dropped["__doc"], "left_anti")
