"""Token ids in files of directly addressable codes.

Documents are range-partitioned by doc_id; each partition encodes its texts with
the ``tokenizers`` library, appends the end id and cuts the id stream into blocks
of whole documents (``BLOCK`` ids, more where one document has more).  A block is
one row of the written table:

    part, block     the range partition and the block within it
    before          ids of the partition's earlier blocks
    doc_ids         its documents, little-endian int64
    ends            for each, where its ids end within the block, little-endian uint32
    levels          one binary for each chunk level: the chunks, one byte each
    bitmaps         for each level: bit i is set where chunk i goes on at the next level
    ranks           for each level: set bits before every ``RANK`` chunks, little-endian uint32

An id is split into 8-bit chunks, the lowest first.  Chunk i of level l goes on at
index rank(bitmap l, i) of level l + 1, so any id of a block is found by a walk
over at most four bytes: ``token_at`` reads it without decoding its neighbours.

Null texts are empty and give the end id alone; null doc_ids come first; equal
doc_ids are ordered by text; extra columns are dropped; an empty table gives no
rows.  The corpus-wide start of a document comes from one count for each
partition, the only thing the driver gathers.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from annolake.llm.common import pieces, written
from annolake.session import small_table

BLOCK = 1 << 16
RANK = 512
END = 2
#: A worker's memory of encoded pieces is cut down to those in use at this size (some 25 MB); it
#: stays with the worker, whatever stage that serves next.
KNOWN = 1 << 17
#: Documents encoded at a time.
DOCS = 256
ROW = ("part int, block int, before long, n_ids long, doc_ids binary, ends binary, levels array<binary>, "
       "bitmaps array<binary>, ranks array<binary>")


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunk levels, continuation bitmaps and rank directories of some ids."""
    levels, bitmaps, ranks = [], [], []
    rest = np.asarray(ids, np.uint32)
    while len(rest):
        more = rest > 255
        levels.append(rest.astype(np.uint8).tobytes())
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        starts = np.arange(0, len(rest), RANK)
        counts = np.add.reduceat(more.astype(np.uint32), starts)
        ranks.append((np.cumsum(counts) - counts).astype("<u4").tobytes())
        rest = rest[more] >> np.uint32(8)
    return levels, bitmaps, ranks


def unpack(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a block."""
    ids = np.zeros(0, np.uint32)
    for level, bitmap in zip(reversed(levels), reversed(bitmaps)):
        chunks = np.frombuffer(level, np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(chunks), bitorder="little").view(bool)
        chunks[more] |= ids << np.uint32(8)
        ids = chunks
    return ids


def token_at(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], i: int) -> int:
    """One id of a block, by rank look-ups alone."""
    value = 0
    for depth, (level, bitmap, rank) in enumerate(zip(levels, bitmaps, ranks)):
        value |= level[i] << 8 * depth
        if not bitmap[i >> 3] >> (i & 7) & 1:
            break
        piece = i // RANK
        before = int.from_bytes(bitmap[piece * RANK >> 3:i + 8 >> 3], "little") & ((1 << i - piece * RANK) - 1)
        i = int.from_bytes(rank[4 * piece:4 * piece + 4], "little") + before.bit_count()
    return value


def cuts(rules: dict) -> bool:
    """Whether a vocabulary file's rules let a text be cut at ASCII white space, and between
    an ASCII letter or digit and a full stop or comma, without changing its ids: they
    fold white space, lower-case, and then take only what a pattern matches, which
    matches neither of these places."""
    steps = rules.get("normalizer") or {}
    steps = steps.get("normalizers", [steps])
    kinds = [step.get("type") for step in steps]
    folds = any(step.get("type") == "Replace" and step.get("pattern") == {"Regex": r"\s+"} and step.get("content") == " " for step in steps)
    if not (folds and "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"} and kinds.count("Replace") == 1):
        return False
    split = rules.get("pre_tokenizer") or {}
    split = split.get("pretokenizers", [split])[0]
    if split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert"):
        return False
    matches = regex.compile(split["pattern"].get("Regex", r"\s")).findall
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    apart = all(matches(c + mark) == [c, mark] for c in letters for mark in ".,")
    return apart and not any(" " in m for c in letters + ".,'-é" for m in matches(f"{c} {c}"))


def by_model(tokenizer, rules: dict) -> Callable[[str], bytes] | None:
    """Ids of one piece that ``_PLAIN`` matches, for a vocabulary file whose texts may be cut.

    All that its rules do to such a piece is to lower-case it, take what their pattern matches
    and spell that in byte letters; the library's model encodes each match, without the
    library's steps for any other text.  None where the rules do more than that."""
    from tokenizers.pre_tokenizers import ByteLevel

    split, *rest = rules["pre_tokenizer"].get("pretokenizers", [rules["pre_tokenizer"]])
    if [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] != [("ByteLevel", False, False)]:
        return None
    signs = "".join(c for c in map(chr, range(256)) if _PLAIN(c))
    if tokenizer.normalizer.normalize_str(signs) != signs.lower():
        return None
    level, spelled = ByteLevel(add_prefix_space=False, use_regex=False), [chr(b) if b < 128 else "\ufffe" for b in range(256)]
    for c in signs:
        for byte, letter in zip(c.encode(), level.pre_tokenize_str(c)[0][0]):
            spelled[byte] = letter
    spelled = "".join(spelled)
    pattern, tokenize = split["pattern"]["Regex"], tokenizer.model.tokenize
    matches, one = regex.compile(pattern).findall, _RUNS(pattern) is not None

    def ids(piece: str) -> bytes:
        piece = piece.lower()
        parts = (piece,) if one and piece.isalpha() else matches(piece)
        if not piece.isascii():
            parts = [charmap_decode(part.encode(), "strict", spelled)[0] for part in parts]
        return array("I", [token.id for part in parts for token in tokenize(part)]).tobytes()
    return ids


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian uint32 ids.

    Where the vocabulary's rules allow it (``cuts``), each distinct piece between the
    places where texts may be cut is encoded once and remembered, by the worker too, up
    to ``KNOWN`` pieces or those of the texts at hand; plain ones by the library's model
    alone, where that is the same (``by_model``).  Texts that may hold special tokens, which are found before any
    rule is applied, and all texts of other vocabularies go to the library whole.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        marks = {token["content"][:2] for token in rules.get("added_tokens", [])}
        whole, may_cut = Tokenizer.from_file(path), cuts(rules)
        _TOKENIZERS[path] = (whole, may_cut, by_model(whole, rules) if may_cut else None, sorted(marks))
    tokenizer, may_cut, plain, marks = _TOKENIZERS[path]
    known = _PIECES.setdefault(path, {})

    def ids(texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_pieces(new: list[str]) -> list[bytes]:
        done = [plain(w) if plain and _PLAIN(w) else None for w in new]
        others = iter(ids([w for w, i in zip(new, done) if i is None]))
        return [next(others) if i is None else i for i in done]

    def encode(texts: list[str]) -> list[bytes]:
        split = [None if any(mark in t for mark in marks) else pieces_of(t.encode("utf-8", "replace").lower()) for t in texts]
        used = set().union(*(s for s in split if s))
        new = list(used.difference(known))
        if len(known) + len(new) > KNOWN:
            still = {w: known[w] for w in used.intersection(known)}
            known.clear()
            known.update(still)
        known.update(zip(new, of_pieces([w.decode() for w in new])))
        return [ids([t])[0] if s is None else b"".join(map(known.__getitem__, s)) for t, s in zip(texts, split)]
    return encode if may_cut else ids


def pieces_of(text: bytes) -> list[bytes]:
    """Lower-case text cut at white space and between a letter or digit and a mark.

    Every mark gets a sign before it, which goes again where no letter or digit stands
    before: far fewer places than a pattern would have to look at."""
    if b"\x1f" in text:
        return _APART(b" ", text).split()
    signed = text.replace(b".", b"\x1f.").replace(b",", b"\x1f,")
    return _NOT_APART(b"", signed).replace(b"\x1f", b" ").split()


_TOKENIZERS: dict = {}
_PIECES: dict[str, dict[bytes, bytes]] = {}
#: A short piece of ASCII signs and Latin-1 letters: no combining mark, so its normal form is itself.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]{1,99}").fullmatch
#: Patterns that take a run of letters whole: what they try before needs an apostrophe.
_RUNS = re.compile(r"('\w+\|)*\[\\p\{L\}\]\+(\||$)").match
_APART = re.compile(rb"(?<=[a-z0-9])(?=[.,])").sub
_NOT_APART = re.compile(rb"\x1f(?<![a-z0-9]\x1f)").sub


def _blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(path), None, 0
        before = 0
        end = np.array([END], "<u4").tobytes()
        ids, docs, ends = bytearray(), [], []

        def flush():
            levels, bitmaps, ranks = pack(np.frombuffer(bytes(ids), "<u4"))
            row = {"part": part, "block": number, "before": before, "n_ids": len(ids) // 4, "doc_ids": np.array(docs, "<i8").tobytes(),
                   "ends": np.array(ends, "<u4").tobytes(), "levels": levels, "bitmaps": bitmaps, "ranks": ranks}
            return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)

        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                rows = batch.slice(at, DOCS).to_pydict()
                for part, doc, encoded in zip(rows["part"], rows["doc_id"], encode([t or "" for t in rows["text"]])):
                    ids += encoded
                    ids += end
                    docs.append(NULL if doc is None else doc)
                    ends.append(len(ids) // 4)
                    if len(ids) >= 4 * BLOCK:
                        yield flush()
                        number += 1
                        before += len(ids) // 4
                        ids, docs, ends = bytearray(), [], []
        if docs:
            yield flush()
    return run


#: Stands for a null doc_id in the files.
NULL = -(1 << 63)
_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()),
                     ("ends", pa.binary()), ("levels", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())),
                     ("ranks", pa.list_(pa.binary()))])


def write(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The files' blocks, written to the shared folder and opened again."""
    ranged = (docs.select("doc_id", "text").repartitionByRange(pieces(docs.sparkSession), "doc_id", F.substring("text", 1, 64))
              .sortWithinPartitions("doc_id", "text")
              .select(F.spark_partition_id().alias("part"), "doc_id", "text"))
    return written(ranged.mapInArrow(_blocks(tokenizer), ROW), "tokens", 4 * DOCS)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["levels"], row["bitmaps"]).astype("<u4")
            docs = np.frombuffer(row["doc_ids"], "<i8")
            ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, mask=docs == NULL), pa.array(starts + row["first"]), pa.array(ends - starts),
                 pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    spark = blocks.sparkSession
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row.part, total))
        total += row.n
    first = (F.col("start") + F.col("before")).alias("first")
    placed = blocks.join(small_table(spark, starts, "part int, start long"), "part")
    return (placed.select(first, "doc_ids", "ends", "levels", "bitmaps")
            .mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def encode_corpus(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files and read them back."""
    return read(write(docs, tokenizer))
