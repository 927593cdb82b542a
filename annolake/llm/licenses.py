"""License scans by a positional index of rare words.

Known notices are templates: a label, words in order, and key phrases in it that must be
there.  A document holds a notice at an offset if at least ``SHARE`` of the template's
words stand in it at their places counted from there, and all key phrases do.

1. *Rarity*: one pass counts, over all documents, in how many each template word occurs.
2. *Index*: a template that needs k of its m words is indexed under its m - k + c rarest
   (highest IDF) words, c = half of k.  A match misses at most m - k words, so at least c of
   those are there: nothing that matches is left out.
3. *Look-up*: a second pass over the texts finds where indexed words stand near each
   other, and the template words around those places.
4. *Intersection*: these hits join the index; template and relative position (offset)
   group them, and offsets with fewer than c postings fall away.
5. *Verification*: the template's words at the offset join the hits; the share and the key
   phrases decide.  Joins and groups are Spark's; index and templates are as small as the
   notices the caller lists, whatever the corpus.

Base phrases (``PHRASES``) are counted wherever their words follow each other; their
labels always stay.  Words are told by 64-bit hashes.  Hits of one document are bounded
by its text; a notice that a third of all documents hold is as many small rows in all
tasks, keyed by document.

Null texts are empty: no words, no labels, score 0.  Rows that repeat a doc_id, or have
none, are rows of their own.  Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annolake.llm.common import written
from annolake.llm.wordhash import arrow_bytes, slices, word_hashes
from annolake.session import small_table

# Phrases and labels of the base.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Notices as their licenses publish them, with the phrases that must be there.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction",
     ("permission is hereby granted", "without restriction")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ("for any purpose with or without fee",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation", ("gnu general public license",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
     ("gnu lesser general public license",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
     ("gnu affero general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
)
SHARE = 0.7
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of words as they are, all others as blanks.
_BYTES = np.arange(256, dtype=np.uint8)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _BYTES[_low:_high + 1] = 0x20


def split(text: str) -> list[str]:
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: Places of the words of key phrases.
    keys: frozenset[int]

    @property
    def need(self) -> int:
        """Words that a match has at their places."""
        return math.ceil(SHARE * len(self.words))

    @property
    def agree(self) -> int:
        """Indexed words that a match has at least."""
        return max(1, self.need // 2)


def template(label: str, text: str, phrases: tuple[str, ...] = ()) -> Template:
    words, keys = tuple(split(text)), set()
    for phrase in phrases:
        part = tuple(split(phrase))
        at = next((i for i in range(len(words)) if words[i:i + len(part)] == part), None)
        if at is None or not part:
            raise ValueError(f"{phrase!r} is not in the notice of {label}")
        keys.update(range(at, at + len(part)))
    if not words:
        raise ValueError(f"the notice of {label} has no words")
    return Template(label, words, frozenset(keys))


def _hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return word_hashes(np.frombuffer(data, np.uint8), np.array([len(data)]))[0]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words' hashes, where each text's words begin) of pieces of a batch."""
    row = 0
    for piece in slices(batch, column):
        data, ends = arrow_bytes(piece.column(column))
        yield row, *word_hashes(_BYTES[data], ends)
        row += piece.num_rows


def _known(hashes: np.ndarray, known: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where known words stand, and which they are."""
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    spots = np.flatnonzero(known[at] == hashes)
    return spots, number[at[spots]]


def frequencies(docs: DataFrame, words: list[str]) -> list[int]:
    """In how many rows each word occurs; as many numbers as there are words."""
    hashes = _hashes(words)
    order = np.argsort(hashes)
    known = hashes[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for _, found, at in _texts(batch, 0):
                spots, number = _known(found, known, order)
                owner = np.searchsorted(at, spots, "right")
                total += np.bincount(np.unique(owner * len(words) + number) % len(words), minlength=len(words))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["word", "n"])

    counted = written(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-rows", 1024)
    out = [0] * len(words)
    for r in counted.collect():
        out[r.word] = r.n
    return out


@dataclass(frozen=True)
class Index:
    """Places of all template words, and which of them are indexed."""

    templates: tuple[Template, ...]
    words: tuple[str, ...]
    indexed: frozenset[tuple[int, int]]

    def postings(self) -> list[tuple]:
        number = {w: i for i, w in enumerate(self.words)}
        return [(t, place, number[w], (t, place) in self.indexed, place in self.templates[t].keys)
                for t, one in enumerate(self.templates) for place, w in enumerate(one.words)]

    def reach(self) -> list[int]:
        """How near another indexed word must stand for each word: 0 where it is not
        indexed, -1 where it is enough alone."""
        out = [0] * len(self.words)
        for t, _, word, indexed, _ in self.postings():
            if indexed and out[word] >= 0:
                one = self.templates[t]
                out[word] = -1 if one.agree == 1 else max(out[word], len(one.words))
        return out


def build(docs: DataFrame, templates: tuple[Template, ...]) -> Index:
    words = tuple(sorted({w for t in templates for w in t.words}))
    rows = dict(zip(words, frequencies(docs, list(words))))
    indexed = set()
    for t, one in enumerate(templates):
        rarest = sorted(range(len(one.words)), key=lambda place: (rows[one.words[place]], place))
        indexed.update((t, place) for place in rarest[:len(one.words) - one.need + one.agree])
    return Index(templates, words, frozenset(indexed))


_LOOKED = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base array<int>, "
           "hits array<struct<spot: long, word: int, rare: boolean>>")


def _look_up(index: Index, phrases: list[list[str]]):
    """Each document's base places, and the template words around indexed ones."""
    hashes = _hashes(list(index.words))
    order = np.argsort(hashes)
    known, reach = hashes[order], np.array(index.reach(), np.int64)
    longest = max((len(t.words) for t in index.templates), default=0)
    parts = [_hashes(p) for p in phrases]
    hit = pa.struct([("spot", pa.int64()), ("word", pa.int32()), ("rare", pa.bool_())])

    def near(spots: np.ndarray, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of sorted hits those within reach of indexed words that stand near another one."""
        owner = np.searchsorted(at, spots, "right")
        rare = np.flatnonzero(reach[number] != 0)
        if not len(rare):
            return rare
        s, o, r = spots[rare], owner[rare], reach[number[rare]]
        gap = np.where(o[1:] == o[:-1], s[1:] - s[:-1], np.iinfo(np.int64).max)
        left, right = np.append(np.iinfo(np.int64).max, gap), np.append(gap, np.iinfo(np.int64).max)
        s = s[(r < 0) | (np.minimum(left, right) <= r)]
        if not len(s):
            return s
        place = np.searchsorted(s, spots)
        before, after = s[np.maximum(place - 1, 0)], s[np.minimum(place, len(s) - 1)]
        return np.flatnonzero(np.minimum(np.abs(spots - before), np.abs(after - spots)) <= longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found, at in _texts(batch, 1):
                n = len(at) - 1
                base = [[] for _ in range(n)]
                count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                for k, part in enumerate(parts):
                    spots = np.flatnonzero(found[:len(found) - len(part) + 1] == part[0]) if len(found) >= len(part) else np.zeros(0, np.int64)
                    for i in range(1, len(part)):
                        spots = spots[found[spots + i] == part[i]]
                    owner = np.searchsorted(at, spots, "right") - 1
                    inside = spots + len(part) <= at[owner + 1]
                    spots, owner = spots[inside], owner[inside]
                    np.add.at(count, owner, 1)
                    np.minimum.at(first, owner, spots - at[owner])
                    np.maximum.at(last, owner, spots - at[owner])
                    for doc in np.unique(owner):
                        base[doc].append(k)
                spots, number = _known(found, known, order)
                kept = near(spots, number, at)
                spots, number = spots[kept], number[kept]
                ends = np.searchsorted(spots, at)
                owner = np.searchsorted(at, spots, "right") - 1
                hits = pa.StructArray.from_arrays(
                    [pa.array(spots - at[owner]), pa.array(number.astype(np.int32)), pa.array(reach[number] != 0)], fields=list(hit))
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(np.diff(at)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
                     pa.array(base, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "hits"])
    return run


def matches(rows: DataFrame, index: Index) -> DataFrame:
    """(row, template, offset, share) of the notices, from rows (row, hits)."""
    spark = rows.sparkSession
    postings = small_table(spark, index.postings(), "template int, place long, word int, indexed boolean, key boolean")
    rules = small_table(spark, [(t, one.label, len(one.words), one.need, one.agree, len(one.keys)) for t, one in enumerate(index.templates)],
                        "template int, label string, words int, need int, agree int, keys int")
    hits = rows.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    offsets = (hits.filter("rare").join(postings.filter("indexed"), "word")
               .groupBy("row", "template", (F.col("spot") - F.col("place")).alias("offset")).agg(F.count(F.lit(1)).alias("met"))
               .join(rules, "template").filter("met >= agree").select("row", "template", "offset"))
    words = (offsets.join(postings.drop("indexed"), "template")
             .select("row", "template", "offset", (F.col("offset") + F.col("place")).alias("spot"), "word", "key"))
    return (words.join(hits.drop("rare"), ["row", "spot", "word"]).groupBy("row", "template", "offset")
            .agg(F.count(F.lit(1)).alias("aligned"), F.count_if("key").alias("held"))
            .join(rules, "template").filter("aligned >= need and held = keys")
            .select("row", "template", "label", "offset", (F.col("aligned") / F.col("words")).alias("share")))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every
    row; labels are sorted arrays, score the greatest share of a notice (1 for a base place)."""
    made = tuple(template(*t) for t in templates)
    index = build(docs, made)
    looked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _look_up(index, [split(p) for p, _ in phrases]), _LOOKED)
    rows = written(looked.withColumn("row", F.monotonically_increasing_id()), "looked-up", 1024)
    notices = (matches(rows.select("row", "hits"), index).groupBy(F.col("row").alias("__row"))
               .agg(F.collect_set("label").alias("found"), F.max("share").alias("share")))
    names = F.array(*(F.lit(label) for _, label in phrases)).cast("array<string>")
    base = F.transform("base", lambda k: F.element_at(names, k + 1))
    none = F.array().cast("array<string>")
    return (rows.join(notices, F.col("row") == F.col("__row"), "left")
            .select("doc_id", "n_words", "n_base", "first_word", "last_word",
                    F.array_sort(F.array_distinct(base)).alias("base_labels"),
                    F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", none)))).alias("labels"),
                    F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score")))
