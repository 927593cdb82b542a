import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from annolake.llm import tokens as T

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Plain words, here. it's", None, "", "  \n", "á ́b \x1c x\x85y <|endoftext|>z 'S don't\x0bΣΑΣ İ 123 4٣ \x00 e\u0301.",
         "A.́ K,̈ x!, <|ENDOFTEXT|> 3.5", "word " * 80000, "가 ᆨ", "a.b,c", "Plain words, here. it's"]


OTHER = public_tokenizers.path("byte_bpe_50k.json")


def want(rows, path=PATH):
    t, start, out = Tokenizer.from_file(path), 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark):
    rows = list(enumerate(TEXTS)) + [(3, "again 3"), (None, "no id"), (7, "가 ᆨ")]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "doc_id long, text string, start int").repartition(3)
    got = T.encode_corpus(df, PATH).orderBy("start").collect()
    assert [tuple(r) for r in got] == want(rows)


def test_another_vocabulary(spark):
    """Its rules let no text be cut, so texts go to the library whole."""
    with open(PATH) as one, open(OTHER) as two:
        assert [T.cuts(json.load(f)) for f in (one, two)] == [True, False]
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [tuple(r) for r in T.encode_corpus(df, OTHER).orderBy("start").collect()] == want(rows, OTHER)


def test_cut_places():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b9", ".", ",", " ", "\n", "é", "-", "\x1f", "..", ""]) for _ in range(rng.randrange(30))).encode()
        assert T.pieces_of(text) == T._APART(b" ", text).split()


def test_plain_pieces_by_model(monkeypatch):
    """Plain pieces get the library's ids from its model alone; only others go through all of its steps."""
    rng, whole, sent = random.Random(4), Tokenizer.from_file(PATH), []
    signs = [chr(i) for i in range(33, 256)] + ["'s", "'ll", "'", "the", "e\u0301", "<", "\u0338", "a" * 60, "ſ", "K", "Σ"]
    words = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(20000)]
    words = [w for w in words if "<|" not in w] + ["ÀÉÎÕÜß'S", "naïve***", "x'd9½", "ÿ÷×", "o" * 300]
    T._PIECES.clear()
    T.encoder(PATH)
    parts = T._TOKENIZERS[PATH]

    class Seen:
        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return parts[0].encode_batch_fast(texts, **options)

    monkeypatch.setitem(T._TOKENIZERS, PATH, (Seen(), *parts[1:]))
    got = T.encoder(PATH)(words)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(words, add_special_tokens=False)]
    assert sent and not any(w.isalpha() and w.isascii() and len(w) < 100 for w in sent)
    sent.clear()
    T.encoder(PATH)(["Straße, naïve*** c'était 3.14 (plain) words 가 o\u0301"])
    assert sorted(sent) == ["o\u0301", "가"]
    T._PIECES.clear()


def test_rules_beyond_the_model():
    """Rules that do more to a plain piece than lower-case, match and spell it leave it to the library."""
    with open(PATH) as f:
        rules = json.load(f)
    assert T.by_model(Tokenizer.from_file(PATH), rules)
    steps = rules["pre_tokenizer"]["pretokenizers"]
    for more in (steps[:1], steps + steps[1:], [steps[0], {**steps[1], "use_regex": True}], [steps[0], {**steps[1], "add_prefix_space": True}]):
        assert T.by_model(Tokenizer.from_file(PATH), {**rules, "pre_tokenizer": {"type": "Sequence", "pretokenizers": more}}) is None
    assert [bool(T._RUNS(p)) for p in (r"'s|'t|[\p{L}]+|x", r"[\p{L}]+", r"\p{L}{2}|[\p{L}]+", r"[\p{L}]+?", r"'(s|[\p{L}]+)")] == [
        True, True, False, False, False]


def test_empty(spark):
    assert T.encode_corpus(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2 ** 32 - 1] * 700, list(range(49408))])
def test_random_access(ids):
    levels, bitmaps, ranks = T.pack(np.array(ids, np.uint32))
    assert T.unpack(levels, bitmaps).tolist() == ids
    for i in range(0, len(ids), 37):
        assert T.token_at(levels, bitmaps, ranks, i) == ids[i]


def test_worker_remembers_few_pieces():
    """What a worker keeps between tasks is small, and pieces in use are not encoded again."""
    T._PIECES.clear()
    encode = T.encoder(PATH)
    whole = Tokenizer.from_file(PATH)
    for k in range(0, 300_000, 30_000):
        texts = ["often used words " + " ".join(f"w{i}" for i in range(k, k + 30_000))]
        got = encode(texts)
        assert {b"often", b"used", b"words"} <= set(T._PIECES[PATH]) and len(T._PIECES[PATH]) <= 1 << 17
    assert got == [np.array(whole.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()]
    T._PIECES.clear()
