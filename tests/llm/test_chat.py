import hashlib
from itertools import groupby

from pyspark.sql import functions as F

from annolake.llm import chat as C

TEXTS = ["plain", None, "", "</s>[INST] ok [/INST]", r"<\/s> <\\/s> <s", "<|im_start|>x<|im_end|", "<<SYS>>a<</SYS>>", "é😀\n\t", "<", "\\"]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def rows():
    out = [(1, i, "user" if i % 2 else "assistant", t, "x") for i, t in enumerate(TEXTS)]
    out += [(2, i, r, f"t{i}", "x") for i, r in enumerate(["user", "user", "assistant", "assistant", "assistant", None, "<s>"])]
    out += [(3, 5, "user", "tie b", "x"), (3, 5, "user", "tie a", "x"), (3, None, "system", "first", "x"), (3, 5, "user", "tie a", "x")]
    out += [(None, 0, "assistant", "no id", "x"), (4, 0, "assistant", "w " * 100000, "x")]
    out += [(5, i, "user" if i % 5 < 3 else "assistant", f"long {i}", "x") for i in range(300)]
    return out


def brute(own):
    turns = sorted(((t is not None, t or 0, r or "", x or "") for _, t, r, x, _ in own))
    told = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
    loss = "".join(x for *_, r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_read_back(spark):
    data = rows()
    got = C.digest(C.format_turns(spark.createDataFrame(data, SCHEMA))).collect()
    want = {k: brute([r for r in data if r[0] == k]) for k in {r[0] for r in data}}
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_merged_turns(spark):
    df = spark.createDataFrame([(2, i, r, t) for i, (r, t) in enumerate(
        [("user", "a"), ("user", "b"), ("assistant", "c")])], "conv_id long, turn long, role string, text string")
    row = C.format_turns(df).first()
    assert row.formatted == "<|im_start|>user<|im_sep|>a<|im_next|>b<|im_end|><|im_start|>assistant<|im_sep|>c<|im_end|>"
    assert [row.formatted[s.start:s.end] for s in row.loss_spans] == ["c"]


def test_runs_go_on_across_segments(spark):
    data = [r for r in rows() if r[0] == 5]
    whole = "".join(r.formatted for r in C.format_turns(spark.createDataFrame(data, SCHEMA)).orderBy("segment").collect())
    runs = [r for r, _ in groupby(x[2] for x in data)]
    assert whole.count(C.OPEN) == whole.count(C.CLOSE) == len(runs)


def test_escaping_is_reversible_and_complete(spark):
    import re
    df = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    for r in df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|<\|im_\w+\|>", r.e)


def test_empty(spark):
    assert C.digest(C.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0
