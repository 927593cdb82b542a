import hashlib
import itertools
import random

from annolake.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
SHOWN = " \t\n\x0b\x0c\r"


def brute(rows):
    """All edit sequences of least cost, by a search over (row, roles so far as a state)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        if not text.strip(SHOWN):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("truncated" if text.strip(SHOWN)[-1] not in ".!?" else "")
        seen.add((role, text))
    # states of the role grammar: "" start, "s", "u" waits for a, "e" may end
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "e", ("e", "u"): "u"}
    ways = {"": [(0, "", ())]}

    def insert(ways):
        best = {k: min(v) for k, v in ways.items()}
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                for letter, role in (("u", "user"), ("a", "assistant")):
                    if (state, letter) in move:
                        new = (cost + 2, audit + "I", (*out, f"{role}:"))
                        to = move[state, letter]
                        best[to] = min(best.get(to, new), new)
        return best

    for (_, role, text), fault in zip(rows, faults):
        out = {}
        for state, (cost, audit, told) in insert(ways).items():
            out.setdefault(state, []).append((cost + 3, audit + "D", told))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for letter, new, price, edit in ((role[:1], role, 0, "K"), ("u", "user", 2, "R"), ("a", "assistant", 2, "R")):
                    if (state, letter) in move:
                        out.setdefault(move[state, letter], []).append((cost + price + more, audit + edit, (*told, f"{new}:{text}")))
        ways = out
    cost, audit, told = min(v for k, v in insert(ways).items() if k in ("", "e"))
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in R.report(df, df).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    assert got == {conv: brute(v) for conv, v in by.items()}
    return got


def test_automaton():
    table = R.stacks()

    def accepts(word):
        at = {0}
        for letter in word:
            at = {j for i in at for j in table.go[i].get(letter, ())}
        return any(table.final[i] for i in at)

    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            word = "".join(word)
            body = word[1:] if word.startswith("s") else word
            assert accepts(word) == (word == "" or (body != "" and body == "ua" * (len(body) // 2)))


def test_against_search(spark):
    rng = random.Random(5)
    texts = ["Yes.", "no", "", " \t", "Why?", "a b.\n", None, "long " * 50 + "!"]
    rows = []
    for conv in [*range(120), None]:
        for i in range(rng.randrange(1, 11)):
            turn = rng.choice([i, i, i, rng.randrange(12), None])
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rng.choice(texts)))
    check(spark, rows)


def test_long_conversations_in_segments(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(7, rng.randrange(900), rng.choice(["user", "assistant", "system"]), f"t{rng.randrange(600)}{rng.choice('.,')}") for _ in range(1200)]
    rows += [(8, None, "user", "same.")] * 700 + [(8, 3, "assistant", "other.")] + [(9, t, "user", "") for t in range(600)]
    rows += [(10, None, rng.choice(["user", "assistant"]), f"n{i}.") for i in range(700)]
    got = check(spark, rows)
    assert got[8][2] == 699 and got[9][:2] == (0, 600)


def test_whole_lines_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", R.F.lit("x"))
    found, mended = R.repair(df.withColumn("place", R.F.lit("clash")))
    assert (found.collect()[0]["audit"], found.collect()[0]["cost"]) == ("KIKK", 3)
    assert [(r.role, r.text) for part in mended.orderBy("place").collect() for r in part["rows"]] == [("user", "Hi."), ("assistant", ""), ("user", "There?"), ("assistant", "Yes")]
    assert R.report(df.limit(0), df.limit(0)).count() == 0
    # a conversation that lost all its rows
    assert tuple(R.report(df, df.limit(0)).collect()[0]) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
