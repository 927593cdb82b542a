"""Conversation structure repair: generalised LR parsing with weighted edits.

A conversation's rows should read as its role grammar says (``RULES`` over the first
letters of the roles).  The LR automaton of the grammar is followed on a
graph-structured stack: a node is a state on the node below it, rows are kept, deleted
or given another role, rows may be inserted anywhere, and whenever two ways reach the
same node after the same row, the one with the least (cost, audit) stands for both.  The
audit lists the edits' letters (D, I, K, R) in order.  That is exact: of two ways of
equal cost to the same place neither audit begins with the other (the longer one would
have more inserts, which cost), so what follows never changes which is least.

How it runs on Spark:

1. Equal rows are folded to one with a count; the first turn of each role and text that
   several turns of a conversation repeat comes by a grouping on a hash of the text.
2. Rows are ordered by ranges of (conv_id, turn, role, text) and cut into segments of at
   most ``SEGMENT`` rows, so a conversation that holds a third of all rows is many
   segments in many tasks.  A segment is parsed on its own, from every stack that can lie
   before it, to a table of (stack before, stack after, cost, audit).
3. The tables, without texts, meet by conversation and are chained in order, streaming;
   a way is kept as links to its parts.
4. Each segment gets its part of the best way and writes its repaired rows.

A row's faults: blank (no character but white space), duplicate (its role and text came
earlier), truncated (the last such character does not end a sentence); the first counts.
Blank and duplicate rows must be deleted; a truncated row that stays costs one more.

Null roles and texts are one space; rows come by turn, null turns first, then by role and
text (UTF-8); repeated rows are rows of their own, duplicates of the first; a null conv_id
is a conversation; an empty role fits no rule; extra columns are ignored; an empty table
gives no rows.  Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from annolake.llm.common import pieces, written

#: (head, body): capital letters are rules, small ones first letters of roles.
RULES = (("S", ""), ("S", "sP"), ("S", "P"), ("P", "Pua"), ("P", "ua"))
#: Roles that a row may be given or inserted with.
ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SEGMENT = 256
#: Stacks that a grammar may need; left-recursive lists need few.
STACKS = 64
SPACE = " \t\n\x0b\x0c\r"


# --- automaton -------------------------------------------------------------

@dataclass(frozen=True)
class Stacks:
    """Every stack the grammar can build: where a symbol leads, and which may be the last."""

    go: tuple[dict[str, tuple[int, ...]], ...]
    final: tuple[bool, ...]


@lru_cache(None)
def stacks(rules: tuple[tuple[str, str], ...] = RULES) -> Stacks:
    heads = {head for head, _ in rules}
    rules = (("", rules[0][0]), *rules)

    def closed(items: set) -> frozenset:
        todo = list(items)
        for rule, dot in todo:
            for i, (head, _) in enumerate(rules):
                if rules[rule][1][dot:dot + 1] == head and head and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    def shift(state: frozenset, symbol: str) -> frozenset | None:
        moved = {(r, d + 1) for r, d in state if rules[r][1][d:d + 1] == symbol}
        return closed(moved) if moved else None

    def reduced(node) -> list:
        """The stack and all that its reductions lead to."""
        found = [node]
        for state, below in found:
            for rule, dot in state:
                head, body = rules[rule]
                if rule and dot == len(body):
                    base = (state, below)
                    for _ in body:
                        base = base[1]
                    new = (shift(base[0], head), base)
                    if new[0] is not None and new not in found:
                        found.append(new)
        return found

    def settled(node):
        """The stack, reduced as long as nothing else can be done."""
        while len(node[0]) == 1:
            (rule, dot), = node[0]
            if not rule or dot < len(rules[rule][1]):
                break
            base = node
            for _ in rules[rule][1]:
                base = base[1]
            node = (shift(base[0], rules[rule][0]), base)
        return node

    letters = sorted({c for _, body in rules for c in body} - heads)
    nodes, go = [(closed({(0, 0)}), None)], []
    for node in nodes:
        ways = {}
        for letter in letters:
            reached = []
            for top in reduced(node):
                state = shift(top[0], letter)
                if state is not None:
                    reached.append(settled((state, top)))
            for new in reached:
                if new not in nodes:
                    nodes.append(new)
                    if len(nodes) > STACKS:
                        raise ValueError("the grammar needs stacks without bound; write its lists left-recursive")
            if reached:
                ways[letter] = tuple(sorted({nodes.index(new) for new in reached}))
        go.append(ways)
    final = tuple(any((0, 1) in state for state, _ in reduced(node)) for node in nodes)
    return Stacks(tuple(go), final)


# --- parsing ---------------------------------------------------------------

#: (cost, audit, roles) of the best way to each stack; roles: the letter given by an
#: insert or a new role, else a dot.
Ways = list


def _offer(ways: Ways, at: int, way: tuple) -> bool:
    if ways[at] is None or way < ways[at]:
        ways[at] = way
        return True
    return False


def inserted(table: Stacks, ways: Ways) -> Ways:
    """With rows inserted wherever that pays."""
    ways, todo = list(ways), [i for i, way in enumerate(ways) if way]
    for i in todo:
        cost, audit, roles = ways[i]
        for letter in ROLES:
            for j in table.go[i].get(letter, ()):
                if _offer(ways, j, (cost + INSERT, audit + "I", roles + letter)):
                    todo.append(j)
    return ways


def step(table: Stacks, ways: Ways, code: str, times: int) -> Ways:
    """Past a row: ``x`` must go; else its role's letter, in capitals if truncated."""
    ways = inserted(table, ways)
    if code == "x":
        return [way and (way[0] + DELETE * times, way[1] + "D" * times, way[2] + "." * times) for way in ways]
    letter, more = code.lower(), TRUNCATED if code.isupper() else 0
    out = [way and (way[0] + DELETE, way[1] + "D", way[2] + ".") for way in ways]
    for i, way in enumerate(ways):
        if way is None:
            continue
        cost, audit, roles = way
        for j in table.go[i].get(letter, ()):
            _offer(out, j, (cost + more, audit + "K", roles + "."))
        for role in ROLES:
            if role != letter:
                for j in table.go[i].get(role, ()):
                    _offer(out, j, (cost + more + REROLE, audit + "R", roles + role))
    return out if times == 1 else step(table, out, "x", times - 1)


def parse(table: Stacks, rows: list[tuple[str, int]], start: int) -> Ways:
    ways: Ways = [None] * len(table.go)
    ways[start] = (0, "", "")
    for code, times in rows:
        ways = step(table, ways, code, times)
    return ways


def last_inserts(table: Stacks, start: int) -> tuple | None:
    """The best way from a stack to an end of the conversation without further rows."""
    ways: Ways = [None] * len(table.go)
    ways[start] = (0, "", "")
    return min((way for i, way in enumerate(inserted(table, ways)) if way and table.final[i]), default=None)


def code_of(role: str, blank: bool, duplicate: bool, truncated: bool) -> str:
    if blank or duplicate:
        return "x"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return letter.upper() if truncated else letter


# --- segments --------------------------------------------------------------

_WAY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())])
_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    ("turns", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("codes", pa.string()), ("copies", pa.list_(pa.int64())),
    ("kept", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("ways", pa.list_(_WAY))])
_SEGMENT_DDL = """conv_id long, place long, first_turn long, last_turn long, turns long, head string, tail string,
    blank long, duplicate long, truncated long, illegal long, codes string, copies array<long>,
    kept array<struct<role: string, text: string>>,
    ways array<struct<start: int, end: int, cost: long, audit: string, roles: string>>"""
LEGAL = ("su", "ua", "au")
_BYTES = 1 << 22


def _segment(table: Stacks, rows: list[dict], place: int, opens: bool) -> dict:
    """One row for a run of sorted rows of a conversation; ``opens``: surely its first."""
    codes = "".join(r["code"] for r in rows)
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    heads = [r["role"][:1] for r in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(heads, heads[1:]))
    illegal += sum(r["n"] - 1 for r, head in zip(rows, heads) if head * 2 not in LEGAL)
    of = {name: sum(r["n"] if r["fault"] == name else 0 for r in rows) for name in ("blank", "duplicate", "truncated")}
    of["duplicate"] += sum(r["n"] - 1 for r in rows if r["fault"] not in ("blank", "duplicate"))
    of["truncated"] -= sum(r["n"] - 1 for r in rows if r["fault"] == "truncated")
    starts = range(1) if opens else range(len(table.go))
    tokens = [(r["code"], r["n"]) for r in rows]
    ways = [{"start": s, "end": e, "cost": way[0], "audit": way[1], "roles": way[2]}
            for s in starts for e, way in enumerate(parse(table, tokens, s)) if way]
    return {"conv_id": rows[0]["conv_id"], "place": place, "first_turn": turns[0] if turns else None,
            "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "head": heads[0], "tail": heads[-1],
            **of, "illegal": illegal, "codes": codes, "copies": [r["n"] for r in rows],
            "kept": [{"role": r["role"], "text": r["text"]} for r in rows if r["code"] != "x"], "ways": ways}


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = stacks()
    place, rows, size, opens = TaskContext.get().partitionId() << 33, [], 0, False
    out, held = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            fresh = bool(rows) and rows[-1]["conv_id"] != row["conv_id"]
            if rows and (fresh or len(rows) >= SEGMENT or size > _BYTES):
                out.append(_segment(table, rows, place, opens))
                held += size + 64
                place, rows, size, opens = place + 1, [], 0, fresh
                if held > _BYTES:
                    yield pa.RecordBatch.from_pylist(out, _SEGMENT)
                    out, held = [], 0
            row["code"] = code_of(row["role"], row["fault"] == "blank", row["fault"] == "duplicate", row["fault"] == "truncated")
            rows.append(row)
            size += len(row["text"])
    if rows:
        out.append(_segment(table, rows, place, opens))
    if out:
        yield pa.RecordBatch.from_pylist(out, _SEGMENT)


# --- chaining --------------------------------------------------------------

_CHAIN = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("audit", pa.string()), ("roles", pa.string()),
                    ("cost", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "segments"))])
_CHAIN_DDL = ("conv_id long, place long, audit string, roles string, cost long, gaps long, blank long, duplicate long, "
              "truncated long, illegal long, segments long")


class _Link:
    """The end of a way: its last part on the way before it."""

    __slots__ = ("cost", "before", "audit", "roles")

    def __init__(self, cost: int, before: _Link | None, audit: str, roles: str):
        self.cost, self.before, self.audit, self.roles = cost, before, audit, roles

    def __lt__(self, other: _Link) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        mine, theirs, a, b = [], [], self, other
        while a is not b:  # as many parts on both sides
            mine.append(a)
            theirs.append(b)
            a, b = a.before, b.before
        told = [tuple("".join(getattr(link, name) for link in reversed(side)) for name in ("audit", "roles")) for side in (mine, theirs)]
        return told[0] < told[1]

    def parts(self) -> list[_Link]:
        out, link = [], self
        while link is not None:
            out.append(link)
            link = link.before
        return out[::-1]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment its part of the best way; for each conversation a row without a
    place, with the whole audit and the counts."""
    table = stacks()
    state: dict | None = None

    def close(s: dict) -> pa.RecordBatch:
        best = None
        for node, link in s["ways"].items():
            more = last_inserts(table, node)
            if more is not None:
                end = _Link(link.cost + more[0], link, more[1], more[2])
                best = end if best is None or end < best else best
        *parts, tail = best.parts()
        parts[-1] = _Link(parts[-1].cost, None, parts[-1].audit + tail.audit, parts[-1].roles + tail.roles)
        rows = [{"conv_id": s["conv_id"], "place": place, "audit": part.audit, "roles": part.roles, "segments": len(parts)}
                for place, part in zip(s["places"], parts)]
        gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
        rows.append({"conv_id": s["conv_id"], "audit": "".join(p.audit for p in parts), "cost": best.cost, "gaps": gaps,
                     "segments": len(parts), **{c: s[c] for c in ("blank", "duplicate", "truncated", "illegal")}})
        return pa.RecordBatch.from_pylist(rows, _CHAIN)

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or state["conv_id"] != row["conv_id"]:
                if state is not None:
                    yield close(state)
                state = {"conv_id": row["conv_id"], "ways": {0: None}, "places": [], "low": None, "high": None, "turns": 0, "tail": None,
                         "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            ways: dict[int, _Link] = {}
            for way in row["ways"]:
                if way["start"] in state["ways"]:
                    before = state["ways"][way["start"]]
                    link = _Link((before.cost if before else 0) + way["cost"], before, way["audit"], way["roles"])
                    if way["end"] not in ways or link < ways[way["end"]]:
                        ways[way["end"]] = link
            state["ways"] = ways
            state["places"].append(row["place"])
            for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                state[c] += row[c]
            state["illegal"] += state["tail"] is not None and state["tail"] + row["head"] not in LEGAL
            state["tail"] = row["tail"]
            if row["first_turn"] is not None:
                state["turns"] -= state["high"] == row["first_turn"]
                state["low"] = row["first_turn"] if state["low"] is None else state["low"]
                state["high"] = row["last_turn"]
    if state is not None:
        yield close(state)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each segment's rows as the edits leave them."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("segments", pa.int64()),
                        ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    for batch in batches:
        out = []
        for seg in batch.to_pylist():
            edits = zip(seg["audit"], seg["roles"])
            kept, rows = iter(seg["kept"]), []

            def take(row):
                for edit, role in edits:
                    if edit == "I":
                        rows.append({"role": ROLES[role], "text": ""})
                        continue
                    if row and edit != "D":
                        rows.append(row if edit == "K" else {"role": ROLES[role], "text": row["text"]})
                    return

            for code, n in zip(seg["codes"], seg["copies"]):
                take(next(kept) if code != "x" else None)
                for _ in range(n - 1):
                    take(None)
            rows += [{"role": ROLES[role], "text": ""} for _, role in edits]
            out.append({"conv_id": seg["conv_id"], "place": seg["place"], "segments": seg["segments"], "rows": rows})
        yield pa.RecordBatch.from_pylist(out, schema)


# --- jobs ------------------------------------------------------------------

def faults(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with ``n`` copies and the first copy's
    ``fault``; copies after the first are duplicates, or blank.  ``copies``: a column that
    says how often a row stands there."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")),
                       (F.lit(1) if copies is None else F.col(copies)).cast("long").alias("n"))
    at = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    again = (rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("key")).agg(F.min(at).alias("low"), F.max(at).alias("high"))
             .filter("low < high").select(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), "key", "low"))
    folded = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    joined = folded.join(again, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role"))
                         & (F.sha2("text", 256) == F.col("key")), "left")
    duplicate = F.coalesce(at > F.col("low"), F.lit(False))
    seen = F.rtrim("text", F.lit(SPACE))
    fault = (F.when(seen == "", "blank").when(duplicate, "duplicate")
             .when(~F.substring(seen, -1, 1).isin(".", "!", "?"), "truncated").otherwise(""))
    return joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def repair(rows: DataFrame, copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, turn, role, text) mended.

    One row for each conversation (conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, segments), and its repaired rows by segment (conv_id, place, segments,
    rows), to be read in the order of ``place``."""
    n = pieces(rows.sparkSession)
    ordered = (faults(rows, copies).repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 64))
               .sortWithinPartitions("conv_id", "turn", "role", "text"))
    segments = written(ordered.mapInArrow(_segments, _SEGMENT_DDL), "segments", 1024)
    chained = written(segments.drop("codes", "copies", "kept").repartition(n, "conv_id").sortWithinPartitions("conv_id", "place")
                      .mapInArrow(_chained, _CHAIN_DDL), "chained", 1024)
    parts = chained.filter("place is not null").select("place", "audit", "roles", "segments")
    mended = segments.select("conv_id", "place", "codes", "copies", "kept").join(parts, "place").mapInArrow(
        _repaired, "conv_id long, place long, segments long, rows array<struct<role: string, text: string>>")
    return chained.filter("place is null").drop("place", "roles"), written(mended, "mended", 1024)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's parts, joined by line ends, streaming."""
    def row(conv, total):
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([total.hexdigest()])], ["conv_id", "sha256"])

    open_, conv, total, some = False, None, None, False
    for batch in batches:
        for c, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not open_ or c != conv:
                if open_:
                    yield row(conv, total)
                open_, conv, total, some = True, c, hashlib.sha256(), False
            if told is not None:
                total.update(("\n" + told if some else told).encode())
                some = True
    if open_:
        yield row(conv, total)


def digest(mended: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the repaired ``role:text`` lines.  A checksum reads its input
    in order, so the parts of a long conversation pass through one task, one at a time."""
    lines = F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    told = mended.select("conv_id", "place", "segments", F.when(F.size("rows") > 0, F.array_join(lines, "\n")).alias("told"))
    one = told.filter("segments = 1").select("conv_id", F.sha2(F.coalesce("told", F.lit("")), 256).alias("sha256"))
    more = (told.filter("segments > 1").repartition(pieces(mended.sparkSession), "conv_id").sortWithinPartitions("conv_id", "place")
            .select("conv_id", "told").mapInArrow(_hashed, "conv_id long, sha256 string"))
    return one.unionByName(more)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows, damaged by a checksum of ``conv_id:turn``; ``copies`` of each."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    return conversations.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(told("role")).alias("role"),
                                text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("__kind")
                                ).filter("__kind <> 0").drop("__kind")


def report(conversations: DataFrame, rows: DataFrame, copies: str | None = None) -> DataFrame:
    """Every conv_id of ``conversations`` with what mending ``rows`` found and gave."""
    found, mended = repair(rows, copies)
    all_ = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    one = found.select(F.col("conv_id").alias("__a"), *(c for c in found.columns if c not in ("conv_id", "segments")))
    two = digest(mended).withColumnRenamed("conv_id", "__b")
    joined = all_.join(one, F.col("conv_id").eqNullSafe(F.col("__a")), "left").join(two, F.col("conv_id").eqNullSafe(F.col("__b")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                         F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
