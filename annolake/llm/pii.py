"""Personal data: base patterns, and bootstrapped contextual extraction.

Base spans come from fixed patterns for e-mail addresses, IP addresses, card numbers
(Luhn) and phone numbers, leftmost and not overlapping within a kind; matches that
fail the kind's test are dropped without a retry.

On top of that, identifiers that no pattern knows are found by their context.
Base spans are the seeds, whole and with their spaces.  The other instances are runs
of tokens (without white space) that hold a digit or ``@``, joined by single spaces, also
with a lone bracket or hyphen between; a run ends before a token that a base span
touches.  Runs that look like secrets (long hexadecimal or mixed strings) are seeds of a
fifth kind; a look alone marks nothing, only a reliable context does.  An instance has
lexical patterns of several families: the two words before it, without digits; the word
before with the instance's shape; a label with its sign (``token =``).  Instances without
any are of no use and left out.  Over the graph of patterns and instances, scores go back
and forth for ``ROUNDS`` rounds: a pattern's confidence in a kind is the mean score of its distinct
instances (one more counted as 0), an instance's score the best confidence among its
patterns, 1 for seeds.  Patterns with at least ``SUPPORT`` seeds and a confidence of
``CONFIDENCE`` then mark their other instances of ``LENGTH`` characters or more,
unless a base span overlaps them.

Positions are found by writing a mark around each match and adding up the lengths of
the pieces.  Everything is DataFrame expressions, joins and aggregates; pattern and
instance counts combine before they are shuffled, so a pattern with a third of all
rows is a few rows.

Null texts are empty and have no spans; a null doc_id is kept.  Every row gets its own
result, rows that repeat doc_id and text the same one.  Extra columns are dropped; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from annolake.llm.common import written

KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans; what looks like a secret.
ALL_KINDS = (*KINDS, "secret")
SECRET = (r"^(?:(?=[^0-9]*[0-9])(?=[^A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}"
          r"|(?=[^0-9]*[0-9])(?=[^a-z]*[a-z])(?=[^A-Z]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2})$")
#: Equal in what they match to the plain forms in the module's tests, but without
#: trying a run of characters again from each of its places.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
RUN = rf"(?<![^\x20\x09-\x0D]){_TOKEN}(?:\x20(?:[()-]\x20)?{_TOKEN})*+"
#: Quotes and brackets around an instance; a bracket that closes within it stays.
_LEAD = r"^(?:[\[{\"'<]|\((?![^()]*\)[^)\]}\"'>.,;:!?]))+"
_TRAIL = r"(?:[\]}\"'>.,;:!?]|(?<!.\([^()]{0,64})\))+$"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ROUNDS, SUPPORT, CONFIDENCE, LENGTH = 3, 5, 0.8, 5
_BEGIN, _END = "\ue000", "\ue001"
_RUN = 128


def _sums(values: Column, base: Column) -> Column:
    """Sums of all earlier values, counted from ``base``."""
    start = F.struct(base.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(values, start, lambda s, n: F.struct(
        (s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])


def located(df: DataFrame, column: str, text: Column, pattern: str, when: Column) -> DataFrame:
    """``df`` with an array of (before, found, start) for the pattern's matches.

    ``before`` is the text between the earlier match and this one.  Lengths are added
    up in pieces, so that long arrays stay cheap; the steps are columns that are used
    twice, which Spark computes once."""
    safe = F.translate(text, _BEGIN + _END, "\ufffd\ufffd")
    marked = F.when(when, F.split(F.regexp_replace(safe, f"({pattern})", f"{_BEGIN}$1{_END}"), f"[{_BEGIN}{_END}]"))
    parts, sizes, pieces = (F.col(f"__{name}_{column}") for name in ("parts", "sizes", "pieces"))
    df = df.withColumn(f"__parts_{column}", F.coalesce(marked, F.array(F.lit(""))))
    df = df.withColumn(f"__sizes_{column}", F.transform(parts, lambda p: F.length(p).cast("long")))
    df = df.withColumn(f"__pieces_{column}", F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _RUN).cast("int")), lambda i: F.slice(sizes, i * _RUN + 1, F.lit(_RUN))))
    totals = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, n: a + n))
    starts = F.flatten(F.zip_with(pieces, _sums(totals, F.lit(0)), _sums))
    before = F.slice(F.concat(F.array(F.lit("")), parts), 1, F.size(parts))
    triples = F.filter(F.arrays_zip(before.alias("before"), parts.alias("found"), starts.alias("start")),
                       lambda _, i: i % 2 == 1)
    found = F.when(F.size(parts) > 1, triples)
    return (df.withColumn(column, F.transform(found, lambda t: F.struct(
        t["before"].alias("before"), t["found"].alias("found"), t["start"].alias("start"))))
        .drop(*(f"__{name}_{column}" for name in ("parts", "sizes", "pieces"))))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def valid(kind: str, text: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        return text.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(text)).between(14, 19) & F.call_function("luhn_check", _digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    return F.lit(True)


def _matched(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with an array of (before, found, start) of each kind's valid matches."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__digit", whole.rlike("[0-9]"))
    needs = {"email": F.contains(whole, F.lit("@")), "ip": F.col("__digit"), "card": F.col("__digit"),
             "phone": F.col("__digit") & F.contains(whole, F.lit("+"))}
    none = F.array().cast("array<struct<before:string,found:string,start:bigint>>")
    for kind in KINDS:
        df = located(df, f"__{kind}", whole, PATTERNS[kind], needs[kind])
    return df.withColumns({f"__{kind}": F.filter(F.coalesce(f"__{kind}", none), lambda s: valid(kind, s["found"]))
                           for kind in KINDS}).drop("__digit")


def _based(matched: DataFrame) -> DataFrame:
    def spans(rank: int, kind: str) -> Column:
        return F.transform(f"__{kind}", lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), (s["start"] + F.length(s["found"])).alias("end")))
    return matched.withColumn("base", F.sort_array(F.concat(*(spans(r, k) for r, k in enumerate(KINDS)))))


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base``: (start, rank, end) of all base spans, in order."""
    return _based(_matched(docs, text)).drop(*(f"__{k}" for k in KINDS))


_PLAIN = r"[^\x20\x09-\x0D0-9@]+"
_GAP = r"[\x20\x09-\x0D]"


def _line(before: Column) -> Column:
    return F.lower(F.substring_index(F.rtrim(before), "\n", -1))


def _patterns(line: Column, instance: Column) -> Column:
    """The patterns of an instance after ``line``, each with its family's letter."""
    two = F.trim(F.regexp_extract(line, rf"(?<![^\x20\x09-\x0D])({_PLAIN}){_GAP}+({_PLAIN}){_GAP}*$", 0))
    one = F.trim(F.regexp_extract(line, rf"(?<![^\x20\x09-\x0D])({_PLAIN}){_GAP}*$", 0))
    label = F.regexp_extract(line, rf"([A-Za-z_][A-Za-z_.-]*{_GAP}*[=:#]){_GAP}*[\"'(\[]*$", 1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(instance, "[A-Za-z]+", "a"), "[0-9]{5,}", "N"), "[0-9]+", "n")
    found = [F.when(two != "", F.concat(F.lit("2 "), two)), F.when(label != "", F.concat(F.lit("= "), F.regexp_replace(label, _GAP, ""))),
             F.when((one != "") & (F.length(shape) <= 24), F.concat(F.lit("1 "), one, F.lit(" "), shape))]
    return F.array_compact(F.array(*found))


def instances(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, start, end, pattern, instance, seed) of all base spans and runs that may identify."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(whole).alias("fp"), whole.alias("text")).filter(whole.rlike("[0-9@]"))
    found = located(_based(_matched(rows, "text")), "runs", F.col("text"), RUN, F.lit(True))

    def told(s: Column, kind: str | None) -> Column:
        return F.struct(s["start"].alias("start"), _line(s["before"]).alias("line"), s["found"].alias("instance"),
                        F.lit(kind).cast("string").alias("seed"))
    none = F.array().cast("array<struct<start:bigint,line:string,instance:string,seed:string>>")
    every = F.concat(*(F.coalesce(F.transform(name, lambda s: told(s, kind)), none)
                       for name, kind in [*((f"__{k}", k) for k in KINDS), ("runs", None)]))
    some = found.select("doc_id", "fp", "base", F.filter(every, lambda s: s["line"] != "").alias("every"))
    # a run's part before the tokens that a base span touches
    end = lambda s: s["start"] + F.length(s["instance"])
    first = lambda s: F.array_min(F.transform(
        F.filter("base", lambda b: (b["start"] < end(s)) & (b["end"] > s["start"])), lambda b: b["start"]))
    some = some.withColumn("every", F.transform("every", lambda s: F.struct(
        s["start"].alias("start"), s["line"].alias("line"), s["instance"].alias("instance"), s["seed"].alias("seed"),
        F.when(s["seed"].isNull(), first(s)).alias("first"))))
    rows = some.select("doc_id", "fp", F.inline("every"))
    cut = F.rtrim(F.regexp_replace(F.substr("instance", F.lit(1), F.greatest(F.lit(0), F.col("first") - F.col("start")).cast("int")),
                                   r"[^\x20]*$", ""))
    rows = rows.withColumn("instance", F.when(F.col("first").isNotNull(), cut).otherwise(F.col("instance")))
    bare = F.regexp_replace("instance", _LEAD, "")
    free = F.col("seed").isNull()
    rows = (rows.withColumn("start", F.when(free, F.col("start") + F.length("instance") - F.length(bare)).otherwise(F.col("start")))
            .withColumn("instance", F.when(free, F.regexp_replace(bare, _TRAIL, "")).otherwise(F.col("instance")))
            .withColumn("end", F.col("start") + F.length("instance")).filter(F.col("instance").rlike("[0-9@]"))
            .withColumn("seed", F.when(free & F.col("instance").rlike(SECRET), F.lit("secret")).otherwise(F.col("seed"))))
    return rows.select("doc_id", "fp", "start", "end", F.explode(_patterns(F.col("line"), F.col("instance"))).alias("pattern"),
                       "instance", "seed")


def learn(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind) that the seeds make reliable."""
    edges = written(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    seeds = edges.filter("seed is not null")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores = seeds.select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    patterns = None
    for _ in range(rounds):
        patterns = written(edges.select("pattern", "instance").join(scores, "instance")
                           .groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
                           .join(sizes, "pattern").select("pattern", "kind", (F.col("total") / (F.col("n") + 1)).alias("confidence")),
                           "patterns")
        spread = (edges.filter("seed is null").select("pattern", "instance").join(patterns, "pattern")
                  .groupBy("instance", "kind").agg(F.max("confidence").alias("score")))
        scores = written(seeds.select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
                         .unionByName(spread), "scores")
    held = seeds.groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= support)
    best = patterns.filter(F.col("confidence") >= confidence).join(held, ["pattern", "kind"])
    return best.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"),
                                       F.max("confidence").alias("confidence"))


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, spans) of every row; spans are (start, rank of kind, end)."""
    docs = docs.select("doc_id", "text")
    found = written(instances(docs), "instances")
    reliable = written(learn(found, **options), "reliable")
    rank = F.array_position(F.array(*(F.lit(k) for k in ALL_KINDS)), F.col("kind")).cast("int") - 1
    # of several reliable patterns around one instance, the most confident tells its kind
    marked = (found.filter("seed is null or seed = 'secret'").filter(F.length("instance") >= LENGTH).join(reliable, "pattern")
              .groupBy("doc_id", "fp", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind")))
    added = written(marked.groupBy(F.col("doc_id").alias("__doc"), F.col("fp").alias("__fp"))
                    .agg(F.collect_set(F.struct("start", rank.alias("rank"), "end")).alias("added")), "added")
    rows = base(docs).select("doc_id", "base", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"))
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("fp") == F.col("__fp")), "left")
    free = F.filter(F.col("added"), lambda a: ~F.exists(F.col("base"), lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return joined.select("doc_id", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(
        F.sort_array(F.concat(F.col("base"), free))).alias("spans"))


def told(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts(spans: Column) -> list[Column]:
    def count(rank: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
    return [count(rank).alias(f"n_{kind}") for rank, kind in enumerate(KINDS)]


def mask(text: Column, spans: Column, with_: str = "[{}]") -> Column:
    """The text with each span replaced by its kind; overlapping spans go as one."""
    return F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, p: F.struct(
            F.when(p["start"] < s["at"], s["out"]).otherwise(F.concat(
                s["out"], F.substr(text, (s["at"] + 1).cast("int"), (p["start"] - s["at"]).cast("int")),
                F.replace(F.lit(with_), F.lit("{}"), F.get(F.array(*(F.lit(k) for k in ALL_KINDS)), p["rank"])))).alias("out"),
            F.greatest(s["at"], p["end"]).alias("at")),
        lambda s: F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
